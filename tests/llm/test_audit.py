from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations, permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from airlume.llm.audit import COALITIONS, SCALE, audit, potential


def _plain(rows, labels):
    first: dict[str, int] = {}
    far = 1 << 62
    for i, t, _ in rows:
        key = t or ""
        first[key] = min(first.get(key, far), far if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": (far if i is None else i) > first[t],
        }
        docs[lang or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out = []
    for part, held in docs.items():
        share = defaultdict(int)
        mine = []
        for order in permutations("ABCDE"):
            left = held
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                share[x] += len(gone)
                failing = sum(x in d[0] for d in held)
                mine.append((
                    part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {x} for d in held),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), x,
                ))
        out += [(*r[:-1], share[r[-1]]) for r in mine]
    return sorted(out)


def test_equals_brute_force(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["CAPS", "a|b", "é", "\xa0"]
    texts = [None, "", " \n\t", "A" * 60, "汉 " * 120, "x y " * 60_000] + [
        " ".join(draw.choices(words[: draw.choice([60, 200, 304])], k=draw.choice([20, 99, 100, 101, 130]))) for _ in range(60)
    ]
    ids = [*range(80), 5, 5, 9]
    rows = [(i, draw.choice(texts), draw.choice(["en", "en", "fr", "", None])) for i in ids]
    rows += [(7, "same", "en"), (7, "same", "en"), (None, "same", "fr"), (None, "alone", None), (None, "alone", "en")]
    rows += [(1000 + i, "copy of copies", "fr") for i in range(50)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "s", 1, True) for r in rows], "doc_id long, text string, lang string, part string, n int, fails boolean")
    table = spark.createDataFrame([(*r, 4) for r in labels], "doc_id long, quality int, toxic int, n int")
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, audit(docs, table).select(*names).collect())) == _plain(rows, labels)
    assert audit(docs.limit(0), table).count() == 0
    assert audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_potential_gives_shapley_values(spark):
    draw = random.Random(8)
    values = [0] + [draw.randint(-(10**15), 10**15) for _ in range(COALITIONS - 1)]
    got = spark.range(1).select(potential(F.array(*map(F.lit, values))).alias("p")).first().p
    for i in range(5):
        others = [j for j in range(5) if j != i]
        want = sum(
            factorial(k) * factorial(4 - k) * (values[sum(1 << j for j in s) + (1 << i)] - values[sum(1 << j for j in s)])
            for k in range(5) for s in combinations(others, k)
        )
        assert (got[31] - got[31 - (1 << i)]) * (factorial(5) // SCALE) == want
    assert got[0] == 0 and got[1] == SCALE * values[1]


@pytest.mark.parametrize("lang", [None, "", "en"])
def test_parts(spark, lang):
    docs = spark.createDataFrame([(1, "one", lang)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit(docs, labels)
    assert got.count() == 600 and {r.part for r in got.collect()} == {lang or ""}
