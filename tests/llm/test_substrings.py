from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from airlume.llm import textblocks
from airlume.llm.substrings import COVER, PERIOD, _owner_column, _pieces, remove_repeats
from airlume.llm.textblocks import NO_ID, Words, xxhash64


def _plain(rows):
    split = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, w), (shown, _) in zip(split, rows, strict=True):
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone).decode()
        out.append((shown, len(w), len(gone), kept))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def _cases():
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "of\xa0the", "the", "the", "the"]
    word = lambda n: draw.choices(vocabulary, k=n)
    passage = [word(n) for n in (13, 14, 50, 12, 200)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "same " * 60), (5, "same " * 59), (5, "same " * 13)]
    for d in range(120):
        text = word(draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            text += draw.choice(passage)[draw.randint(0, 3) :] + word(draw.randint(0, 9))
        rows.append((10 + draw.randint(0, 1000), draw.choice([" ", "\n", " \t"]).join(text)))
    copied = rows[40][1]
    rows += [(5000 + i, copied) for i in range(20)] + [(None, copied), (None, "alone " + " ".join(word(40))), (-3, copied)]
    rows += [(7000, " ".join(word(30_000) + passage[4]))]
    return rows


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    texts = [b"a bb  ccc", b"", b"\tccc bb\na ", b"x" * 5000 + b" bb"]
    plain = Words.of(texts).hashes(1)
    tokens = [w for t in texts for w in t.split()]
    assert len({(t, h) for t, h in zip(tokens, plain.tolist(), strict=True)}) == len(set(tokens)) == len(set(plain.tolist()))
    monkeypatch.setattr(textblocks, "SEGMENT_BYTES", 7)
    assert (Words.of(texts).hashes(1) == plain).all()


def test_xxhash64_equals_spark(spark):
    values = [0, 1, -1, NO_ID, -(1 << 63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert xxhash64(np.array(values)).view(np.int64).tolist() == got


def test_equals_brute_force(spark, texts):
    rows = _cases()
    assert _rows(remove_repeats(texts(rows))) == _plain(rows)
    assert _rows(remove_repeats(texts(rows).repartition(7), buckets=5)) == _plain(rows)
    assert remove_repeats(texts([])).count() == 0


def test_small_blocks(spark, texts):
    rows = _cases()[:90]
    assert _rows(remove_repeats(texts(rows), block_bytes=500)) == _plain(rows)


def test_half_of_the_rows_without_id_or_with_one_id(spark, texts):
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None if i % 2 else 7 if i % 4 else i, " ".join(draw.choices("abcdefgh", k=20)) + f" {passage} {i}") for i in range(160)]
    rows += [(None, passage)] * 40 + [(3, passage)]
    docs = texts(rows).repartition(6)
    assert _rows(remove_repeats(docs, buckets=16, hot_bytes=1000)) == _plain(rows)
    pieces = _pieces(docs, 16, 1000)
    assert set(pieces) == {NO_ID, 7}
    sizes = [r[1] for r in docs.groupBy(_owner_column(16, pieces)).count().collect()]
    assert max(sizes) < 60 and len(sizes) > 10
