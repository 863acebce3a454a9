from __future__ import annotations

import random
import re

from airlume.llm.decontaminate import benchmark_hits, contaminated, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def _plain(docs, items):
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = _words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if n and i is not None else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = _words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "e") for i, t in rows], "item_id long, text string, doc_id string")


def _cases():
    draw = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(30)] + ["Ärger", "the", "the", "of"]
    item = lambda n: draw.choices(vocabulary, k=n)
    items = [(i, " ".join(item(n))) for i, n in enumerate([13, 14, 20, 60, 12, 8, 7, 3, 1, 40, 13])]
    items += [(11, ""), (12, None), (13, "!!"), (3, "a second text of item three"), (None, "no id here"), (14, "the " * 30)]
    docs = [(0, None), (1, ""), (2, "..."), (3, "The of"), (4, "the " * 200)]
    for d in range(40):
        text = item(draw.randint(0, 80))
        for _ in range(draw.randint(0, 3)):
            source = (draw.choice(items)[1] or "").split()
            a = draw.randint(0, len(source))
            text[draw.randint(0, len(text)) :] = source[a : a + draw.randint(5, 40)] + item(draw.randint(0, 20))
        docs.append((100 + d, draw.choice([" ", "-", ", "]).join(text).upper() if d % 2 else " ".join(text)))
    docs += [(200, items[3][1]), (200, items[9][1]), (None, items[2][1]), (None, "clean"), (300, (items[3][1] + " zzz ") * 700)]
    return docs, items


def _rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect()), key=str)


def test_equals_brute_force(spark, texts):
    docs, items = _cases()
    assert _rows(benchmark_hits(texts(docs), _items(spark, items))) == _plain(docs, items)


def test_large_benchmark_path(spark, texts, monkeypatch):
    monkeypatch.setattr("airlume.llm.decontaminate.known_small", lambda df: False)
    docs, items = _cases()
    assert _rows(benchmark_hits(texts(docs), _items(spark, items))) == _plain(docs, items)


def test_empty_tables(spark, texts):
    assert benchmark_hits(texts([]), _items(spark, [(1, "a b")])).count() == 0
    assert _rows(benchmark_hits(texts([(1, "a b")]), _items(spark, []))) == [(1, 2, 0, [])]


def test_drop_follows_the_rule(spark, texts):
    item = " ".join(f"q{i}" for i in range(13))
    docs = texts([(1, item + " x" * 247), (2, item + " x" * 248), (3, "x"), (4, None)])
    kept = drop_contaminated(docs, _items(spark, [(1, item)]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert contaminated is not None
