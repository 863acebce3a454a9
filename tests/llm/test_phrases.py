from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from airlume.llm import phrases
from airlume.llm.phrases import Summary, collocations


def _plain(rows, min_count, top=2000):
    count: Counter = Counter()
    total: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count.update((lang, tuple(words[p : p + k])) for p in range(len(words) - k + 1))
    often = {g: n for g, n in count.items() if len(g[1]) > 1 and n >= min_count}
    out = []
    for (lang, words), a in often.items():
        if any(
            n >= a and other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (other, w), n in often.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, k, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, total[lang], score, k))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def _table(spark, rows):
    full = [(i, t, lang, "x", 3, None) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, phrase string, words int, count long")


def _rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k").collect())


def _corpus():
    draw = random.Random(4)
    words = ["the", "of", "New", "new", "York", "été", "x" * 300, "a\xa0b", "汉字", "\x00", "Ä", "and", "city"]
    rows = [(None, None), ("", ""), ("en", " \t "), ("en", "...\n\r\x0b\x0c"), ("und", "a b"), (None, "a b"), ("en", "a a a a a a a a")]
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!?"]) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "en", "fr", None]), text))
    rows += [("de", "one two three four five six seven. ")] * 40 + [("de", "two three four")] * 3
    rows.append(("en", "new york city of the " * 9000))
    rows.append(("fr", "une ville nouvelle, " * 9000))
    return rows


def test_equals_brute_force(spark):
    rows = _corpus()
    table = _table(spark, rows)
    assert _rows(collocations(table, 12)) == _plain(rows, 12)
    # many small blocks, many lowered counters
    assert _rows(collocations(table.repartition(5), 12, block_bytes=2000, bucket_mass=3000)) == _plain(rows, 12)
    assert _rows(collocations(table, 12, top=7)) == _plain(rows, 12, 7)


def test_empty_and_without_candidates(spark):
    assert collocations(_table(spark, [])).count() == 0
    assert collocations(_table(spark, [("en", None), (None, "a b c d")])).count() == 0


def test_summaries_lose_less_than_the_threshold():
    draw = np.random.default_rng(1)
    true: Counter = Counter()
    parts = [Summary(300, 100) for _ in range(4)]
    for i in range(60):
        keys = np.concatenate([draw.integers(0, 1 << 40, 1500), draw.integers(0, 50, 200), np.full(400, 7)]).astype(np.uint64)
        true.update(keys.tolist())
        parts[i % 4].add(keys, np.ones(len(keys), np.int64))
        assert parts[i % 4].lost < 100
    merged = parts[0]
    for other in parts[1:]:
        merged.add(other.keys, other.counts)
        merged.lost = min(merged.lost + other.lost, 99)
    assert {k for k, n in true.items() if n >= 500} <= set(merged.keys.tolist())
    lone = Summary(20, 100)
    for _ in range(30):
        lone.add(np.arange(40, dtype=np.uint64), np.full(40, 5))  # all 40 are frequent, over the capacity
    assert set(lone.survivors().tolist()) == set(range(40))


def test_long_texts_are_cut_between_pieces_only():
    text = b"ab cd. ef gh\nij kl " * 50 + b"x" * 400 + b"; end"
    parts = list(phrases._cut(text, 64))
    assert b"".join(parts) == text and len(parts) > 10
    assert all(p[-1:] in (b".", b"\n", b";") for p in parts[:-1])
