from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from airlume.llm.exact import drop_exact, exact_groups

ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb\x0b\x0c\r\n"), (4, "a\xa0b"), (5, None), (6, ""), (7, "  "),
    (9, "ab"), (8, "a b "), (10, "é" * 5), (11, "é" * 5), (12, "é " * 5), (13, "x" * 300_000), (13, "x" * 300_000),
    (None, "lonely"), (None, "shared"), (20, "shared"), (21, "a  b  "), (14, "a  b  "),
]


def _plain(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        text = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[text])[3]
        out.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_equals_brute_force(spark, texts):
    assert _rows(exact_groups(texts(ROWS))) == _plain(ROWS)
    assert exact_groups(texts([])).count() == 0


def test_colliding_hashes_are_told_apart(spark, texts):
    got = exact_groups(texts(ROWS), hash_of=lambda text: F.substring(F.md5(text), 1, 1))
    assert _rows(got) == _plain(ROWS)


def test_drop_keeps_columns(spark, texts):
    docs = texts(ROWS)
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, stays, _ in _plain(ROWS) if stays), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
