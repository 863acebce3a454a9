from __future__ import annotations

import random

import numpy as np
import xxhash

from airlume.llm.components import components
from airlume.llm.simhash import drop_near, descend, links, near_duplicates, simhash, traverse


def _plain_print(text: str) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = lowered.encode().split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def _cluster(draw: random.Random, n: int) -> list[int]:
    out = []
    while len(set(out)) < n:
        base = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            base ^= sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 3)))
            out.append(base & (1 << 64) - 1)
    return sorted(set(out))


def test_traversal_finds_every_component():
    draw = random.Random(3)
    for n in (1, 2, 70, 400):
        keys = _cluster(draw, n)
        label = traverse(np.array(keys, np.uint64), None, 0, 0, 2)
        want = _plain_components(dict(enumerate(keys)))
        assert label.tolist() == [want[i] for i in range(len(keys))]


def test_links_with_tiny_pairs_equal_brute_force(spark):
    keys = _cluster(random.Random(5), 300)
    signed = [(k - (1 << 64) if k >> 63 else k, i * 3) for i, k in enumerate(keys)]
    nodes = spark.createDataFrame(signed, "fingerprint long, node long")
    found = links(nodes, pair_rows=8)
    got = {r.node: r.component for r in components(found).collect()}
    want = _plain_components({i * 3: k for i, k in enumerate(keys)})
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_loops_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(5, 5), (3, 2), (3, 2)]
    star = [(1000, 1000 + i) for i in range(1, 40)] + [(-7, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: -7 for i in [*range(1000, 1040), -7]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark, texts):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows: list[tuple[int | None, str | None]] = [(5, None), (4, ""), (90, " \t\x0b"), (7, "one"), (8, "ONE"), (9, "one two"), (9, "one two")]
    for i in range(100, 160):
        text = " ".join(draw.choices(words, k=400))
        rows += [(i * 10, text), (i * 10 + 1, text + " tail"), (i * 10 + 2, text.upper().replace(" ", "\n"))]
    rows.append((99, "Ä ä\xa0b " * 40_000))
    got = near_duplicates(texts(rows)).collect()
    prints = {i: _plain_print(t or "") for i, t in rows}
    want = _plain_components(prints)
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint % (1 << 64) == prints[r.doc_id]
        assert r.component_id == want[r.doc_id]
    assert near_duplicates(texts([])).count() == 0
    lone = near_duplicates(texts([(None, "a b c d")])).collect()
    assert [(r.doc_id, r.component_id) for r in lone] == [(None, None)]


def test_simhash_counts_chunks_like_one():
    text = " ".join(f"v{i % 977}" for i in range(70_000))
    assert simhash(text.encode()) == _plain_print(text)


def test_descend_sends_pairs_once(spark):
    rows = spark.createDataFrame([(0, 0, k << 56, k) for k in range(128)], "left long, right long, key long, node long")
    pairs = {(r.left, r.right) for r in descend(rows, 0, 6, 2).collect()}
    assert all((a ^ b).bit_count() <= 2 and a <= b for a, b in pairs)
    # 32 prefixes with themselves, with each other, and with those that have the first bit too
    assert len(pairs) == 32 + 32 * (5 + 10) // 2 + 32 * (1 + 5)


def test_drop_near_judges_rows_of_one_id_by_their_texts(spark, texts):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    rows = [(3, a), (5, a), (5, b), (5, b), (9, b), (None, a), (None, None), (11, ""), (12, None)]
    docs = texts(rows)
    kept = drop_near(docs)
    assert kept.columns == docs.columns
    want = [(3, a), (5, b), (5, b), (None, a), (None, None), (11, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert drop_near(texts([])).count() == 0
