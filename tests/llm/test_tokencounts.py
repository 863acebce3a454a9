from __future__ import annotations

import random

import public_tokenizers

from airlume.llm import tokencounts
from airlume.llm.tokencounts import SPACE, count_tokens, model, trie_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _plain(word: str) -> int:
    """Best segmentation by the full recurrence over (score, fewest tokens)."""
    scores, _, unknown = model(PATH)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + unknown * size, best[end - 1][1] + size)]
        ways += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    return best[-1][1]


def _words():
    draw = random.Random(8)
    parts = ["the", "ing", "tion", "é", "日本", "🙂", "x", "Qz", "...", "123", "\xa0"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(300)] + ["the", "them", "theme", "a" * 300]


def test_trie_equals_brute_force():
    words = [SPACE + w for w in _words()]
    assert trie_counts(words, PATH) == {w: _plain(w) for w in words}


def test_counts_of_whole_texts(spark, texts):
    words = _words()
    rows = [(0, None), (1, ""), (2, " \n"), (3, " ".join(words)), (3, " ".join(words)), (None, "the\tthem\x0btheme"), (4, "the " * 50_000)]
    want = sorted(((i, len((t or "").encode().split()), sum(_plain(SPACE + w.decode()) for w in (t or "").encode().split()[:400]) if i != 4 else 50_000 * _plain(SPACE + "the")) for i, t in rows), key=str)
    for keep in (tokencounts.KEEP, 10):
        got = count_tokens(texts(rows), PATH, keep).collect()
        assert sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in got), key=str) == want
    assert count_tokens(texts([]), PATH).count() == 0
