"""Token counts by a unigram model whose forward scores are shared along a trie.

The best score of a prefix depends on the prefix alone, so all pre-tokens with a
prefix in common share its forward score. The distinct pre-tokens of a batch are
put in a trie, every node gets its score and token count once, and terminal nodes
hold the counts of pre-tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Begins every pre-token, as in the piece list.
SPACE = "▁"
# An unknown character costs this much more than the rarest piece, a token a byte.
UNKNOWN_PENALTY = 10.0
# Pre-tokens whose counts a worker keeps from batch to batch.
KEEP = 1 << 19
# Text worked on together, in code points.
BLOCK = 4 << 20


@lru_cache(maxsize=2)
def model(path: str) -> tuple[dict[str, float], int, float]:
    """Scores of the pieces of a model file, longest length, score of an unknown byte.

    The file lists pieces by rank only. A piece of rank r is given the unigram
    log-probability of Zipf's law, -log(r + 1) less the log of the sum.
    """
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [
        pieces.id_to_piece(i) for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(usable))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(usable)}
    return scores, max(map(len, scores)), min(scores.values()) - UNKNOWN_PENALTY


def trie_counts(words: list[str], path: str) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct word; of equal ones the shortest."""
    scores, longest, unknown = model(path)
    out: dict[str, int] = {}
    # Nodes of the trie on the way to the current word: forward score and tokens.
    # Sorted words visit the trie depth first, so only that way is held.
    way_score, way_count, before = [0.0], [0], ""
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del way_score[shared + 1 :], way_count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            tokens = len(word[end - 1].encode())
            best, count = way_score[end - 1] + unknown * tokens, way_count[end - 1] + tokens
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    score += way_score[start]
                    if score > best or score == best and way_count[start] + 1 < count:
                        best, count = score, way_count[start] + 1
            way_score.append(best)
            way_count.append(count)
        out[word] = way_count[len(word)]
        before = word
    return out


def count_tokens(docs: DataFrame, path: str, keep: int = KEEP) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of ``docs`` (doc_id, text).

    Pre-tokens are runs of other than ``[\\x20\\x09-\\x0D]`` in the whole text, each
    with a mark before it; n_tokens sums the lengths of their best segmentations
    by the pieces at ``path`` (present on every executor). Null and empty texts
    have none. Rows that share a doc_id or have none are counted each on its own.
    Other columns are ignored; an empty table gives none. Nothing is shuffled: a
    trie holds the pre-tokens of a bounded block, and a worker keeps the counts of up to
    ``keep`` of them from block to block.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            at = 0
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            while at < batch.num_rows:
                to, held = at, 0
                while to < batch.num_rows and (to == at or held + sizes[to] <= BLOCK):
                    held += sizes[to]
                    to += 1
                part = batch.slice(at, to - at)
                bags = [Counter(x.split()) for x in part.column(1).cast(pa.binary()).to_pylist()]
                new = set().union(*bags).difference(known)
                if len(known) + len(new) > keep:
                    known, new = {}, set().union(*bags)
                named = {SPACE + w.decode(): w for w in new}
                known.update((named[w], n) for w, n in trie_counts(list(named), path).items())
                total = [sum(known[w] * n for w, n in bag.items()) for bag in bags]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([b.total() for b in bags], pa.int64()), pa.array(total, pa.int64())],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )
                at = to

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(work, "doc_id long, n_pretokens long, n_tokens long")
