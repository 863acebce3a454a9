"""Removal of passages that an earlier document has, found at difference-cover anchors.

COVER holds residues modulo PERIOD such that every residue is a difference of two
of them. Two copies of a window therefore share a place, at most PERIOD - 1 words
in, that has a residue of COVER in both documents. Hashes of GRAM words are taken
at such places only. Where a hash occurs in two documents, it is extended to the
windows around it, and those are compared by 128-bit hashes.

Hashes travel in packed rows, one for each bucket and block of text. A block sends
one entry for a hash, however often it has it: its further documents are known to
be repeats already. So a hash that a third of all documents share costs one entry
per block, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.llm.tables import text_bytes
from airlume.llm.textblocks import NO_ID, Words, blocks, encoded, mixed, xxhash64

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
GRAM = WINDOW - (PERIOD - 1)
# Bytes of input files for one bucket of hashes and of documents.
BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 64
# Rows of one id, or without, that have more bytes of text are dealt over more buckets.
HOT_BYTES = 4 * BUCKET_BYTES
# Any id outside the largest MAX_HOT_IDS has under 1/MAX_HOT_IDS of all text.
MAX_HOT_IDS = 1_000
# Bytes of text whose entries are folded and packed together.
BLOCK_BYTES = 4 << 20

_PACKED = "bucket int, known boolean, docs binary, low binary, high binary"
_SEEDS = (11, 13)


def remove_repeats(
    docs: DataFrame, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``; a window is 13 consecutive ones of a row.
    Words covered by a window that also starts in a row with a smaller doc_id go;
    windows are judged on the input. Kept words are joined by one space. Null and
    empty texts have no words. Rows without doc_id stand behind all others, and
    rows that share one never remove each other. Other columns are ignored; an
    empty table gives none. ``buckets`` (by default from the size of the input
    files) sets how finely hashes and documents are dealt, ``block_bytes`` how many
    texts are packed together, ``hot_bytes`` from how much text on rows that share an
    id, or lack one, are dealt over several buckets; none changes the result.
    """
    n = buckets or max(MIN_BUCKETS, -(-text_bytes(docs) // BUCKET_BYTES))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = _pieces(source, n, hot_bytes)
    dealt = source.select(_owner_column(n, pieces).alias("bucket"), "doc_id", "text")

    anchors = source.mapInArrow(_pack_anchors(n, block_bytes), _PACKED)
    shared = anchors.groupBy("bucket").applyInArrow(_settle(n, pieces, both=True), _PACKED)
    windows = (
        dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_pack_windows(n), _PACKED)
    )
    repeats = windows.groupBy("bucket").applyInArrow(_settle(n, pieces, both=False), _PACKED)
    return (
        dealt.groupBy("bucket").cogroup(repeats.groupBy("bucket"))
        .applyInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
    )


def _anchor_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (word indexes) of anchors inside windows, and their hashes."""
    at = words.fits(GRAM) & (words.count[words.doc] >= WINDOW) & np.isin(words.place % PERIOD, COVER)
    at = np.flatnonzero(at)
    return at, words.grams(words.hashes(_SEEDS[0]), GRAM, _SEEDS[0])[at]


def _pack_anchors(buckets: int, block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, block_bytes):
            words = Words.of(texts)
            at, low = _anchor_hashes(words)
            yield from _folded(ids[words.doc[at]], low, np.zeros(0, np.uint64), buckets, both=True)

    return work


def _folded(docs: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int, both: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows of a block: one open entry per hash, and what is known without asking.

    Known are all documents of a hash that several have (``both``), else all but
    the smallest.
    """
    order = np.lexsort((docs, low))
    docs, low, high = docs[order], low[order], high[order] if len(high) else high
    first, several = _runs(docs, low, high)
    known = several if both else several & (docs != docs[first])
    once = _changed(docs, low, high)
    open_ = first == np.arange(len(first))
    lead = low >> np.uint64(1)
    yield from _packed(docs[open_], low[open_], high[open_] if len(high) else high, lead[open_], buckets, False)
    known &= once
    if known.any():
        yield from _packed(docs[known], low[known], high[:0], _doc_buckets(docs[known], low[known]), buckets, True)


def _doc_buckets(docs: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Known entries only pass through; they are dealt evenly."""
    return mixed(docs.view(np.uint64) ^ low) >> np.uint64(1)


def _changed(docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First entry of each document in each run of equal hashes."""
    out = np.ones(len(docs), bool)
    out[1:] = (docs[1:] != docs[:-1]) | (low[1:] != low[:-1])
    if len(high):
        out[1:] |= high[1:] != high[:-1]
    return out


def _runs(docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by hash and document: first entry of the run, and whether it has several documents."""
    n = len(docs)
    starts = np.ones(n, bool)
    starts[1:] = low[1:] != low[:-1]
    if len(high):
        starts[1:] |= high[1:] != high[:-1]
    at = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    last = np.append(at[1:], n) - 1
    return at[run] if n else run, (docs[at] != docs[last])[run] if n else starts


def _packed(docs, low, high, lead, buckets, known) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has entries, ordered by document so that ids pack well."""
    bucket = (lead % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((docs, bucket))
    bucket = bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at, len(bucket)).tolist()
    spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    docs, low = docs[order], low[order]
    high = [high[order][s].tobytes() for s in spans] if len(high) else [None] * len(spans)
    columns = [
        pa.array(bucket[at], pa.int32()), pa.array([known] * len(spans), pa.bool_()),
        pa.array([_squeezed(docs[s]) for s in spans], pa.binary()),
        pa.array([low[s].tobytes() for s in spans], pa.binary()), pa.array(high, pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "known", "docs", "low", "high"])


def _squeezed(docs: np.ndarray) -> bytes:
    """Sorted ids as compressed differences, byte by byte of equal weight."""
    steps = np.diff(docs, prepend=np.int64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = [_unsqueezed(x) for x in table.column("docs").to_pylist()]
    low, high = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), np.uint64) for c in ("low", "high"))
    return np.concatenate([np.zeros(0, np.int64), *docs]), low, high


def _pieces(source: DataFrame, buckets: int, hot_bytes: int) -> dict[int, int]:
    """Over how many buckets the texts of an id are dealt, where there are many under it."""
    size = F.sum(F.octet_length("text") + 16)
    rows = (
        source.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).agg(size.alias("bytes"), F.count(F.lit(1)).alias("n"))
        .where((F.col("bytes") > hot_bytes) & (F.col("n") > 1)).orderBy(F.desc("bytes"), "id").limit(MAX_HOT_IDS).collect()
    )
    return {r["id"]: min(-(-r["bytes"] // hot_bytes), buckets) for r in rows}


def _settle(buckets: int, pieces: dict[int, int], both: bool):
    """Tell documents which of their hashes others have too, or a smaller document has."""

    def work(table: pa.Table) -> pa.Table:
        known = table.column("known").combine_chunks()
        docs, low, high = _entries(table.filter(pc.invert(known)))
        order = np.lexsort((docs, high, low)) if len(high) else np.lexsort((docs, low))
        docs, low, high = docs[order], low[order], high[order] if len(high) else high
        first, several = _runs(docs, low, high)
        tell = several if both else docs != docs[first]
        more, more_low, _ = _entries(table.filter(known))
        docs, low = np.concatenate([docs[tell], more]), np.concatenate([low[tell], more_low])
        owner = _owner(docs, buckets)
        if pieces:
            # What an id is told goes to each of its buckets.
            times = np.ones(len(docs), np.int64)
            for hot, n in pieces.items():
                times[docs == hot] = n
            docs, low, owner = (np.repeat(x, times) for x in (docs, low, owner))
            owner += (np.arange(len(docs)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        return pa.Table.from_batches(_packed(docs, low, low[:0], owner, buckets, True))

    return work


def _owner(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document, as ``_owner_column`` has it."""
    return (xxhash64(docs).view(np.int64) % buckets).astype(np.uint64)


def _owner_column(buckets: int, pieces: dict[int, int]) -> Column:
    """Bucket of a row: that of its id or, of several, one by its text and where it was read."""
    key = F.coalesce("doc_id", F.lit(NO_ID))
    owner = F.pmod(F.xxhash64(key), F.lit(buckets))
    if pieces:
        many = F.create_map(*[F.lit(x).cast("long") for pair in pieces.items() for x in pair])
        owner = F.pmod(owner + F.pmod(F.xxhash64("text", F.spark_partition_id()), F.coalesce(F.element_at(many, key), F.lit(1))), F.lit(buckets))
    return owner.cast("int")


def _members(words: Words, ids: np.ndarray, at: np.ndarray, low: np.ndarray, told: pa.Table) -> np.ndarray:
    """Which of the hashes ``low`` at places ``at`` were told to their documents."""
    docs, hashes, _ = _entries(told)
    tag = lambda d, h: mixed(d.view(np.uint64)) ^ h
    return np.isin(tag(ids[words.doc[at]], low), tag(docs, hashes))


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    return ids, encoded(table.column("text"))


def _pack_windows(buckets: int):
    """Hashes of all windows around anchors that other documents have."""

    def work(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        words = Words.of(texts)
        at, low = _anchor_hashes(words)
        at = at[_members(words, ids, at, low, told)]
        # Windows that start up to PERIOD - 1 words before an anchor hold it.
        near = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(near, np.maximum(at - (PERIOD - 1), at - words.place[at]), 1)
        np.add.at(near, at + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & words.fits(WINDOW))
        low, high = (_window_hashes(words, seed)[at] for seed in _SEEDS)
        return pa.Table.from_batches(_folded(ids[words.doc[at]], low, high, buckets, both=False))

    return work


def _window_hashes(words: Words, seed: int) -> np.ndarray:
    return words.grams(words.hashes(seed), WINDOW, seed)


def _cut(docs: pa.Table, told: pa.Table) -> pa.Table:
    ids, texts = _texts(docs)
    words = Words.of(texts)
    at = np.flatnonzero(words.fits(WINDOW))
    at = at[_members(words, ids, at, _window_hashes(words, _SEEDS[0])[at], told)]
    edge = np.zeros(len(words.doc) + WINDOW + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    gone = np.cumsum(edge)[: len(words.doc)] > 0
    removed = np.bincount(words.doc[gone], minlength=len(texts))[: len(texts)]
    ends = np.cumsum(words.count)
    kept = []
    for i, text in enumerate(texts):
        parts = text.split()
        if removed[i]:
            stays = np.flatnonzero(~gone[ends[i] - words.count[i] : ends[i]])
            parts = [parts[k] for k in stays.tolist()]
        kept.append(b" ".join(parts))
    return pa.table({
        "doc_id": docs.column("doc_id"),
        "n_words": pa.array(words.count, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })
