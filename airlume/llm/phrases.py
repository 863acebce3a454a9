"""Phrase collocations: words that stand together far more often than apart.

First pass: every block of text sends the hashed n-grams it has, with their counts, to
the summaries of their hash partitions. A Misra-Gries summary keeps at most so many
counters; when it holds more, all of them are lowered until enough reach zero. What is
taken from any counter in all stays below the threshold, so every n-gram that occurs
often enough keeps a counter. Survivors are marked in a bit filter of fixed size.
Second pass: n-grams that the filter lets through are counted exactly, as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.llm.textblocks import Words, encoded, mixed, slices, word_codes
from airlume.operators.skew import salted_join
from airlume.session import materialize

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
# Name of the part of documents without lang.
NO_LANG = "und"
# Bytes of text whose n-grams are folded together; longer texts are cut between pieces.
BLOCK_BYTES = 4 << 20
# Bits of a hashed n-gram and of the filter of survivors (16 MB). Two n-grams that share
# a hash or a bit only cost an exact count in vain.
KEY_BITS = 48
FILTER_BITS = 27
# n-grams for one summary at most, until there are MAX_BUCKETS of them.
BUCKET_MASS = 1 << 24
MIN_BUCKETS, MAX_BUCKETS = 32, 1 << 16
# Entries added to a summary at a time, and exact counts that a task holds before it sends them.
FOLD_ENTRIES = 1 << 20
HELD_ENTRIES = 1 << 18
_lists = "lang array<string>, phrase array<string>, words array<int>, count array<long>"
# Pieces a language's candidates are dealt over to be ranked.
RANK_PIECES = 64

_SEED = 23
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Ends of pieces, and blanks between words: fixed values.
_ENDS = b".,;:!?\n\v\f\r"
_BLANKS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_ENDS)] = 2


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP,
    block_bytes: int = BLOCK_BYTES, bucket_mass: int = BUCKET_MASS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and k of the best phrases of every lang.

    ``docs`` has text and lang; other columns are ignored. A-Z are lower-cased, texts
    end in pieces at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``. Candidates have
    2 to MAX_WORDS words of one piece and occur a >= ``min_count`` times in their lang,
    overlaps included. Cut after k words, the first part occurs l and the rest r times;
    score is floor(1000 a n / (l r)) with n words in the lang, at the cut where it is
    lowest, then k smallest. A candidate inside a longer one that occurs as often goes.
    The first ``top`` by score, a (both descending) and phrase (bytes) stay. A null lang
    counts as ``und``, a null text as empty; repeated rows count each; an empty table
    gives none. ``block_bytes`` and ``bucket_mass`` change no result.
    """
    counts = materialize(exact_counts(docs, min_count, block_bytes, bucket_mass), "phrase-counts")
    totals = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    parts = counts.where("words > 0").select("lang", "phrase", "count")
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"))
    best = _scored(_outermost(found), parts, totals)
    return _ranked(best, top)


def exact_counts(docs: DataFrame, min_count: int, block_bytes: int, bucket_mass: int) -> DataFrame:
    """lang, phrase, words and count of all n-grams of 1 to MAX_WORDS words that occur often enough.

    The row of a lang with words 0 and an empty phrase has the number of its words.
    """
    source = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    # Every word takes a byte and all but the last a separator.
    words = source.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0
    mass = int(words) * MAX_WORDS
    buckets = 1 << (min(max(-(-mass // bucket_mass), MIN_BUCKETS), MAX_BUCKETS) - 1).bit_length()
    capacity = mass // buckets // min_count + 1
    packed = source.mapInArrow(_pack(buckets, block_bytes), "bucket int, keys binary, counts binary")
    survivors = packed.groupBy("bucket").applyInArrow(_summary(buckets, capacity, min_count), "bucket int, bits binary")
    marks = np.zeros((buckets, (1 << FILTER_BITS) // buckets // 8), np.uint8)
    for bucket, bits in _pairs(survivors.toArrow()):  # FILTER_BITS in all, whatever the corpus
        marks[bucket] = np.frombuffer(zstandard.decompress(bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks.ravel())
    told = source.mapInArrow(_count(shared, buckets, block_bytes), f"bucket int, {_lists}")
    return told.groupBy("bucket").applyInArrow(_sums(min_count), "lang string, phrase string, words int, count long")


def _pairs(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """(langs, lower-cased texts) of about ``block_bytes`` at most from batches of (lang, text)."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
            for part in _cut(text.translate(_LOWER), block_bytes):
                if held and held + len(part) > block_bytes:
                    yield langs, texts
                    langs, texts, held = [], [], 0
                langs.append(lang)
                texts.append(part)
                held += len(part) + 1
    if texts:
        yield langs, texts


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts, cut at ends of pieces only; a piece is never cut."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(x, at, at + size) for x in _each(_ENDS))
        if end < 0:
            end = min((p for x in _each(_ENDS) if (p := text.find(x, at + size)) >= 0), default=-1)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _each(data: bytes) -> list[bytes]:
    return [data[i : i + 1] for i in range(len(data))]


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of the texts, with pieces in place of texts, and the text of each word."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KIND[data]
    edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    ends = np.searchsorted(np.flatnonzero(kind == 2), start)
    piece = np.cumsum(np.diff(ends, prepend=-1) > 0) - 1
    count = np.bincount(piece)
    place = np.arange(len(start)) - (np.cumsum(count) - count)[piece]
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    return Words(data, start, end, piece, place, count), np.searchsorted(first, start, "right") - 1


def _keys(words: Words, lang: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the n-gram from each word on, with its lang; meaningless where it does not fit."""
    return mixed(words.grams(hashes, size, _SEED) + lang + np.uint64(size)) >> np.uint64(64 - KEY_BITS)


def _lang_hashes(langs: list[str], text: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[text]


def _pack(buckets: int, block_bytes: int):
    """Distinct n-grams of each block with their counts, one row per bucket."""
    width = KEY_BITS - (buckets.bit_length() - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches, block_bytes):
            words, text = _words(texts)
            if not len(text):
                continue
            lang, hashes = _lang_hashes(langs, text), words.hashes(_SEED)
            keys = np.concatenate([_keys(words, lang, hashes, k)[words.fits(k)] for k in range(1, MAX_WORDS + 1)])
            keys, counts = _folded(keys, np.ones(len(keys), np.int64))
            bucket = (keys >> np.uint64(width)).astype(np.int32)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            spans = [slice(a, b) for a, b in zip(at, [*at[1:], len(keys)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[at], pa.int32()),
                    pa.array([_squeezed(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                    pa.array([_squeezed(counts[s]) for s in spans], pa.binary()),
                ],
                names=["bucket", "keys", "counts"],
            )

    return work


def _folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def _squeezed(values: np.ndarray) -> bytes:
    """64-bit values, compressed byte by byte of equal weight."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


class Summary:
    """Misra-Gries summary of weighted keys; any two can be merged by adding one to the other.

    After any number of additions a counter is at most ``lost`` below the true sum of
    its key, and keys without a counter have at most ``lost``. ``lost`` stays below
    ``min_count``: where ``capacity`` counters would not do, more are kept.
    """

    def __init__(self, capacity: int, min_count: int) -> None:
        self.capacity, self.min_count, self.lost = capacity, min_count, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _folded(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        spare = len(self.keys) - self.capacity
        if spare > 0:
            # The largest counter beyond the capacity sinks to zero.
            cut = min(int(np.partition(self.counts, spare - 1)[spare - 1]), self.min_count - 1 - self.lost)
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut
            self.lost += cut

    def survivors(self) -> np.ndarray:
        """Keys that may occur ``min_count`` times, among them all that do."""
        return self.keys[self.counts + self.lost >= self.min_count]


def _summary(buckets: int, capacity: int, min_count: int):
    """Bits of the survivors of a bucket, from its packed rows, a few at a time."""
    share = (1 << FILTER_BITS) // buckets
    shift = np.uint64(KEY_BITS - FILTER_BITS)

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity, min_count)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> None:
            if held:
                summary.add(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held.clear()

        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                held.append((np.cumsum(_unsqueezed(keys.as_py())), _unsqueezed(counts.as_py()).view(np.int64)))
                size += len(held[-1][0])
                if size >= FOLD_ENTRIES:
                    fold()
                    size = 0
        fold()
        bits = np.zeros(share, bool)
        bits[(summary.survivors() >> shift).astype(np.int64) % share] = True
        packed = zstandard.compress(np.packbits(bits).tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "bits"]
        )

    return work


def _count(shared, buckets: int, block_bytes: int):
    """Exact counts of the n-grams that the filter lets through, folded over the blocks of a task as far as they fit.

    n-grams are told apart by the numbers of their words, not by hashes. One can only
    be frequent if what it has left without its last word is, and that word too.
    """
    shift = np.uint64(KEY_BITS - FILTER_BITS)
    width = np.uint64(KEY_BITS - (buckets.bit_length() - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        held: pa.Table | None = None

        def passes(keys: np.ndarray) -> np.ndarray:
            bit = (keys >> shift).astype(np.int64)
            return (marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1

        for langs, texts in _blocks(batches, block_bytes):
            words, text = _words(texts)
            if not len(text):
                continue
            names, part = np.unique(np.array(langs, object), return_inverse=True)
            part = part[text]
            present, n = np.unique(part, return_counts=True)
            # The words of each lang come first, as its empty phrase.
            found = [(np.zeros(len(present), np.int64), present, [""] * len(present), 0, n)]
            lang, hashes = _lang_hashes(langs, text), words.hashes(_SEED)
            code, vocabulary = word_codes(words)
            at = np.arange(len(code))
            shorter = part  # number of the n-gram one shorter from each word on
            lone = np.zeros(len(code), bool)
            for k in range(1, MAX_WORDS + 1):
                at = at[words.fits(k)[at]]
                if k > 1:
                    at = at[lone[at + k - 1]]
                keys = _keys(words, lang, hashes, k)
                at = at[passes(keys[at])]
                if not len(at):
                    break
                if k == 1:
                    lone[at] = True
                _, first, number, n = np.unique(
                    shorter[at] * len(vocabulary) + code[at + k - 1], return_index=True, return_inverse=True, return_counts=True
                )
                first = at[first]
                phrases = [" ".join(x) for x in zip(*[vocabulary.take(pa.array(code[first + j])).to_pylist() for j in range(k)], strict=True)]
                found.append(((keys[first] >> width).astype(np.int64), part[first], phrases, k, n))
                shorter = np.full(len(code), -1, np.int64)
                shorter[at] = number
            held = _added(held, names, found)
            if len(held) > HELD_ENTRIES:
                yield _by_bucket(held)
                held = None
        if held:
            yield _by_bucket(held)

    return work


_PHRASE = ["lang", "phrase", "words"]


def _added(held: pa.Table | None, names: np.ndarray, found: list[tuple]) -> pa.Table:
    """Counts so far with those of a block: (bucket, part, phrases, words, n) of each length."""
    part = np.concatenate([p for _, p, *_ in found])
    block = pa.table({
        "bucket": pa.array(np.concatenate([b for b, *_ in found]).astype(np.int32)),
        "lang": pa.array(names.tolist(), pa.string()).take(pa.array(part)),
        "phrase": pa.array([x for f in found for x in f[2]], pa.string()),
        "words": pa.array(np.concatenate([np.full(len(f[4]), f[3], np.int32) for f in found])),
        "count": pa.array(np.concatenate([f[4] for f in found]).astype(np.int64)),
    })
    return _summed(pa.concat_tables([held, block]), ["bucket", *_PHRASE]) if held else block


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.group_by(keys).aggregate([("count", "sum")]).select([*keys, "count_sum"]).rename_columns([*keys, "count"])


def _by_bucket(held: pa.Table) -> pa.RecordBatch:
    """The counts as one row per bucket."""
    held = held.sort_by("bucket").combine_chunks()
    bucket = held.column("bucket").to_numpy()
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    offsets = pa.array([*at, len(bucket)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(held.column(c).chunks)) for c in [*_PHRASE, "count"]]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), *lists], names=["bucket", *_PHRASE, "count"])


def _sums(min_count: int):
    """Counts of a bucket over all blocks; those below the threshold go."""
    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches):
            part = pa.table({c: batch.column(c).flatten() for c in [*_PHRASE, "count"]})
            held = _summed(pa.concat_tables([held, part]) if held else part, _PHRASE)
        often = pc.or_(pc.greater_equal(held.column("count"), min_count), pc.equal(held.column("words"), 0))
        yield from held.filter(often).to_batches()

    return work


def _part(start: Column | int, length: Column | int) -> Column:
    """Words of the phrase from the ``start``-th on, as text."""
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def _outermost(found: DataFrame) -> DataFrame:
    """Candidates that no longer candidate contains as often as they occur.

    It is enough to look at those one word longer: counts never rise with length, so
    whatever lies between two candidates of equal count has that count too.
    """
    longer = found.where("words > 2").select(
        "lang", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"), "a"
    ).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    return (
        found.join(longer.hint("merge"), ["lang", "phrase"], "left")
        .where(F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer")
    )


def _scored(found: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut."""
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"_left": _part(1, F.col("k")), "_right": _part(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = materialize(cuts, "phrase-cuts")
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = salted_join(cuts, parts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    cuts = salted_join(cuts, totals, ["lang"])
    # Counts of up to 13 and 15 digits; their products fit 38.
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", whole("a", 13) * whole("n", 15) * F.lit(1000).cast("decimal(4,0)"), whole("l", 15) * whole("r", 15))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")
    ).select("lang", "phrase", "a", "n", "_cut.*")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang: first of each of its pieces, then of those left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = scored.withColumn("_piece", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PIECES)))
    few = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("lang", "_piece").orderBy(*order))).where(F.col("_row") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))
