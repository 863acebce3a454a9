"""Byte-level BPE over overlapping chunks of text, and its inverse.

A text longer than one chunk is cut into chunks that overlap and are dealt over all
tasks. Each chunk is split into pre-tokens where it lies. A chunk that starts inside
a pre-token splits wrongly at first, but once it shares one boundary with the chunk
before it, both agree from there on, because the pattern never looks back. Only the
boundaries inside overlaps travel; they settle where each chunk hands over to the
next. The pieces between are encoded where their chunks lie, and their ids are joined
in order. Chunks that share no boundary are joined to one and split again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.llm.textblocks import slices
from airlume.session import materialize, shuffle_width

# Code points of a chunk and of the part it shares with the next one.
CHUNK = 16_384
OVERLAP = 512
# What the pattern may look at beyond the end of a pre-token, or its start, in code
# points: the longest contraction, and one character after white space.
LOOKAHEAD = 3
# Rows handed over together; texts are long.
ROWS = 128
# What a long text is known by, and the columns of its chunks.
KEY = ("row", "version")
_TEXT = "row long, version long, doc_id long"
_PART = f"{_TEXT}, start int, part string, size int, head array<int>, tail array<int>"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id, once per worker."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    """Encoder and compiled pattern, once per worker."""
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    # \s has a few control characters more in this library than in the encoder's.
    same = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return encoding, regex.compile(same)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs`` (doc_id, text).

    Ids are those of the rank file at ``path`` (present on every executor) with
    ``pattern`` splitting the whole text, without special tokens. Null counts as
    empty; an empty text has no ids. Rows without doc_id, or sharing one, are
    encoded each on its own. Other columns are ignored; an empty table gives none.
    """
    if not LOOKAHEAD < overlap < chunk:
        raise ValueError("need a chunk longer than its overlap")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    single = F.length("text") <= chunk
    whole = source.where(single).mapInArrow(_encode_whole(path, pattern), "doc_id long, ids array<int>")
    chunks = _chunks(source.where(~single), chunk, overlap)
    long = _pieces(chunks, path, pattern, overlap).mapInArrow(
        _encode_pieces(path, pattern), f"{_TEXT}, start int, ids array<int>"
    )
    in_order = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined = long.groupBy(*KEY, "doc_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
    return whole.unionByName(joined.select("doc_id", "ids"))


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of ``chunk`` code points, ``overlap`` of them shared, dealt over all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices([batch], 1):
                row, version, doc_id, text = (column[0].as_py() for column in one.columns)
                starts = range(0, len(text) - overlap, chunk - overlap)
                for a in range(0, len(starts), ROWS):
                    some = starts[a : a + ROWS]
                    yield _batch(
                        f"{_TEXT}, start int, part string",
                        [row] * len(some), [version] * len(some), [doc_id] * len(some),
                        list(some), [text[x : x + chunk] for x in some],
                    )

    # A number and a hash keep texts with equal ids apart while their chunks travel.
    numbered = long.select(
        F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("version"), "doc_id", "text"
    )
    parts = numbered.mapInArrow(work, f"{_TEXT}, start int, part string")
    # A stated width: small chunks cost much work each, so they are not to be coalesced.
    return parts.repartition(shuffle_width(long.sparkSession), *KEY, "start")


def _pieces(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """Chunks with the places ``begin`` and ``until`` between which each is encoded.

    Texts whose chunks all meet are settled; the others join the chunks that do not
    meet and are settled with these longer chunks, which only few texts need.
    """
    parts = materialize(chunks.mapInArrow(_edges(path, pattern, overlap), _PART), "bpe-chunks")
    found = None
    while True:
        seams = materialize(_seams(parts), "bpe-seams")
        placed = parts.drop("head", "tail").join(seams, [*KEY, "start"])
        settled = placed.where(~F.col("open")).drop("open", "run")
        found = settled if found is None else found.unionByName(settled)
        if seams.where("open").isEmpty():
            return found
        again = placed.where("open").groupBy(*KEY, "doc_id", "run")
        parts = materialize(again.applyInArrow(_join_run(path, pattern, overlap), _PART), "bpe-joined")


def _seams(parts: DataFrame) -> DataFrame:
    """Where each chunk begins and ends to count, from the boundaries in overlaps alone.

    ``open`` is true for a text with neighbours that do not meet, and ``run`` numbers
    the runs of such neighbours.
    """
    text = Window.partitionBy(*KEY)
    order = text.orderBy("start")
    following = F.lead("head").over(order)
    meets = parts.select(
        *KEY, "start", "size", F.array_min(F.array_intersect("tail", following)).alias("until"),
        following.isNull().alias("last"),
    ).withColumn("begin", F.lag("until").over(order))
    # Where overlaps are longer than half a chunk, a seam may lie before the one ahead of it.
    parted = ~F.col("last") & (F.col("until").isNull() | F.coalesce(F.col("until") < F.col("begin"), F.lit(False)))
    flagged = meets.withColumn("parted", parted)
    follows = F.coalesce(F.lag("parted").over(order), F.lit(False))
    return flagged.select(
        *KEY, "start",
        F.coalesce("begin", "start").alias("begin"),
        F.coalesce("until", F.col("start") + F.col("size")).alias("until"),
        F.max("parted").over(text).alias("open"),
        F.sum((~follows).cast("int")).over(order).alias("run"),
    )


def _encode_whole(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path, pattern)[0]
        for part in slices(batches, ROWS):
            yield _with_ids(part.column(0), [encoding.encode_ordinary(x) for x in part.column(1).to_pylist()])

    return work


def _with_ids(doc_id: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    arrays = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, arrays[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names)
    )


def _edges(path: str, pattern: str, overlap: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary(path, pattern)[1]
        for batch in slices(batches, ROWS):
            *key, starts, parts = (column.to_pylist() for column in batch.columns)
            marks = [edges(a, x, split, overlap) for a, x in zip(starts, parts, strict=True)]
            sizes = [len(x) for x in parts]
            yield _batch(_PART, *key, starts, parts, sizes, [x for x, _ in marks], [x for _, x in marks])

    return work


def _join_run(path: str, pattern: str, overlap: int):
    def work(run: pa.Table) -> pa.Table:
        split = vocabulary(path, pattern)[1]
        run = run.sort_by("start")
        start, part = joined(list(zip(run["start"].to_pylist(), run["part"].to_pylist(), strict=True)))
        head, tail = edges(start, part, split, overlap)
        key = [run[x].to_pylist()[:1] for x in (*KEY, "doc_id")]
        return pa.Table.from_batches([_batch(_PART, *key, [start], [part], [len(part)], [head], [tail])])

    return work


def _encode_pieces(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path, pattern)[0]
        for batch in slices(batches, ROWS):
            get = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            spans = zip(get("part"), get("start"), get("begin"), get("until"), strict=True)
            ids = [encoding.encode_ordinary(x[b - a : c - a]) for x, a, b, c in spans]
            yield _batch(f"{_TEXT}, start int, ids array<int>", *map(get, (*KEY, "doc_id", "start")), ids)

    return work


def boundaries(text: str, split: regex.Pattern) -> list[int]:
    """Starts of the pre-tokens of ``text``."""
    return [m.start() for m in split.finditer(text)]


def edges(start: int, part: str, split: regex.Pattern, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries in the first and in the last ``overlap`` of a chunk, as places of the whole text.

    Of the last ones only those that the chunk is sure of and that do not follow white
    space: at the end of a piece such a run would be taken whole, while before a word
    its last character stands alone.
    """
    cuts = boundaries(part, split)
    sure = cuts[bisect_left(cuts, len(part) - overlap) : bisect_right(cuts, len(part) - LOOKAHEAD)]
    tail = [start + x for x in sure if not (x and part[x - 1].isspace())]
    return [start + x for x in cuts[: bisect_left(cuts, overlap)]], tail


def joined(chunks: list[tuple[int, str]]) -> tuple[int, str]:
    """One chunk from several (start, part), each overlapping the next."""
    ends = [b for b, _ in chunks[1:]]
    own = [x[: b - a] for (a, x), b in zip(chunks, ends)]
    return chunks[0][0], "".join([*own, chunks[-1][1]])


def pieces(chunks: list[tuple[int, str]], split: regex.Pattern) -> Iterator[str]:
    """The pieces of one text whose chunks are at hand, by the steps of ``encode``.

    ``chunks`` are (start, part) in order, each overlapping the next.
    """
    while True:
        runs, seams = [[chunks[0]]], [chunks[0][0]]
        for (a, x), (b, y) in pairwise(chunks):
            overlap = a + len(x) - b
            shared = set(edges(a, x, split, overlap)[1]) & set(edges(b, y, split, overlap)[0])
            meet = min(shared, default=-1)
            if meet < seams[-1]:
                runs[-1].append((b, y))
            else:
                runs.append([(b, y)])
                seams.append(meet)
        if len(runs) == len(chunks):
            break
        chunks = [joined(x) for x in runs]
    ends = [*seams[1:], chunks[-1][0] + len(chunks[-1][1])]
    for (a, x), begin, until in zip(chunks, seams, ends, strict=True):
        yield x[begin - a : until - a]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``data``: the bytes of its ids one after another.

    Null ids decode to no bytes; an id that the vocabulary lacks is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for part in slices(batches, ROWS):
            data = [b"".join(map(table.__getitem__, x)) if x else b"" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, data binary")


def decimal_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
