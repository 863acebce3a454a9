"""Secret scanning with corpus-wide ownership frequency.

Fixed patterns give the base spans. The method adds candidates, long mixed strings
outside those patterns, and judges them by who has them: a string that many
repositories or owners share, or many different texts of one owner, is a widely
copied example, one that stays with few is a live-looking credential of its owner
and is added. A copy of a whole text is not one more holder. Base spans always stay
and carry the same judgement.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from airlume.operators.skew import salted_join
from airlume.session import materialize

# Base patterns: fixed values. The order is the order of kinds.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN = 6
MIN_ACCESS = 20

# Candidates: this many characters with a digit and letters of both cases.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
# A string that more repositories, or more owners, have is a copied example.
MAX_REPOSITORIES = 2
MAX_OWNERS = 1
# So is one that more different texts of an owner have, or that more owners have at
# all, copies of whole texts included.
MAX_TEXTS = 10
MAX_COPYING_OWNERS = 5
ROWS = 256

_SPAN = "struct<start:int,end:int,kind:int,value:bigint>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, secret), by start, then kind."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: s[:3])


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """Mixed strings that touch no base span."""
    ends: list[int] = []
    for _, end, _, _ in base:
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [s[0] for s in base]
    for m in CANDIDATE.finditer(text):
        k = bisect_right(starts, m.end() - 1)
        if k and ends[k - 1] > m.start():
            continue
        value = m[0]
        if any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value:
            yield m.start(), m.end(), 3, value


def find_secrets(
    docs: DataFrame, repository: Column | None = None, owner: Column | None = None,
    max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS,
    max_texts: int = MAX_TEXTS, max_copying_owners: int = MAX_COPYING_OWNERS,
) -> DataFrame:
    """doc_id and spans (start, end, kind, live) of every row of ``docs`` (doc_id, text).

    Spans count code points of the whole text, the end exclusive; null counts as
    empty. ``repository`` and ``owner`` are expressions over ``docs`` (by default
    source with lang, and source); a null one counts as one more unnamed. ``live``
    says that at most ``max_repositories`` repositories and ``max_owners`` owners
    have the string, each owner in at most ``max_texts`` different texts. Equal texts
    count once for that, for the owner who has the string in most texts (ties: the
    larger hash); all their owners may be ``max_copying_owners``, or ``max_owners``
    if that is more. Base spans are all there, candidates only if live. Repeated
    rows, rows that share a doc_id and rows without one are scanned each on its
    own. Other columns are ignored; an empty table gives none.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(repository).alias("repository"), F.xxhash64(owner).alias("owner"), F.xxhash64("text").alias("content"),
    )
    schema = f"doc_id long, row string, repository long, owner long, content long, found array<{_SPAN}>"
    scanned = materialize(source.mapInArrow(_scan, schema), "secret-scan")
    each = scanned.select("doc_id", "row", "repository", "owner", "content", F.explode("found").alias("s")).select(
        "doc_id", "row", "repository", "owner", "content", F.col("s.value").alias("value"), "s"
    )
    # Copies fold inside each task before the exchange; then owners are counted.
    holders = materialize(each.select("value", "content", "repository", "owner").distinct(), "secret-holders")
    live = _live(holders, max_repositories, max_owners, max_texts, max_copying_owners)
    live = materialize(live.select("value", F.lit(True).alias("_live")), "secret-owners")
    judged = salted_join(each, live, ["value"], "left").select(
        "row",
        F.struct(
            F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"),
            F.coalesce("_live", F.lit(False)).alias("live"),
        ).alias("s"),
    )
    spans = judged.where("s.live or s.kind < 3").groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return scanned.select("doc_id", "row").join(spans, "row", "left").select(
        "doc_id",
        F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")).alias("spans"),
    )


def _live(holders: DataFrame, max_repositories: int, max_owners: int, max_texts: int, max_copying_owners: int) -> DataFrame:
    """The values of ``holders`` (value, content, repository, owner) that few hold."""
    spread = holders.groupBy("value").agg(
        F.countDistinct("content").alias("_texts"), F.countDistinct("owner").alias("_owners")
    )
    # What is left has a bounded number of texts and owners a value.
    narrow = spread.where(
        (F.col("_texts") <= max_texts * max_owners) & (F.col("_owners") <= max(max_copying_owners, max_owners))
    )
    few = materialize(salted_join(holders, materialize(narrow.select("value"), "secret-narrow"), ["value"]), "secret-few")
    for keys, name in ((["value", "owner"], "_of_owner"), (["value", "owner", "repository"], "_of_repository")):
        few = few.join(few.groupBy(*keys).agg(F.countDistinct("content").alias(name)), keys)
    # A text belongs to the holder with most texts, its other holders have copies.
    home = few.groupBy("value", "content").agg(F.max(F.struct("_of_owner", "owner", "_of_repository", "repository")).alias("home"))
    owners = home.groupBy("value", "home.owner").agg(
        F.count(F.lit(1)).alias("_texts"), F.collect_set("home.repository").alias("_repositories")
    )
    return owners.groupBy("value").agg(
        F.count(F.lit(1)).alias("_owners"), F.max("_texts").alias("_texts"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_repositories")))).alias("_repositories"),
    ).where((F.col("_repositories") <= max_repositories) & (F.col("_owners") <= max_owners) & (F.col("_texts") <= max_texts))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text. ``row`` is a name of its own for every row."""
    task, n = uuid4().hex, 0
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())])
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            found = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                every = [*base, *candidates(text, base)]
                # Signed, as a long; the secret itself goes no further.
                value = [xxh64_intdigest(s[3].encode()) - (1 << 63) for s in every]
                found.append([{"start": s[0], "end": s[1], "kind": s[2], "value": v} for s, v in zip(every, value, strict=True)])
            rows = [f"{task}-{n + i}" for i in range(part.num_rows)]
            n += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(rows), part.column(2), part.column(3), part.column(4), pa.array(found, pa.list_(span))],
                names=["doc_id", "row", "repository", "owner", "content", "found"],
            )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    one = lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
