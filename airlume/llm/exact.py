"""Exact duplicates: 128-bit content hash, then bytes within each hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the group of equal texts it is in.

    Texts are equal if ``normalized`` makes them so. Of a group the row with the
    most code points stays, then the smallest doc_id; a row without an id stays
    only where no row as long has one, and keep_id is then null. Rows that share
    an id stay or go together. Returns doc_id, keep_id, group_size, kept and
    text_sha256; other columns of ``docs`` are ignored, an empty table gives none.

    The hash is the leading grouping key and the bytes are the next, so a group
    never holds two texts that merely share a hash. Equal texts fold inside each
    task before the exchange, so a group of any size costs one row per task. No
    text takes part in the second join.
    """
    text = normalized(F.col("text"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).alias("_points"),
        text.alias("_text"),
    ).withColumn("_hash", hash_of(F.col("_text")))
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id"))
    classes = (
        base.groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "group_size", F.col("_best.doc_id").alias("keep_id"))
    )
    rows = base.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    # AQE splits the rows of a hot group over tasks; the other side has one row for it.
    return rows.join(classes.hint("merge"), ["_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_groups(docs).where("not kept").select(
        F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")
    )
    # The text is part of the key, so that rows without an id are told apart.
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.sha2(normalized(docs["text"]), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")
