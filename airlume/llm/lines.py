"""Repeated runs of lines, found by winnowing over line hashes with DataFrame operations.

Of every window of lines that counts as a run the smallest hash is kept. A run that
repeats keeps the same one at both places, so only kept hashes that occur more than
once are looked at; from each the match is extended both ways to the runs around it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.llm.decontaminate import let
from airlume.llm.textblocks import NO_ID
from airlume.operators.skew import HOT_ROWS, salted_join
from airlume.session import materialize

# Lines of a run; fewer count too if they have so many words together.
RUN = 3
WORDS = 13


def numbered_lines(text: Column) -> Column:
    """(at, line) of the lines of a text that are not blank; null has none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(lines, lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"))


def remove_repeated_runs(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row of ``docs`` (doc_id, text).

    Lines end at "\\n"; blank ones are never part of a run and always stay. A run is
    RUN consecutive other lines of a row, or one or two with WORDS words or more. All
    lines of a row that has fewer than RUN of them, and fewer words, are a run too,
    equal to those of other such rows only. Lines of a run that also starts earlier,
    in a row with a smaller doc_id or further up in the same row, go; runs are
    judged on the input. Rows without doc_id stand behind all others; rows that
    share one are ordered by a hash of their texts, and whole repeats of a row stand
    at the same place and keep each other. Null and empty texts have no lines. Other
    columns are ignored; an empty table gives none. A line in more than ``hot_rows``
    places is dealt over several tasks, which changes no result.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_version"),
    )
    marks = (
        keyed.select("_id", "_version", F.transform(numbered_lines(F.col("text")), _hashed).alias("_lines"))
        .select("_id", "_version", F.explode(let(F.col("_lines"), _kept)).alias("m"))
        .select("_id", "_version", "m.*")
    )
    often = materialize(marks.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "line-hashes")
    shared = salted_join(marks, often.select("_hash"), ["_hash"], "left_semi", hot_rows, often)
    # Runs that hold the kept hash, each as its line hashes.
    names = ["size", "check", *[f"h{j}" for j in range(RUN)]]
    runs = shared.select("_id", "_version", F.explode(F.filter(_around(), lambda r: r["size"] > 0)).alias("r")).select("_id", "_version", "r.*")
    runs = materialize(runs, "line-runs")
    place = F.struct("_id", "_version", "start")
    first = runs.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    repeated = materialize(first.where("_first <> _last").select(*names, "_first", "_rows"), "line-repeats")
    later = salted_join(runs, repeated.drop("_rows"), names, "inner", hot_rows, repeated).where(place != F.col("_first"))
    # A run's size is told by its lines, so whole rows count as long as they are.
    lines = F.when(F.col("size") > RUN, F.col("size") - RUN).otherwise(F.col("size"))
    gone = later.groupBy("_id", "_version").agg(F.collect_set(F.struct("start", lines.alias("size"))).alias("_runs"))
    return (
        keyed.join(gone.hint("merge"), ["_id", "_version"], "left")
        .select("doc_id", "text", numbered_lines(F.col("text")).alias("_lines"), _removed(F.col("_runs")).alias("_gone"))
        .select(
            "doc_id", F.size("_lines").cast("long").alias("n_lines"),
            F.size("_gone").cast("long").alias("n_removed"),
            F.when(F.size("_gone") == 0, F.col("text")).otherwise(_rest()).alias("kept_text"),
        )
    )


def _hashed(line: Column) -> Column:
    """Two hashes of a line and the number of its words."""
    words = F.filter(F.split(line["line"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.struct(F.xxhash64(line["line"]).alias("h"), F.xxhash64(F.lit(RUN), line["line"]).alias("g"), F.size(words).alias("w"))


def _is_run(words: list[Column], whole: Column) -> Column:
    """Whether lines with so many words, all that their row has if ``whole``, are a run; null past the ends of a row."""
    total = reduce(lambda a, b: a + b, words)
    return total.isNotNull() if len(words) == RUN else total.isNotNull() & ((total >= WORDS) | whole)


def _kept(lines: Column) -> Column:
    """(place, _hash, around, alone) of the smallest hash of each run, ties included.

    ``around`` holds the RUN - 1 lines before it, itself and as many after it; ``alone``
    says that the row has fewer than RUN lines.
    """
    n = F.size(lines)

    def chosen(i: Column) -> Column:
        holds = []
        for size in range(1, RUN + 1):
            for k in range(size):
                at = [F.get(lines, i - k + j) for j in range(size)]
                least = F.least(*[x["h"] for x in at]) if size > 1 else at[0]["h"]
                holds.append(_is_run([x["w"] for x in at], n == size) & (least == at[k]["h"]))
        return F.coalesce(reduce(or_, holds), F.lit(False))

    reach = range(-RUN + 1, RUN)
    return F.transform(
        F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), chosen),
        lambda i: F.struct(
            i.alias("place"), F.get(lines, i)["h"].alias("_hash"),
            F.array(*[F.get(lines, i + k) for k in reach]).alias("around"), (n < RUN).alias("alone"),
        ),
    )


def _around() -> Column:
    """(start, size, check, h0...) of the runs that hold a kept hash, size 0 where lines are none.

    Sizes above RUN are those of whole rows with few words, plus RUN.
    """
    runs = []
    for size in range(1, RUN + 1):
        for k in range(size):
            at = [F.get("around", F.lit(RUN - 1 - k + j)) for j in range(size)]
            words = reduce(lambda a, b: a + b, [x["w"] for x in at])
            # no line before or after these
            ends = [F.get("around", F.lit(p)) for p in (RUN - 2 - k, RUN - 1 - k + size) if 0 <= p < 2 * RUN - 1]
            whole = F.col("alone") & reduce(lambda a, b: a & b, [x.isNull() for x in ends], F.lit(True))
            is_run = _is_run([x["w"] for x in at], whole)
            few = whole & (words < WORDS)
            runs.append(F.struct(
                (F.col("place") - k).alias("start"),
                F.when(is_run & few, size + RUN).when(is_run, size).otherwise(0).alias("size"),
                at[0]["g"].alias("check"),
                *[(at[j]["h"] if j < size else F.lit(0).cast("long")).alias(f"h{j}") for j in range(RUN)],
            ))
    return F.array(*runs)


def _removed(runs: Column) -> Column:
    """Places of lines in ``runs`` (start, size)."""
    none = F.array().cast("array<struct<start:int,size:int>>")
    spread = F.flatten(F.transform(F.coalesce(runs, none), lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    return F.array_distinct(spread)


def _rest() -> Column:
    """The text without the lines at places ``_gone`` among those in ``_lines``."""
    gone_at = F.transform("_gone", lambda g: F.get("_lines", g)["at"])
    every = F.transform(F.split("text", "\n"), lambda line, i: i)
    stays = F.array_except(every, gone_at)
    return let(F.split(F.col("text"), "\n"), lambda lines: F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n"))
