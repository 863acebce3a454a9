"""Which filter removes what: every order of the filters, and each one's Shapley share.

A document counts only by the set of filters it fails. From the counts of these sets
comes the removal game: v(S) documents fail some filter of coalition S. Everything
asked about an order is a difference of two values of the game, and the Shapley value
of a filter is the potential of all filters minus the potential without it, where

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|.

(Hart and Mas-Colell, Potential, value, and consistency, 1989.)
"""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.llm.textblocks import NO_ID
from airlume.operators.skew import salted_join
from airlume.session import materialize

FILTERS = "ABCDE"
#: The last filter looks at the whole table: a text that a smaller doc_id has too.
REPEATED = len(FILTERS) - 1
COALITIONS = 1 << len(FILTERS)
EVERY = COALITIONS - 1
#: Potentials are whole numbers after multiplying by this.
SCALE = lcm(*range(1, len(FILTERS) + 1))

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10


def text_failures(text: str, words: str) -> list[Column]:
    """Failure conditions of the filters on one text, in the order of FILTERS without the last."""
    n = F.size(words).cast("long")
    upper = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
        upper.cast("long") * 100 > F.length(text).cast("long") * MAX_UPPER_PERCENT,
        F.col(text).rlike("[#$%&*|]"),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of FILTERS, A the lowest) and the n, good and toxic of such documents.

    The one pass over the texts writes a narrow row per document, with the SHA-256 of
    its text standing for the text. The first holder of each text is the smallest id;
    documents join it by text and id, so a text that very many share is no hot key.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("_text"),
    ).withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures("_text", "_words"))), F.lit(0))
    facts = read.select(
        "doc_id", "part", fails.cast("int").alias("fails"), F.unhex(F.sha2("_text", 256)).alias("_sha"),
    )
    facts = materialize(facts, "audit-facts")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    # Rows without id have no label; they would all meet in one task of the join.
    told = salted_join(facts.where("doc_id is not null"), known, ["doc_id"], "left").unionByName(
        facts.where("doc_id is null"), allowMissingColumns=True
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = told.groupBy(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_sha", "part", "fails",
        flag(F.col("_good")).alias("_good"), flag(F.col("_toxic")).alias("_toxic"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    first = facts.groupBy("_sha").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("_id"))
    held = rows.join(first.withColumn("_first", F.lit(True)).hint("merge"), ["_sha", "_id"], "left")
    repeated = F.when(F.col("_first"), 0).otherwise(1 << REPEATED)
    return held.groupBy("part", (F.col("fails") + repeated).alias("fails")).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_good")).alias("good"),
        F.sum(F.col("_n") * F.col("_toxic")).alias("toxic"),
    )


def games(counts: DataFrame) -> DataFrame:
    """One row per part: n, and for each game an array of its value by coalition.

    ``removed``, ``good`` and ``toxic`` hold how many documents of each kind fail
    some filter of the coalition, ``potential`` SCALE times the potential of removed.
    """

    def values(column: str) -> Column:
        return F.array(*[
            F.coalesce(F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, F.col(column))), F.lit(0)) for s in range(COALITIONS)
        ])

    played = counts.groupBy("part").agg(
        F.sum("n").alias("n"), values("n").alias("removed"), values("good").alias("good"), values("toxic").alias("toxic")
    )
    return played.withColumn("potential", potential(F.col("removed")))


def potential(values: Column) -> Column:
    """SCALE times the potential of every coalition, in order of their bits.

    A coalition without one member has a smaller number, so it is known by then.
    """

    def next_one(known: Column, s: Column) -> Column:
        total = F.get(values, s) * SCALE
        for i in range(len(FILTERS)):
            total = total + F.when(s.bitwiseAND(1 << i) != 0, F.get(known, s - (1 << i))).otherwise(0)
        # whole by construction
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EVERY)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other
    columns are ignored. Filters, by the condition on which a text fails: A under 100
    words, B under 80 distinct ones in a hundred, C over 10 upper-case letters A-Z in a
    hundred code points, D one of ``#$%&*|``, E a row with a smaller doc_id has the same
    text. A part is a lang; null and empty make one part, named by the empty string.
    Null counts as an empty text, which fails A alone unless it is repeated. Rows
    without doc_id stand behind all others and have no labels; rows that share a
    doc_id and a text are no repeats of each other, and each counts. Several labels of
    a doc_id count as the largest. An empty table gives no parts.

    kept: documents left after the step; removed: removed by it; redundant: failing
    its filter but removed earlier; unique_fails: failing its filter only; good_lost
    and toxic_lost: removed by it with that label 1; shapley: removed by its filter in
    all orders together, at any step.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (
        games(failure_counts(docs, labels))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda c: sum((F.when(c.contains(x), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"_before": bits(before), "_own": bits(own)})
    after = F.col("_before") + F.col("_own")
    gain = lambda game: F.get(game, after) - F.get(game, F.col("_before"))
    without = lambda game: F.get(game, F.lit(EVERY)) - F.get(game, EVERY - F.col("_own"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("n") - F.get("removed", after)).alias("kept"),
        gain("removed").alias("removed"),
        (F.get("removed", F.col("_own")) - gain("removed")).alias("redundant"),
        without("removed").alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (without("potential") * (factorial(len(FILTERS)) // SCALE)).alias("shapley"),
    )
