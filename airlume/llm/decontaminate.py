"""Benchmark decontamination by winnowing, with DataFrame operations only.

Every window of 13 words holds SPAN hashes of GRAM words; the smallest of them is
kept, in documents and benchmark items alike. A shared window keeps the same hash
on both sides, so joining the kept hashes finds it, and comparing the words around
both places says how far the match reaches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.llm.tables import ascii_lower
from airlume.operators.skew import known_small
from airlume.session import materialize

WINDOW = 13
GRAM = 8
# Hashes in a window; also one more than the words a match can reach past its hash.
SPAN = WINDOW - GRAM + 1
SIDE = SPAN - 1
# Contaminated from this share of words on: n_hit * SHARE >= n_words.
SHARE = 20

# Separators: everything in ASCII but digits and letters, after lower-casing.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    filled = F.coalesce(text, F.lit(""))
    # Pure ASCII takes the fast built-in.
    lowered = F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(ascii_lower(filled))
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def word_count(text: Column) -> Column:
    """Number of ``words_of`` a text, which case does not change."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _ANY_CASE_SEPARATORS), "")).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _paired(values: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each value and the one ``by`` places on; the last ``by`` are of no use."""
    return F.zip_with(values, F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0))), join)


def _first(values: Column, n: Column) -> Column:
    return F.slice(values, 1, F.greatest(n, F.lit(0)))


def grams(words: Column) -> Column:
    """Hash of the GRAM words from each word on that has that many, by doubling."""

    def doubled(values: Column, size: int) -> Column:
        if size == GRAM:
            return _first(values, F.size(words) - GRAM + 1)
        return let(_paired(values, size, lambda a, b: F.xxhash64(a, b)), lambda v: doubled(v, 2 * size))

    return doubled(words, 1)


def whole_runs(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each word on that has that many."""
    n = F.size(words) - size
    each = F.transform(
        F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    )
    return F.when(n >= 0, each).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: Column) -> Column:
    """Smallest of the SPAN hashes from each hash on that has that many."""

    def reached(values: Column, cover: int) -> Column:
        if cover == SPAN:
            return _first(values, F.size(hashes) - SPAN + 1)
        step = min(cover, SPAN - cover)
        return let(_paired(values, step, lambda a, b: F.least(a, b)), lambda v: reached(v, cover + step))

    return reached(hashes, 1)


def _winnowed(hashes: Column) -> Column:
    """(place, hash) of the smallest hash of each run of SPAN hashes, ties included."""

    def keep(least: Column) -> Column:
        # The largest of the minima around a hash equals it where it is one of them.
        places = F.transform(hashes, lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
        around = lambda s: F.greatest(*[F.get(least, s["place"] - j) for j in range(SPAN)])
        return F.filter(places, lambda s: s["hash"] == around(s))

    return let(minima(hashes), keep)


def _prints(words: Column, short: list[int]) -> Column:
    """Distinct (hash, size) of a text: winnowed hashes, and all runs as long as a short item."""
    found = [(GRAM, let(grams(words), minima))] + [(-m, whole_runs(words, m)) for m in short]

    def sized(hashes: Column, size: int) -> Column:
        return F.transform(F.array_distinct(hashes), lambda h: F.struct(h.alias("hash"), F.lit(size).alias("size")))

    return F.concat(*[sized(h, size) for size, h in found])


def _anchors(words: Column, short: list[int]) -> Column:
    """(place, hash, size) of the same hashes. Sizes of short items are negative."""
    placed = lambda g: F.transform(g, lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    found = [(GRAM, let(grams(words), _winnowed))] + [(-m, let(whole_runs(words, m), placed)) for m in short]

    def sized(anchors: Column, size: int) -> Column:
        return F.transform(
            anchors, lambda s: F.struct(s["place"].alias("place"), s["hash"].alias("hash"), F.lit(size).alias("size"))
        )

    return F.concat(*[sized(a, size) for size, a in found])


def _context(words: Column, place: Column) -> Column:
    """Words from SIDE before the hash on, WINDOW + SIDE of them, null past the ends."""
    return F.array(*[F.get(words, place - SIDE + j) for j in range(WINDOW + SIDE)])


def _met_words(words: Column, met: Column, short: list[int]) -> Column:
    """(place, hash, size, ours) of the hashes in ``met``, with the words around each place."""

    def at(hashes: Column, size: int) -> Column:
        mine = F.transform(F.filter(met, lambda m: m["size"] == size), lambda m: m["hash"])
        placed = F.transform(hashes, lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
        found = let(mine, lambda mine: F.filter(placed, lambda s: F.array_contains(mine, s["hash"])))
        return F.transform(
            found,
            lambda s: F.struct(s["place"].alias("place"), s["hash"].alias("hash"), F.lit(size).alias("size"), _context(words, s["place"]).alias("ours")),
        )

    return F.concat(at(grams(words), GRAM), *[at(whole_runs(words, m), -m) for m in short])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit and items for each row of ``docs`` (doc_id, text).

    A window is 13 consecutive words of an item (item_id, text), or all its words
    if they are fewer; an item without words has none. A document word inside any
    occurrence of a window is hit. ``items`` are the ids of items with occurring
    windows, as sorted strings. Null texts have no words; items without id are
    left out; rows of ``docs`` without id, or sharing one, get their own results
    (``_version``, a hash of the text, tells them apart). Other columns are ignored. Without documents there are no rows, without items
    no hits.
    """
    items = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_words")
    ).distinct()
    items = materialize(items.where(F.size("_words") > 0), "benchmark-words")
    lengths = items.where(F.size("_words") < WINDOW).select(F.size("_words").alias("n")).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most 12 values

    whole = F.size("_words") < WINDOW
    item_anchors = F.when(
        whole, F.filter(_anchors(F.col("_words"), short), lambda s: s["size"] == -F.size("_words"))
    ).otherwise(F.filter(_anchors(F.col("_words"), []), lambda s: s["size"] == GRAM))
    marks = items.select("item", "_words", F.explode(item_anchors).alias("a")).select(
        F.col("a.hash").alias("_hash"), F.col("a.size").alias("_size"), "item",
        F.when(F.col("a.size") > 0, _context(F.col("_words"), F.col("a.place")))
        .otherwise(_context(F.col("_words"), F.lit(0))).alias("_theirs"),
    )
    marks = materialize(marks.distinct(), "benchmark-marks")
    prints = marks.select("_hash", "_size").distinct()

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64("text").alias("_version"),
    )
    met = (
        keyed.select("_id", "_version", words_of(F.col("text")).alias("_words"))
        .select("_id", "_version", F.explode(let(F.col("_words"), lambda w: _prints(w, short))).alias("a"))
        .select("_id", "_version", F.col("a.hash").alias("_hash"), F.col("a.size").alias("_size"))
    )
    # Written marks below the checked size are broadcast; larger ones meet by hash.
    prints = F.broadcast(prints) if known_small(marks) else prints.hint("merge")
    wanted = (
        met.join(prints, ["_hash", "_size"], "left_semi").groupBy("_id", "_version")
        .agg(F.collect_set(F.struct(F.col("_hash").alias("hash"), F.col("_size").alias("size"))).alias("_met"))
    )
    # Only texts that share a hash are looked at again, where they have it.
    around = (
        keyed.select("_id", "_version", "text").join(wanted.hint("merge"), ["_id", "_version"])
        .select("_id", "_version", words_of(F.col("text")).alias("_words"), "_met")
        .select("_id", "_version", F.explode(let(F.col("_words"), lambda w: _met_words(w, F.col("_met"), short))).alias("a"))
        .select("_id", "_version", F.col("a.place").alias("_place"), F.col("a.hash").alias("_hash"), F.col("a.size").alias("_size"), F.col("a.ours").alias("_ours"))
    )
    theirs = F.broadcast(marks) if known_small(marks) else marks.hint("merge")
    hits = _extended(around.join(theirs, ["_hash", "_size"])).groupBy("_id", "_version").agg(
        F.collect_set("_span").alias("_spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    hits = hits.select("_id", "_version", _covered(F.sort_array("_spans")).alias("n_hit"), "items")
    sized = keyed.select("doc_id", "_id", "_version", word_count(F.col("text")).alias("n_words"))
    return sized.join(hits, ["_id", "_version"], "left").select(
        "doc_id", "_version", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _extended(pairs: DataFrame) -> DataFrame:
    """Pairs of places whose words agree over a whole window, and the span they agree on."""
    same = [F.coalesce(F.get("_ours", F.lit(j)) == F.get("_theirs", F.lit(j)), F.lit(False)) for j in range(WINDOW + SIDE)]
    # Equal words from the hash's first word on, and before it.
    ahead = reduce(lambda rest, j: F.when(~same[SIDE + j], F.lit(j)).otherwise(rest), reversed(range(WINDOW)), F.lit(WINDOW))
    back = reduce(lambda rest, j: F.when(~same[SIDE - 1 - j], F.lit(j)).otherwise(rest), reversed(range(SIDE)), F.lit(SIDE))
    pairs = pairs.select("*", ahead.alias("_ahead"), back.alias("_back"))
    long = F.col("_size") > 0
    pairs = pairs.where(
        (long & (F.col("_ahead") >= GRAM) & (F.col("_ahead") + F.col("_back") >= WINDOW))
        | (~long & (F.col("_ahead") >= -F.col("_size")))
    )
    start = F.when(long, F.col("_place") - F.col("_back")).otherwise(F.col("_place"))
    end = F.when(long, F.col("_place") + F.col("_ahead")).otherwise(F.col("_place") - F.col("_size"))
    return pairs.select("_id", "_version", "item", F.struct(start.alias("start"), end.alias("end")).alias("_span"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        start, end = s["start"].cast("long"), s["end"].cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(start, acc["upto"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, zero, add)["n"]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in SHARE is hit."""
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = benchmark_hits(docs, benchmark).where(contaminated(F.col("n_hit"), F.col("n_words")))
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("_version").alias("_text_hash"))
    # The text is part of the key, so that rows without an id are told apart.
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")
