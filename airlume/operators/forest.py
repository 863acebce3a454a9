"""Random forest whose trees are grown, kept and applied in tasks.

Every feature is cut at thresholds of all its values, so a row is a string of bytes. A tree
draws rows with replacement; a row's weight in it follows from the hash of its key. A node
with more rows than ``LOCAL_ROWS`` is split by sums over all tasks. The rows of a smaller one
meet in one task, which grows the rest of its branch level by level. Branches are rows of a
table, so neither the driver nor a task ever holds the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlume.operators.skew import salted_join
from airlume.session import materialize, shuffle_width

# Most drawn rows of a node that one task takes over.
LOCAL_ROWS = 50_000
# Distinct inputs that one task leads through a branch.
BLOCK_ROWS = 100_000
# Nodes whose sums one pass gathers.
NODES_A_PASS = 512
# Parts of the values, and of the distinct values, that thresholds lie between.
PARTS = 32
_BINS = 2 * PARTS
_BRANCH = "tree int, leaf int, nodes int, feature binary, bin binary, left binary, value binary"
_NAMES = ["tree", "leaf", "nodes", "feature", "bin", "left", "value"]


@dataclass
class Size:
    """How many nodes a tree has."""

    numNodes: int


@dataclass
class Forest:
    """Thresholds per feature, the split top of every tree, and a table with a row per branch below.

    ``tops``: per tree the splits (node, feature, bin, left child); the right child follows the left.
    """

    thresholds: list[np.ndarray]
    tops: list[list[tuple[int, int, int, int]]]
    branches: DataFrame

    @cached_property
    def trees(self) -> list[Size]:
        nodes = self.branches.groupBy("tree").agg(F.sum("nodes").alias("n")).orderBy("tree").collect()
        return [Size(r["n"] + len(self.tops[r["tree"]])) for r in nodes]

    def save(self, folder: str) -> None:
        spark = self.branches.sparkSession
        rows = [(i, [float(v) for v in t]) for i, t in enumerate(self.thresholds)]
        spark.createDataFrame(rows, "feature int, cuts array<double>").write.mode("overwrite").parquet(f"{folder}/thresholds")
        splits = [(t, [list(s) for s in top]) for t, top in enumerate(self.tops)]
        spark.createDataFrame(splits, "tree int, splits array<array<int>>").write.mode("overwrite").parquet(f"{folder}/tops")
        self.branches.write.mode("overwrite").parquet(f"{folder}/branches")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Forest:
        cuts = spark.read.parquet(f"{folder}/thresholds").orderBy("feature").collect()
        tops = spark.read.parquet(f"{folder}/tops").orderBy("tree").collect()
        return Forest(
            [np.array(r["cuts"]) for r in cuts], [[tuple(s) for s in r["splits"]] for r in tops],
            spark.read.parquet(f"{folder}/branches"),
        )

    def predict(self, df: DataFrame, name: str, features: str = "x") -> DataFrame:
        """``df`` with the mean of all trees as ``name``. Rows with the same input are led through once."""
        marked = df.withColumn("_bytes", _binned(self.thresholds)(vector_to_array(features)))
        inputs = materialize(marked.select("_bytes").distinct(), "forest-inputs")
        blocks = max(1, -(-inputs.count() // BLOCK_ROWS))
        tops, trees = self.tops, len(self.tops)

        def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _matrix(batch.column(0))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bins), t, "int32")), pa.array(_route(tops[t], bins)), batch.column(0)], ["tree", "leaf", "_bytes"]
                    )

        keys, width = ["tree", "leaf", "_block"], max(shuffle_width(df.sparkSession), trees)
        rows = inputs.mapInArrow(led, "tree int, leaf int, _bytes binary").withColumn(
            "_block", F.pmod(F.xxhash64("_bytes"), F.lit(blocks)).cast("int")
        )
        branches = self.branches.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = rows.repartition(width, *keys).groupBy(*keys).cogroup(branches.repartition(width, *keys).groupBy(*keys))
        values = met.applyInArrow(_lead, "_bytes binary, value double")
        # Sorted, so that the sum is the same in every run.
        total = F.aggregate(F.sort_array(F.collect_list("value")), F.lit(0.0), lambda a, v: a + v)
        means = materialize(values.groupBy("_bytes").agg((total / trees).alias(name)), "forest-values")
        return salted_join(marked, means, ["_bytes"]).drop("_bytes")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _binned(thresholds: list[np.ndarray]):
    """Function of an array: per value the number of thresholds below it, as bytes."""

    @F.pandas_udf(T.BinaryType())
    def bins(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        grid = np.stack(values.to_numpy())
        out = np.zeros(grid.shape, np.uint8)
        for i, cuts in enumerate(thresholds):
            out[:, i] = np.searchsorted(cuts, grid[:, i], "left")
        return pd.Series([row.tobytes() for row in out])

    return bins


def _thresholds(rows: DataFrame) -> list[np.ndarray]:
    """Per feature, values that cut its rows, and its distinct values, into parts of equal number.

    Distinct values count too, so that rare ones beside a frequent one can be told apart.
    """
    values = rows.select(F.posexplode(vector_to_array("x")).alias("i", "v"))
    at = [k / PARTS for k in range(1, PARTS)]

    def cuts(df: DataFrame) -> DataFrame:
        return df.groupBy("i").agg(F.percentile_approx("v", at, 10_000).alias("cuts"))

    found = cuts(values).unionByName(cuts(values.distinct())).groupBy("i")
    merged = found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))
    return [np.array(r["cuts"]) for r in merged.orderBy("i").collect()]


_STEPS = np.uint64(0x9E3779B97F4A7C15)


def _weights(hashes: np.ndarray, tree: int, seed: int, rate: float) -> np.ndarray:
    """How often a tree draws each row: a Poisson number that follows from the row's hash."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.int64).view(np.uint64) + _STEPS * np.uint64(tree + 1) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    chance = np.cumsum(np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, 20)])))
    return np.searchsorted(chance, (z >> np.uint64(11)).astype(float) / 2**53, "right")


def _route(top: list[tuple[int, int, int, int]], bins: np.ndarray) -> np.ndarray:
    """Node of each row below the split top of a tree."""
    at = np.zeros(len(bins), np.int32)
    for node, feature, cut, left in top:
        here = np.flatnonzero(at == node)
        at[here] = left + (bins[here, feature] > cut)
    return at


def _chosen(nodes: int, features: int, draw: np.random.Generator, whole: bool) -> np.ndarray:
    """Per node which features it may be split by: a third, or all of a lone tree."""
    if whole:
        return np.ones((nodes, features), bool)
    order = draw.random((nodes, features), np.float32)
    take = -(-features // 3)
    return order <= np.partition(order, take - 1, axis=1)[:, take - 1 : take]


def _best_cuts(
    bins: np.ndarray, orders: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray, may: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of each node's best split; ``orders`` has per feature the rows by (node, bin)."""
    nodes = len(may)
    total_w, total_y = np.bincount(node, w, nodes), np.bincount(node, wy, nodes)
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
    base = total_y**2 / total_w
    for f in range(bins.shape[1]):
        rows = orders[f]
        if not may[:, f].all():
            rows = rows[may[node[rows], f]]
        if len(rows) < 2:
            continue
        n, b = node[rows], bins[rows, f]
        new = n[1:] != n[:-1]
        ends = np.flatnonzero(~new & (b[1:] != b[:-1]))
        if not len(ends):
            continue
        sum_w, sum_y = np.cumsum(w[rows]), np.cumsum(wy[rows])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        first = np.zeros(nodes, np.int64)
        first[n[starts]] = starts
        at = n[ends]
        before = first[at] - 1
        left_w = sum_w[ends] - np.where(before < 0, 0, sum_w[before])
        left_y = sum_y[ends] - np.where(before < 0, 0, sum_y[before])
        right_w, right_y = total_w[at] - left_w, total_y[at] - left_y
        won = left_y**2 / left_w + right_y**2 / right_w - base[at]
        won[(left_w < least) | (right_w < least)] = 0
        heads = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        top, who = np.maximum.reduceat(won, heads), at[heads]
        better = top > gain[who]
        if better.any():
            place = np.where(won == np.repeat(top, np.diff(np.concatenate([heads, [len(at)]]))), np.arange(len(at)), len(at))
            place = np.minimum.reduceat(place, heads)[better]
            who = who[better]
            gain[who], feature[who], cut[who] = top[better], f, b[ends[place]]
    # Sums of equal targets differ in their last digits only; such a node is pure.
    return np.where(gain > 1e-12 * np.maximum(1.0, np.abs(base)), gain, 0), feature, cut


def _grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: float, draw: np.random.Generator, whole: bool) -> list[np.ndarray]:
    """Branch of drawn rows as arrays (feature, bin, left child, value); feature -1 is a leaf."""
    features, lefts, cuts, values = [], [], [], []
    node, level, made = np.zeros(len(y), np.int32), 0, 1
    wy = w * y
    orders = np.stack([np.argsort(bins[:, f], kind="stable") for f in range(bins.shape[1])]).astype(np.int32)
    while True:
        count = int(node.max()) + 1
        sum_w = np.bincount(node, w, count)
        value = np.bincount(node, wy, count) / sum_w
        if level == depth:
            gain = np.zeros(count)
        else:
            gain, feature, cut = _best_cuts(bins, orders, node, w, wy, _chosen(count, bins.shape[1], draw, whole), least)
        split = gain > 0
        left = np.full(count, -1, np.int32)
        left[split] = made + 2 * np.arange(split.sum())
        made += 2 * int(split.sum())
        values.append(value)
        lefts.append(left)
        features.append(np.where(split, feature, -1) if split.any() else np.full(count, -1))
        cuts.append(np.where(split, cut, 0) if split.any() else np.zeros(count))
        if not split.any():
            kinds = ("int16", "uint8", "int32", "float64")
            return [np.concatenate(p).astype(k) for p, k in zip((features, cuts, lefts, values), kinds, strict=True)]
        # Rows of split nodes go on, numbered by the places of their children in the next level.
        rank = np.cumsum(split) - 1
        go = split[node]
        side = bins[np.arange(len(node)), np.where(go, feature[node], 0)] > cut[node]
        below = 2 * rank[node] + side
        moved = np.cumsum(go) - 1
        kept = orders[go[orders]].reshape(len(orders), -1)
        key = below[kept]
        if 2 * int(split.sum()) <= 1 << 16:
            key = key.astype(np.uint16)  # sorted by digits
        orders = moved[np.take_along_axis(kept, np.argsort(key, axis=1, kind="stable"), 1)].astype(np.int32)
        node, bins, w, wy = below[go].astype(np.int32), bins[go], w[go], wy[go]
        level += 1


def _lead(key: tuple, rows: pa.Table, branches: pa.Table) -> pa.Table:
    """Value of a branch for each row that comes to it."""
    if not rows.num_rows:
        return pa.table({"_bytes": pa.array([], pa.binary()), "value": pa.array([], pa.float64())})
    feature, cut, left, value = (
        np.frombuffer(branches.column(c)[0].as_py(), k)
        for c, k in (("feature", "int16"), ("bin", "uint8"), ("left", "int32"), ("value", "float64"))
    )
    bins = _matrix(rows.column("_bytes"))
    at = np.zeros(len(bins), np.int64)
    inner = np.arange(len(bins)) if feature[0] >= 0 else np.array([], np.int64)
    while len(inner):
        here = at[inner]
        at[inner] = left[here] + (bins[inner, feature[here]] > cut[here])
        inner = inner[feature[at[inner]] >= 0]
    return pa.table({"_bytes": rows.column("_bytes"), "value": value[at]})


def _tops(rows: DataFrame, trees: int, size: int, depth: int, least: float, seed: int, rate: float, whole: bool) -> tuple[list, dict]:
    """Splits of every node with more than ``LOCAL_ROWS`` drawn rows, and values of those that no split helps."""
    if rows.count() <= LOCAL_ROWS:
        return [[] for _ in range(trees)], {}
    tops: list[list[tuple[int, int, int, int]]] = [[] for _ in range(trees)]
    levels, done = {(t, 0): 0 for t in range(trees)}, {}
    todo = list(levels)
    while todo:
        batch, todo = todo[:NODES_A_PASS], todo[NODES_A_PASS:]
        may = {(t, n): _chosen(1, size, np.random.default_rng([seed, t, n, 1]), whole)[0] for t, n in batch}
        known = [list(top) for top in tops]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for part in batches:
                bins, hashes, y = _matrix(part.column("bytes")), part.column("h").to_numpy(), part.column("y").to_numpy()
                for t in {t for t, _ in may}:
                    w, at = _drawn(hashes, t, seed, rate, whole), _route(known[t], bins)
                    for n in [n for u, n in may if u == t]:
                        here = np.flatnonzero((at == n) & (w > 0))
                        if not len(here):
                            continue
                        out = held.setdefault((t, n), np.zeros((3, size, _BINS)))
                        mine, times = w[here], w[here] * y[here]
                        for f in np.flatnonzero(may[t, n]):
                            b = bins[here, f]
                            out[0, f] += np.bincount(b, mine, _BINS)
                            out[1, f] += np.bincount(b, times, _BINS)
                            out[2, f] += np.bincount(b, minlength=_BINS)
            for (t, n), out in held.items():
                kept = np.ascontiguousarray(out[:, may[t, n]])
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()), "sums": [kept.tobytes()]})

        def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            t, n = (int(k) for k in key)
            mine = np.flatnonzero(may[t, n])
            w, wy, rows = sum(np.frombuffer(p).reshape(3, len(mine), _BINS) for p in parts["sums"])
            left_w, left_y = np.cumsum(w, 1), np.cumsum(wy, 1)
            all_w, all_y = left_w[0, -1], left_y[0, -1]
            fits = (left_w >= least) & (all_w - left_w >= least) & (left_w > 0) & (all_w - left_w > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                won = np.where(fits, left_y**2 / left_w + (all_y - left_y) ** 2 / (all_w - left_w) - all_y**2 / all_w, 0)
            f, b = np.unravel_index(np.argmax(won), won.shape)
            good = bool(won[f, b] > 1e-12 * max(1.0, all_y**2 / all_w))
            left = int(rows[f, : b + 1].sum())
            return pd.DataFrame(
                [(t, n, int(mine[f]) if good else -1, int(b), left, int(rows[f].sum()) - left, all_y / all_w)],
                columns=["tree", "node", "feature", "bin", "n_left", "n_right", "value"],
            )

        parts = rows.mapInArrow(sums, "tree int, node int, sums binary").groupBy("tree", "node")
        chosen = parts.applyInPandas(choose, "tree int, node int, feature int, bin int, n_left long, n_right long, value double")
        for r in sorted(chosen.collect()):
            t, n = r["tree"], r["node"]
            if r["n_left"] + r["n_right"] <= LOCAL_ROWS:
                continue
            if r["feature"] < 0 or levels[t, n] == depth:
                done[t, n] = r["value"]
                continue
            left = 2 * len(tops[t]) + 1
            tops[t].append((n, r["feature"], r["bin"], left))
            for child, rows_of in ((left, r["n_left"]), (left + 1, r["n_right"])):
                levels[t, child] = levels[t, n] + 1
                if rows_of > LOCAL_ROWS:
                    todo.append((t, child))
    return tops, done


def _drawn(hashes: np.ndarray, tree: int, seed: int, rate: float, whole: bool) -> np.ndarray:
    return (np.ones(len(hashes)) if whole and rate == 1 else _weights(hashes, tree, seed, rate)).astype(float)


def fit_forest(
    rows: DataFrame, label: Column, key: str, seed: int, numTrees: int, maxDepth: int, minInstancesPerNode: int = 1,
    subsamplingRate: float = 1.0,
) -> Forest:
    """Forest of ``label`` by the vector ``x``, on all ``rows``; ``key`` is unique.

    Drawing is with replacement, a lone tree takes the rows as they are. Each node tries a
    third of the features. Rows without label take no part; without any row the forest says 0.
    """
    spark = rows.sparkSession
    labelled = materialize(rows.select("x", F.xxhash64(key).alias("h"), label.cast("double").alias("y")).where("y is not null"), "labelled")
    thresholds = _thresholds(labelled)
    size, whole, rate, depth, least = len(thresholds), numTrees == 1, subsamplingRate, maxDepth, minInstancesPerNode
    dealt = labelled.repartition(shuffle_width(spark))
    binned = materialize(dealt.select("h", "y", _binned(thresholds)(vector_to_array("x")).alias("bytes")), "binned")
    tops, done = _tops(binned, numTrees, size, depth, least, seed, rate, whole)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            bins, hashes, y = _matrix(part.column("bytes")), part.column("h").to_numpy(), part.column("y").to_numpy()
            for t in range(numTrees):
                w, leaf = _drawn(hashes, t, seed, rate, whole), _route(tops[t], bins)
                closed = [n for u, n in done if u == t]
                here = np.flatnonzero((w > 0) & ~np.isin(leaf, closed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(here), t, "int32")), pa.array(leaf[here]), part.column("bytes").take(pa.array(here)),
                     pa.array(hashes[here]), pa.array(y[here]), pa.array(w[here])],
                    ["tree", "leaf", "bytes", "h", "y", "w"],
                )

    def level_of(top: list, leaf: int) -> int:
        up = {child: n for n, _, _, left in top for child in (left, left + 1)}
        level = 0
        while leaf in up:
            leaf, level = up[leaf], level + 1
        return level

    def grow(key: tuple, part: pa.Table) -> pa.Table:
        t, leaf = (k.as_py() for k in key)
        # One order whatever the tasks, so that sums are the same in every run.
        part = part.sort_by([("h", "ascending"), ("y", "ascending")])
        draw = np.random.default_rng([seed, t, leaf])
        y, w = part.column("y").to_numpy(), part.column("w").to_numpy()
        left = depth - level_of(tops[t], leaf)
        arrays = _grow(_matrix(part.column("bytes")), y, w, left, least, draw, whole)
        return _branch(t, leaf, arrays)

    schema = "tree int, leaf int, bytes binary, h long, y double, w double"
    placed = binned.mapInArrow(drawn, schema).repartition(max(shuffle_width(spark), numTrees), "tree", "leaf")
    branches = placed.groupBy("tree", "leaf").applyInArrow(grow, _BRANCH)
    # A branch that drew no row, and one that no split helps, is a leaf of a known value.
    lone = [(t, n, 1, b"\xff\xff", b"\0", b"\xff" * 4, np.float64(v).tobytes()) for (t, n), v in done.items()]
    grown = materialize(branches.unionByName(spark.createDataFrame(lone, _BRANCH)) if lone else branches, "branches")
    found = {(r["tree"], r["leaf"]) for r in grown.select("tree", "leaf").collect()}
    missing = [(t, n) for t, top in enumerate(tops) for n in _leaves(top) if (t, n) not in found]
    if missing:
        mean = labelled.agg(F.avg("y")).first()[0] or 0.0
        none = [(t, n, 1, b"\xff\xff", b"\0", b"\xff" * 4, np.float64(mean).tobytes()) for t, n in missing]
        grown = materialize(grown.unionByName(spark.createDataFrame(none, _BRANCH)), "branches")
    return Forest(thresholds, tops, grown)


def _leaves(top: list[tuple[int, int, int, int]]) -> list[int]:
    """Nodes below the split top of a tree."""
    return sorted({0, *(c for *_, left in top for c in (left, left + 1))} - {n for n, *_ in top})


def _branch(tree: int, leaf: int, arrays: list[np.ndarray]) -> pa.Table:
    packed = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    numbers = [pa.array([v], pa.int32()) for v in (tree, leaf, len(arrays[0]))]
    return pa.Table.from_arrays([*numbers, *packed], _NAMES)
