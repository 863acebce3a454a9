"""SimHash near-duplicates by a self-join of one binary trie over all fingerprints.

Node pairs of the trie are traversed together. A pair carries the bits its two
prefixes differ in and is dropped once they exceed the error budget. The upper
levels are traversed by Spark: each round sends every fingerprint of a pair to
the child pairs it belongs to, until a pair holds few enough fingerprints for
one task. The rest of the traversal runs on sorted arrays inside that task, and
returns a spanning forest of the links found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from airlume.llm.components import components
from airlume.llm.textblocks import encoded, slices
from airlume.operators.skew import salted_join
from airlume.session import materialize

BITS = 64
SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DIFFERENCE = 2
# Fingerprints of a node pair that one task takes; larger pairs are split further.
PAIR_ROWS = 16_384
# Trie levels passed in one distributed round.
STRIDE = 4
# Node pairs with at most this many fingerprint pairs are compared directly.
DIRECT = 64
# Fingerprint pairs compared in one array operation.
DIRECT_ROWS = 1 << 20
# Shingles counted in one array operation.
COUNT_ROWS = 1 << 15

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def near_duplicates(docs: DataFrame, max_difference: int = MAX_DIFFERENCE) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints link at ``max_difference`` or fewer differing bits; a component
    is named by the smallest doc_id in it. A null text counts as empty and an
    empty text has fingerprint zero, linked like any other. Repeated rows keep
    their own result row each. A row without doc_id names no component; it gets
    the component of its fingerprint where a row with an id has the same one,
    else null. A doc_id is one node: rows that share it, whatever their texts, do not
    link by that alone, but what is linked to the smallest id of either fingerprint is
    one component where both have the same. Other columns of ``docs`` are ignored. An empty table gives none.
    """
    return _components_of(docs, max_difference).drop("version")


def _components_of(docs: DataFrame, max_difference: int) -> DataFrame:
    """``near_duplicates`` with ``version``, a hash of the text that tells rows of one id apart."""
    prints = materialize(fingerprints(docs), "simhash")
    nodes = materialize(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node is not null"),
        "simhash-nodes",
    )
    labels = components(links(nodes, max_difference))
    named = (
        nodes.join(labels, "node", "left")
        .select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    )
    return salted_join(prints, materialize(named, "simhash-named"), ["fingerprint"], "left").select(
        "doc_id", "version", "fingerprint", "component_id"
    )


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, version and the 64-bit SimHash of each whole text, as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([simhash(x) for x in encoded(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "version", "fingerprint"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _version(F.col("text")).alias("version"))
    return source.mapInArrow(work, "doc_id long, version long, fingerprint long")


def simhash(text: bytes) -> int:
    """A bit is set if more than half of the shingle hashes have it set."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE_WORDS, len(words))
    n = len(words) - size + 1
    total = np.zeros(BITS, np.int64)
    spans = [(starts[a : a + COUNT_ROWS], ends[a + size - 1 : a + size - 1 + COUNT_ROWS]) for a in range(0, n, COUNT_ROWS)]
    for begin, end in spans:
        begin = begin[: len(end)]
        pieces = map(joined.__getitem__, map(slice, begin.tolist(), end.tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(HASH_SEED)), np.uint64, len(begin))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def links(nodes: DataFrame, max_difference: int = MAX_DIFFERENCE, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Spanning links (a, b) between nodes (fingerprint, node) in reach of each other.

    Fingerprints must be distinct. Two nodes are connected by the links returned
    exactly if they are by chains of fingerprints within ``max_difference`` bits.
    """
    bits = F.col("fingerprint")
    stats = nodes.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.shiftright(bits, i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)],
    ).first()
    # Bits that split the corpus most evenly form the upper levels of the trie.
    order = sorted(range(BITS), key=lambda i: (abs(2 * (stats[f"b{i}"] or 0) - stats["n"]), i))
    depth = 0
    while stats["n"] >> depth > pair_rows // 4 and depth < 24:
        depth += 1
    rows = descend(_root(nodes, order), 0, depth, max_difference)
    found = None
    while True:
        sizes = rows.groupBy("left", "right").agg(F.count(F.lit(1)).alias("_n"))
        heavy = sizes.where(F.col("_n") > pair_rows)
        if depth >= BITS - STRIDE or heavy.isEmpty():
            part = _within(rows, depth, max_difference)
            return part if found is None else found.unionByName(part)
        light = sizes.where(F.col("_n") <= pair_rows)
        part = _within(rows.join(light, ["left", "right"], "left_semi"), depth, max_difference)
        found = part if found is None else found.unionByName(part)
        below = min(STRIDE, BITS - depth)
        split = rows.join(heavy, ["left", "right"], "left_semi")
        rows = materialize(descend(split, depth, below, max_difference), "simhash-pairs")
        depth += below


def _root(nodes: DataFrame, order: list[int]) -> DataFrame:
    """Every node in the pair of the root with itself; ``key`` has the bits in trie order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = np.zeros(len(prints), np.uint64)
            for level, bit in enumerate(order):
                key |= (prints >> np.uint64(bit) & np.uint64(1)) << np.uint64(BITS - 1 - level)
            zero = np.zeros(len(key), np.int64)
            columns = [zero, zero, key.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(1)], names=["left", "right", "key", "node"])

    return nodes.select("fingerprint", "node").mapInArrow(work, "left long, right long, key long, node long")


def descend(rows: DataFrame, depth: int, levels: int, budget: int) -> DataFrame:
    """Rows (left, right, key, node) of node pairs at ``depth``, dealt to the child pairs below.

    left <= right are prefixes of ``depth`` bits and each row lies under one of
    them. Its partners under the other are all prefixes that use up no more than
    what the pair has left of the budget.
    """
    if not levels:
        return rows
    flips = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(levels), k)]
    spent = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    mine = F.shiftrightunsigned("key", BITS - depth - levels)
    above = F.shiftleft(F.col("left").bitwiseXOR(F.col("right")), levels) if depth else F.lit(0).cast("long")
    other = mine.bitwiseXOR(above).bitwiseXOR(F.col("_flip"))
    dealt = rows.withColumn("_flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
    dealt = dealt.where(spent + F.bit_count("_flip") <= budget)
    return dealt.select(F.least(mine, other).alias("left"), F.greatest(mine, other).alias("right"), "key", "node")


def _within(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """The rest of the traversal of each node pair, inside one task."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left, right = key[0].as_py(), key[1].as_py()
        keys = table.column("key").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        order = np.argsort(keys)
        keys, node = keys[order], node[order]
        cut = len(keys)
        if left != right:
            cut = int(np.searchsorted(keys >> np.uint64(BITS - depth), np.uint64(left), "right"))
        label = traverse(keys, cut if left != right else None, depth, (left ^ right).bit_count(), budget)
        # one link from each node to the first of its local component
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    return rows.groupBy("left", "right").applyInArrow(work, "a long, b long")


def traverse(keys: np.ndarray, cut: int | None, depth: int, spent: int, budget: int) -> np.ndarray:
    """Local component of each of the sorted ``keys``, by traversing two subtries together.

    The subtries are keys[:cut] and keys[cut:], or the same one twice where
    ``cut`` is None. Nodes are ranges of the sorted keys. Pairs all of whose
    leaves are in one component already are passed over.
    """
    n = len(keys)
    label = np.arange(n)
    alo, ahi, blo, bhi = ([0], [n], [0], [n]) if cut is None else ([0], [cut], [cut], [n])
    pairs = np.array([alo, ahi, blo, bhi, [spent]], np.int64)
    for level in range(depth, BITS + 1):
        if not pairs.shape[1]:
            break
        area = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        direct = (area <= DIRECT) | (level == BITS)
        label = _compare(keys, pairs[:, direct], label, budget)
        pairs = pairs[:, ~direct]
        if not pairs.shape[1]:
            break
        low, high = _uniform(label, pairs[0], pairs[1]), _uniform(label, pairs[2], pairs[3])
        pairs = pairs[:, (low < 0) | (low != high)]
        bit = np.uint64(BITS - 1 - level)
        amid, bmid = _middle(keys, pairs[0], pairs[1], bit), _middle(keys, pairs[2], pairs[3], bit)
        same = (pairs[0] == pairs[2]) & (pairs[1] == pairs[3])
        near = [
            np.stack([pairs[0], amid, pairs[2], bmid, pairs[4]]),
            np.stack([amid, pairs[1], bmid, pairs[3], pairs[4]]),
            np.stack([pairs[0], amid, bmid, pairs[3], pairs[4] + 1]),
            np.stack([amid, pairs[1], pairs[2], bmid, pairs[4] + 1])[:, ~same],
        ]
        pairs = np.concatenate(near, axis=1)
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)]
    return label


def _middle(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place of each range whose key has ``bit`` set, given that the bits above agree."""
    if not len(low):
        return low
    one = np.uint64(1)
    wall = (keys[low] >> bit | one) << bit
    return np.clip(np.searchsorted(keys, wall), low, high)


def _uniform(label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The one label of each range, or -1 where it has several."""
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    return np.where(changes[low] == changes[high - 1], label[low], -1)


def _compare(keys: np.ndarray, pairs: np.ndarray, label: np.ndarray, budget: int) -> np.ndarray:
    """Join the components of all leaves in reach of each other."""
    wide = pairs[3] - pairs[2]
    area = (pairs[1] - pairs[0]) * wide
    if not area.sum():
        return label
    steps = np.cumsum(area)
    at = 0
    while at < len(area):
        done = steps[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(steps, done + DIRECT_ROWS, "right")))
        which = np.repeat(np.arange(at, to), area[at:to])
        within = np.arange(len(which)) - np.repeat(steps[at:to] - area[at:to] - done, area[at:to])
        for a in range(0, len(which), DIRECT_ROWS):
            w, i = which[a : a + DIRECT_ROWS], within[a : a + DIRECT_ROWS]
            u, v = pairs[0][w] + i // wide[w], pairs[2][w] + i % wide[w]
            near = (u != v) & (np.bitwise_count(keys[u] ^ keys[v]) <= budget)
            label = joined(label, u[near], v[near])
        at = to
    return label


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the components of u[i] and v[i]; each is named by its first place."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def drop_near(docs: DataFrame, max_difference: int = MAX_DIFFERENCE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that name their component, with all their columns.

    Rows without doc_id always stay. Rows that share one are judged each by its own
    text; whole repeats of a row stay or go together. An empty table gives none.
    """
    found = _components_of(docs, max_difference).where("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("version").alias("_gone_version")).distinct()
    same = (docs["doc_id"] == gone["_gone"]) & (_version(docs["text"]) == gone["_gone_version"])
    return docs.join(gone, same, "left_anti")
