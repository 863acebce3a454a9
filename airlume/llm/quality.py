"""Quality classifier: naive Bayes features in a linear support vector machine.

n-gram indicators are scaled by the log-ratio of their shares in the two classes,
counted over all training rows by Spark. A hinge-loss model over the scaled and
normalised indicators is fitted by dual coordinate descent on a bounded sample.
Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from airlume.llm.textblocks import Words, blocks, mixed, slices
from airlume.session import materialize

# n-grams are hashed to so many features, which bounds model and statistics.
FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
# Labelled rows the hinge loss is fitted on, half of each class, and bytes of their
# features, at most; the counts take all.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 64 << 20
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
# Slope from margin to score.
SLOPE = 2.0
# One row in FOLDS is never learned from: the one with this remainder.
FOLDS, HELD_OUT = 3, 1
_SEED = 17
_REPEAT = np.uint64(0x5BD1E995)

# Kinds of characters: upper case, other letters, digits, white space; the rest as it is.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = _KIND[128:] = 97
_KIND[48:58] = 48
_KIND[[0x20, *range(0x09, 0x0E)]] = 0x20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a row without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each text: words, pairs of words, pairs and triples of shapes."""
    words = Words.of([t.translate(_LOWER) for t in texts])
    plain = words.hashes(_SEED)
    shaped = Words.of([_shape(t) for t in texts])
    again = np.zeros(len(plain), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (words.place[1:] > 0)
    shape = mixed(shaped.hashes(_SEED + 1) + again.astype(np.uint64) * _REPEAT)
    streams = [
        (plain, None),
        (words.grams(plain, 2, _SEED), words.fits(2)),
        (words.grams(shape, 2, _SEED + 1), words.fits(2)),
        (words.grams(shape, 3, _SEED + 2), words.fits(3)),
    ]
    ends = np.cumsum(words.count)
    hashed = []
    for k, (stream, fits) in enumerate(streams):
        ids = (mixed(stream + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        hashed.append(np.where(fits, ids, -1) if fits is not None else ids)
    out = []
    for a, b in zip(ends - words.count, ends, strict=True):
        found = np.unique(np.concatenate([h[a:b] for h in hashed]))
        out.append(found[1:] if len(found) and found[0] < 0 else found)
    return out


def _shape(text: bytes) -> bytes:
    """Kinds of characters, runs of one kind as one character."""
    kind = _KIND[np.frombuffer(text, np.uint8)]
    if not len(kind):
        return b""
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    return kind[first].tobytes()


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # of each scaled feature
    bias: float

    def margin(self, found: np.ndarray) -> float:
        scaled = self.ratio[found]
        norm = np.sqrt(scaled @ scaled)
        return float(scaled @ self.weight[found] / norm + self.bias) if norm else self.bias


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """A model from the rows of ``docs`` (doc_id, text) labelled 0 or 1 and not held out.

    Counts are taken over all of them. The hinge loss takes, of each class, half of
    ``sample_rows`` ids with the smallest hash, as long as their features fit half of
    ``sample_bytes``, and one in any case: a rare class is never lost. Of rows that share
    an id the smallest text is in it, once for each label. Labels other than 0 and 1 are
    ignored. Without any training row of both classes every score is one half.
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")
    ).distinct()
    # One plan at every size: labels grow with the corpus, so they are not broadcast.
    train = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("_id")).select("_label", "text")
    counts = (
        train.mapInArrow(_count, "feature int, label int, n long")
        .groupBy("feature").agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("bad"),
        ).toArrow()  # at most FEATURES rows, whatever the corpus
    )
    tally = np.zeros((2, FEATURES))
    at = counts.column("feature").to_numpy()
    tally[1, at], tally[0, at] = counts.column("good").to_numpy(), counts.column("bad").to_numpy()
    ratio = np.log((tally[1] + SMOOTHING) / (tally[1].sum() + SMOOTHING * FEATURES))
    ratio -= np.log((tally[0] + SMOOTHING) / (tally[0].sum() + SMOOTHING * FEATURES))
    ratio[tally.sum(0) == 0] = 0  # unseen

    rows = _sample(docs, wanted, sample_rows, sample_bytes).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    found = [np.frombuffer(x, np.int32) for x in rows.column("found").to_pylist()]
    return descend(found, rows.column("label").to_numpy(), ratio)


def _sample(docs: DataFrame, wanted: DataFrame, sample_rows: int, sample_bytes: int) -> DataFrame:
    """label, id and found of the rows the loss is fitted on: so many, with so many bytes, at most."""
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = [wanted.where(F.col("_label") == c).orderBy(*order).limit(max(sample_rows // 2, 1)) for c in (0, 1)]
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))  # sample_rows ids
        .groupBy("_label", "_id").agg(F.min("text").alias("text"))
    )
    found = texts.select("_label", "text", "_id").mapInArrow(_extract, "label int, id long, found binary")
    found = materialize(found, "quality-sample")
    # Only sizes take part in the order; a class has half of sample_rows rows.
    by_class = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    sizes = found.select("label", "id", F.octet_length("found").alias("_bytes"))
    fits = sizes.withColumns({"_sum": F.sum("_bytes").over(by_class), "_row": F.row_number().over(by_class)})
    fits = fits.where((F.col("_sum") <= sample_bytes // 2) | (F.col("_row") == 1)).select("label", "id")
    return found.join(F.broadcast(fits), ["label", "id"], "left_semi")


def descend(found: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> Model:
    """Dual coordinate descent for the hinge loss, rows in a seeded order."""
    weight, bias = np.zeros(FEATURES), 0.0
    if len(set(labels.tolist())) < 2:
        return Model(ratio, weight, 0.0)
    scaled = []
    for f in found:
        x = ratio[f]
        norm = np.sqrt(x @ x)
        scaled.append(x / norm if norm else x)
    sign = np.where(labels == 1, 1.0, -1.0)
    square = np.array([x @ x + 1.0 for x in scaled])  # the bias is a feature of value 1
    alpha = np.zeros(len(found))
    draw = np.random.default_rng(_SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(found)).tolist():
            slack = sign[i] * (scaled[i] @ weight[found[i]] + bias) - 1.0
            new = min(max(alpha[i] - slack / square[i], 0.0), COST)
            if step := (new - alpha[i]) * sign[i]:
                weight[found[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(ratio, weight, bias)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Labels and features of bounded blocks of (label, text, ...)."""
    for keys, texts in blocks(batches):
        yield keys, features(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have a feature: one row each per task."""
    tally = np.zeros((2, FEATURES), np.int64)
    for labels, found in _blocks(batches):
        for label, f in zip(labels.tolist(), found, strict=True):
            tally[label, f] += 1
    for label in (0, 1):
        at = np.flatnonzero(tally[label]).astype(np.int32)
        columns = [at, np.full(len(at), label, np.int32), tally[label, at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "label", "n"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [f.tobytes() for _, block in _blocks([batch]) for f in block]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["label", "id", "found"]
        )


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1, for label 1, from the whole text alone.

    Null and empty texts have no features and score by the bias. All columns and
    rows of ``docs`` (which needs ``text``) are kept; one called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keyed = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["row", "text"])
            margins = [shared.value.margin(f) for _, block in _blocks([keyed]) for f in block]
            scores = 1 / (1 + np.exp(-SLOPE * np.array(margins, float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) are learned from as ``fit`` says. predicted is 1
    from a score of one half on. Repeated rows are scored each on its own; an
    empty table gives none.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample_rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least one half, with all their columns."""
    return score(docs, fit(docs, labels), "_quality").where("_quality >= 0.5").drop("_quality")
