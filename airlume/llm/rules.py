"""Quality rules: counted facts of a text, and a calibrated logistic regression.

Word and character n-grams are hashed to a fixed number of features. The loss is
minimised over a table of labelled texts: every evaluation is one Spark job, in which
each task sends one gradient. Labelled texts of another fold turn margins into
probabilities, and a third fold is never learned from.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.llm.textblocks import Words, blocks, mixed, slices, word_codes
from airlume.session import materialize

FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
WORD_SIZES = (1, 2)
CHAR_SIZES = (3, 4)
# Labelled texts of each class that the loss, and as many that the calibration, sees at most.
SAMPLE_ROWS = 2_000
# Tasks of an evaluation; each sends one gradient to the driver.
FIT_TASKS = 8
EVALUATIONS = 24
# Weight of the squared coefficients, per unit of the mean loss.
PENALTY = 1e-4
# Pairs of steps and gradient changes that estimate the curvature.
MEMORY = 8
# Least probability of label 1 at which a text is kept, and the limits of the base rules.
KEEP = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WORDS = 3
# crc32 of the id modulo FOLDS: fitted on, held out, calibrated on.
FOLDS, FIT, HELD_OUT, CALIBRATE = 3, 0, 1, 2

_SEED = 29
# Characters counted as symbols: fixed values.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column) -> Column:
    """Fold of a row; one without id is in none."""
    return F.crc32(doc_id.cast("string")) % FOLDS


# --- facts -------------------------------------------------------------------------


def facts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words.of(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    # A code point has one byte that does not continue another.
    points = (np.cumsum(inside[:-1]) > 0) & (words.data & 0xC0 != 0x80)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _by_text(points, ends),
        "n_symbols": _by_text(_SYMBOL[words.data], ends),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": _repeated_words(words),
    }


def _by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.cumsum(values, dtype=np.int64)[ends - 1], prepend=0)


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each text inside windows that it has twice or more."""
    code, _ = word_codes(words)
    at = np.flatnonzero(words.fits(REPEAT_WORDS))
    window = words.doc[at]
    for j in range(REPEAT_WORDS):
        # a number for each text and run of words so far
        window = np.unique(window * (int(code.max(initial=0)) + 1) + code[at + j], return_inverse=True)[1]
    at = at[np.bincount(window)[window] > 1] if len(at) else at
    covered = np.zeros(len(code), bool)
    for j in range(REPEAT_WORDS):
        covered[at + j] = True
    return np.bincount(words.doc[covered], minlength=len(words.count)).astype(np.int64)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


# --- features ----------------------------------------------------------------------


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the n-grams of a block, ordered; values of a text have length one.

    Words are lower-cased, character n-grams run over the bytes as they are.
    """
    words = Words.of([t.translate(_LOWER) for t in texts])
    plain = words.hashes(_SEED)
    streams = [(words.grams(plain, k, _SEED)[words.fits(k)] + np.uint64(k), words.doc[words.fits(k)]) for k in WORD_SIZES]
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    for k in CHAR_SIZES:
        at = np.flatnonzero(left >= k)
        gram = np.full(len(at), k, np.uint64)
        for j in range(k):
            gram = gram << np.uint64(8) | data[at + j]
        streams.append((gram, text[at]))
    keys = np.concatenate([
        (doc.astype(np.uint64) << np.uint64(FEATURE_BITS)) | (mixed(gram) >> np.uint64(64 - FEATURE_BITS)) for gram, doc in streams
    ])
    keys, count = np.unique(keys, return_counts=True)
    doc = (keys >> np.uint64(FEATURE_BITS)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, (keys & np.uint64(FEATURES - 1)).astype(np.int32), (value / norm[doc]).astype(np.float32)


# --- model -------------------------------------------------------------------------


@dataclass
class Model:
    weight: np.ndarray  # of each feature
    bias: float
    slope: float = 1.0  # from margin to log-odds
    shift: float = 0.0

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, feature, value = features(texts)
        return np.bincount(doc, self.weight[feature] * value, minlength=len(texts)) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.slope * self.margins(texts) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A calibrated model from the rows of ``docs`` (doc_id, text) labelled 0 or 1.

    Of each class and fold the ``sample_rows`` ids with the smallest hash are taken, so
    that a rare class is never lost, and classes weigh the same in the loss. Of rows
    that share an id the smallest text counts, once. An id with both labels, or
    another label, is left out. The calibration weighs classes by their share among
    all labels of its fold. Without both classes to fit on, all margins are zero;
    without labels to calibrate on every score is one half.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.min("quality").cast("int").alias("_label"), F.max("quality").cast("int").alias("_most")
    ).where("_label = _most and _label in (0, 1)").select("_id", "_label", fold(F.col("_id")).cast("int").alias("_fold"))
    known = materialize(known, "rule-labels")
    share = {(r["_fold"], r["_label"]): r["count"] for r in known.groupBy("_fold", "_label").count().collect()}
    train = _sample(docs, known, FIT, sample_rows)
    rows = materialize(
        train.repartition(FIT_TASKS, "_id").select("_label", "text").mapInArrow(_extract, "label int, feature binary, value binary"),
        "rule-features",
    )
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Model(np.zeros(FEATURES), 0.0, *_calibrated(np.zeros(0), np.zeros(0, int), share))
    weight = {label: 0.5 / n for label, n in seen.items()}
    best = minimise(_loss(rows, weight), np.zeros(FEATURES + 1), EVALUATIONS)
    model = Model(best[:-1], float(best[-1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(shared.value.margins(texts))], names=["label", "margin"])

    told = _sample(docs, known, CALIBRATE, sample_rows).select("_label", "text").mapInArrow(margins, "label int, margin double")
    got = told.toArrow()  # at most sample_rows of each class
    model.slope, model.shift = _calibrated(got.column("margin").to_numpy(), got.column("label").to_numpy(), share)
    return model


def _sample(docs: DataFrame, known: DataFrame, of: int, rows: int) -> DataFrame:
    """_id, _label and text of ``rows`` labelled ids of each class of a fold at most."""
    chosen = None
    for label in (0, 1):
        some = known.where((F.col("_fold") == of) & (F.col("_label") == label)).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")  # 2 x rows ids
    )
    return found.groupBy("_id", "_label").agg(F.min("text").alias("text"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, texts in blocks(batches):
        doc, feature, value = features(texts)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(labels.astype(np.int32)),
                pa.array([feature[s].tobytes() for s in spans], pa.binary()), pa.array([value[s].tobytes() for s in spans], pa.binary()),
            ],
            names=["label", "feature", "value"],
        )


def _loss(rows: DataFrame, weight: dict[int, float]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Weighted mean logistic loss with a penalty, and its gradient, as one job."""
    context = rows.sparkSession.sparkContext

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(point)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            loss, slope = 0.0, np.zeros(FEATURES + 1)
            for batch in slices(batches):
                for label, feature, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f, v = np.frombuffer(feature, np.int32), np.frombuffer(value, np.float32)
                    sign = 1.0 if label else -1.0
                    margin = sign * (w[f] @ v + w[-1])
                    loss += weight[label] * np.logaddexp(0, -margin)
                    pull = -sign * weight[label] * _logistic(-margin)
                    slope[f] += pull * v
                    slope[-1] += pull
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

        # one row of 2 MB from each of the few tasks
        told = rows.mapInArrow(work, "loss double, slope binary").toArrow()
        shared.unpersist()
        slope = sum((np.frombuffer(s, float) for s in told.column("slope").to_pylist()), np.zeros(FEATURES + 1))
        slope[:-1] += PENALTY * point[:-1]
        return sum(told.column("loss").to_pylist()) + PENALTY / 2 * point[:-1] @ point[:-1], slope

    return at


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, evaluations: int) -> np.ndarray:
    """Quasi-Newton steps with limited memory, halved until the loss falls enough."""
    point, (value, slope) = start, loss(start)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    used, size = 1, 1.0 / max(float(np.linalg.norm(slope)), 1e-12)
    while used < evaluations and np.linalg.norm(slope) > 1e-6:
        way = -_inverse_curvature(pairs, slope)
        step = size if not pairs else 1.0
        while True:
            after, (next_value, next_slope) = point + step * way, loss(point + step * way)
            used += 1
            if next_value <= value + 1e-4 * step * (way @ slope):
                break
            step /= 2
            if used >= evaluations or step < 1e-9:
                return point
        moved, turned = after - point, next_slope - slope
        if moved @ turned > 1e-12:
            pairs.append((moved, turned))
        point, value, slope = after, next_value, next_slope
    return point


def _inverse_curvature(pairs: deque[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """The estimated inverse curvature applied to ``slope``."""
    out, shares = slope.copy(), []
    for moved, turned in reversed(pairs):
        share = (moved @ out) / (moved @ turned)
        out -= share * turned
        shares.append(share)
    if pairs:
        moved, turned = pairs[-1]
        out *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(pairs, reversed(shares), strict=True):
        out += (share - (turned @ out) / (moved @ turned)) * moved
    return out


def _calibrated(margins: np.ndarray, labels: np.ndarray, share: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Slope and shift that make margins log-odds, by Newton's method on smoothed targets (Platt)."""
    count = np.array([share.get((CALIBRATE, c), 0) for c in (0, 1)], float)
    if not count.sum():
        return 1.0, 0.0
    if len(margins) == 0 or np.ptp(margins) == 0:
        # Nothing to tell texts apart by: the share of good ones, smoothed.
        return 0.0, float(np.log((count[1] + 1) / (count[0] + 1)))
    target = np.where(labels == 1, (count[1] + 1) / (count[1] + 2), 1 / (count[0] + 2))
    weight = (count / np.maximum(np.bincount(labels, minlength=2), 1))[labels]
    x = np.column_stack([margins, np.ones(len(margins))])
    loss = lambda t: float(weight @ (np.logaddexp(0, x @ t) - target * (x @ t)))
    theta = np.zeros(2)
    for _ in range(100):
        p = _logistic(x @ theta)
        slope = x.T @ (weight * (p - target))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, the four facts, base_failed, kept and score of every row of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; other columns are
    ignored. Words are ``[^\\x20\\x09-\\x0D]+``. word_chars: code points in words;
    n_symbols: characters of ``#*$%&|<>``; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in runs of REPEAT_WORDS that the text has twice
    or more. base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of a hundred
    of them repeated. Others are kept at a score, the probability of label 1, of KEEP
    or more. Null counts as empty, which fails. Repeated rows, and rows without or with
    equal doc_id, are judged each on its own; an empty table gives none. ``fit`` says
    what is learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keyed = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(1)], names=["row", "text"])
            for rows, texts in blocks([keyed]):
                told = facts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *map(pa.array, told.values()), pa.array(shared.value.scores(texts))],
                    names=["doc_id", *told, "score"],
                )

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _RESULT)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= KEEP)).alias("kept"), "score",
    )
