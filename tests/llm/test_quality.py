from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from airlume.llm.quality import FEATURES, _sample, descend, drop_poor, features, fit, held_out, judge, score

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = judge(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    unseen = got[got.held_out]
    right = (unseen.predicted == unseen.quality)
    assert len(unseen) > 1000
    assert right[unseen.quality == 1].mean() > 0.98
    assert right[unseen.quality == 0].mean() > 0.9
    assert got.score.between(0, 1).all()


def test_odd_texts_and_clashing_columns(spark, texts):
    words = ["fine prose about rivers and hills"] * 8 + ["BUY!! NOW!! CHEAP!! BUY!! NOW!!"] * 8
    rows = [(i, f"{t} {i}") for i, t in enumerate(words)]
    rows += [(100, None), (101, ""), (None, "fine prose"), (102, "fine " * 60_000), (102, "fine " * 60_000)]
    labels = spark.createDataFrame([(i, int(i < 8), "t") for i in range(16)] + [(3, None, "t"), (900, 1, "t")], "doc_id long, quality int, text string")
    got = judge(texts(rows), labels).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 16} == {i: int(i < 8) for i in range(16)}
    docs = texts(rows).withColumnRenamed("hash", "score").withColumnRenamed("node", "label")
    kept = drop_poor(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(8))


def test_without_labels_all_is_even(spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in judge(texts([(1, "a b")]), none).collect()] == [(0.5, 1)]
    assert judge(texts([]), none).count() == 0


def test_descent_meets_the_optimality_conditions():
    draw = np.random.default_rng(0)
    found = [np.unique(draw.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(f.min() < 3) for f in found])
    ratio = np.zeros(FEATURES)
    ratio[:40] = draw.normal(size=40)
    model = descend(found, labels, ratio)
    hinge = [max(0, 1 - (1 if y else -1) * model.margin(f)) for f, y in zip(found, labels, strict=True)]
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - (1 if y else -1) * (ratio[f] @ w[f] / np.linalg.norm(ratio[f]) + b)) for f, y in zip(found, labels, strict=True))
    at = loss(model.weight, model.bias)
    assert abs(at - 0.5 * (model.weight @ model.weight + model.bias**2) - sum(hinge)) < 1e-9
    for _ in range(40):
        step = np.zeros(FEATURES)
        step[:40] = draw.normal(size=40) * 0.05
        assert loss(model.weight + step, model.bias + draw.normal() * 0.05) > at - 0.02


def test_features_are_indicators_of_the_text_alone():
    one, twice, empty = features([b"a b c", b"a b c a b c", b""])
    assert len(empty) == 0 and (np.diff(one) > 0).all() and set(features([b"A b\nc"])[0]) & set(one)
    assert (features([b"x y", b"a b c"])[1] == one).all()
    assert len(twice) > len(one)


def test_fold_of_missing_id(spark, texts):
    assert texts([(None, "x")]).select(held_out(F.col("doc_id"))).first()[0] is False


def test_a_rare_class_is_not_lost_and_rows_are_bounded(spark, texts):
    rows = [(i, f"fine prose about rivers {i % 7} and hills {i}") for i in range(4000)]
    rows += [(9000 + i, f"BUY!! NOW!! $$$ {i}") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i < 9000)) for i, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in judge(texts(rows), labels, sample_rows=100).collect()}
    assert max(got[9000 + i] for i in range(12)) < 0.5 < min(got[i] for i in range(4000))
    one = texts([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, "more " * 50)])
    wanted = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "_id long, _label int")
    assert sorted((r.label, r.id) for r in _sample(one, wanted, 10, 1 << 20).collect()) == [(0, 2), (0, 3), (1, 1)]
    assert len(_sample(one, wanted, 10, 1).collect()) == 2


def test_counts_ratios_and_scores_by_plain_means(spark, texts):
    rows = [(i, "fine prose " * (i % 5) + f"river {i % 9}" if i % 3 else f"BUY NOW!! {i % 4} fine") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = fit(texts(rows), labels)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    tally = np.zeros((2, FEATURES))
    for i, t in train:
        tally[int(i % 3 > 0), features([t.encode()])[0]] += 1
    want = np.log((tally + 1) / (tally.sum(1, keepdims=True) + FEATURES))
    assert np.allclose(model.ratio, np.where(tally.sum(0) > 0, want[1] - want[0], 0))
    for r in score(texts(rows), model).collect():
        x = np.zeros(FEATURES)
        f = features([r.text.encode()])[0]
        x[f] = model.ratio[f]
        assert abs(r.score - 1 / (1 + np.exp(-2 * (x @ model.weight / np.linalg.norm(x) + model.bias)))) < 1e-9
