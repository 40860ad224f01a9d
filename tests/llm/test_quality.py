import numpy as np
from pyspark.sql import functions as F

from benchlight.llm import quality


def test_trees_fit_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 3] > 0.2) & (x[:, 7] < 0.5) | (x[:, 11] > 1)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97


def walk(model, row):
    margin = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
        margin += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_arrays_walk_like_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.STATISTICS))).astype(np.float32)
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=20)
    np.testing.assert_allclose(model.score(x), [walk(model, r) for r in x])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80
    assert sum(r["predicted"] == r["label"] for r in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels_are_never_learnt(spark, texts):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = quality.fold(F.col("doc_id")) == quality.HELD_OUT_FOLD
    flipped = labels.withColumn("label", F.when(held, 1 - F.col("label")).otherwise(F.col("label")))
    scores = [
        {r["doc_id"]: r["score"] for r in quality.classify(texts, x).collect()} for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_sample_is_bounded(spark, texts):
    labels = texts.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    features = quality.described(texts)
    x, y = quality.sample(features, labels, rows=30)
    assert 10 <= len(y) <= 30 and x.shape == (len(y), len(quality.STATISTICS))


def test_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, None), (None, 1), (6, 5)], "doc_id bigint, label int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
