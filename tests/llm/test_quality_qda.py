import zlib

import numpy as np
from pyspark.sql import functions as F

from chatterforge.llm import quality_qda as Q

from .helpers import AWKWARD, awkward, documents


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.score_quality(documents(spark, folder), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in held], [r["quality"] for r in held]) > 0.98
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [r["predicted"] for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    for r in rows[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_scores_match_a_plain_model(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    moments = {}
    for k in (0, 1):
        ids = [r["doc_id"] for r in labels.collect() if r["quality"] == k and zlib.crc32(str(r["doc_id"]).encode()) % 5]
        x = np.array([Q.statistics((docs[i] or "").encode()) for i in ids])
        moments[k] = len(x), x.sum(0), x.T @ x
    model = Q.solve(moments)
    expected = {i: model.score(np.array([Q.statistics((t or "").encode())]))[0] for i, t in docs.items()}
    for r in Q.score_quality(documents(spark, sf_dir), labels).collect():
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-6


def test_density_is_that_of_the_shrunk_gaussians():
    rng = np.random.default_rng(1)
    d = len(Q.STATISTICS)
    x0, x1 = rng.normal(size=(200, d)), rng.normal(1, 2, size=(300, d))
    model = Q.solve({0: (200, x0.sum(0), x0.T @ x0), 1: (300, x1.sum(0), x1.T @ x1)}, temperature=1.0)
    x = rng.normal(size=(5, d))
    logs = []
    for k in (0, 1):
        inverse = model.inverse_factors[k].T @ model.inverse_factors[k]
        scale = np.linalg.slogdet(np.linalg.inv(inverse))[1]
        z = x - model.means[k]
        logs.append(model.log_priors[k] - 0.5 * (np.einsum("ij,jk,ik->i", z, inverse, z) + scale))
    # Both densities are relative to the same pooled scale, which cancels.
    expected = 1 / (1 + np.exp(-(logs[1] - logs[0])))
    assert np.allclose(model.score(x), expected)


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (3, 7), (1, None), (8, 0)], "doc_id bigint, quality int")
    rows = Q.score_quality(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    none = Q.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.score_quality(awkward(spark, []), labels).count() == 0
    kept = Q.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    scored = {(r["doc_id"], r["predicted"]) for r in rows}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in scored if p == 1}


def test_labels_beside_text_do_not_change_scores(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    one = {r["doc_id"]: round(r["score"], 9) for r in Q.score_quality(docs, labels).collect()}
    two = {r["doc_id"]: round(r["score"], 9) for r in Q.score_quality(moved, labels).collect()}
    assert one == two
