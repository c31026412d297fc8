import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import srs_ann
from tallyforge.llm.srs_ann import chi_square_cdf, nearest, search

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def brute(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            every = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = every[:k]
    return out


def test_chi_square():
    rng = np.random.default_rng(1)
    sample = (rng.normal(size=(200_000, 8)) ** 2).sum(1)
    for x in (2.0, 8.0, 15.0):
        assert chi_square_cdf(np.array([x]), 8)[0] == pytest.approx((sample <= x).mean(), abs=0.005)


def test_recall_and_pruning():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(0, 40, 6000)] * 2 + rng.normal(size=(6000, 32)) * 0.5
    queries = vectors[:200]
    norm = float(np.sqrt((vectors**2).sum(1)).max())
    found, verified = search(vectors, queries, 20, norm)
    truth = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, truth, strict=True)])
    assert recall >= 0.95 and verified < 0.3 * 200 * 6000
    # A bound that another cell has given spares more and loses none within it.
    kth = 2 * (norm * norm - np.sort(queries @ vectors.T, axis=1)[:, -20] * norm / np.sqrt((queries**2).sum(1)))
    again, fewer = search(vectors, queries, 20, norm, kth * (1 + 1e-9))
    assert fewer < verified and np.mean([len(set(a) & set(b)) / 20 for a, b in zip(again, truth, strict=True)]) >= 0.9


def test_quantile_and_tree():
    for freedom, share, x in ((8, 0.95, 15.507), (24, 0.9, 33.196)):
        assert srs_ann.chi_square_quantile(share, freedom) == pytest.approx(x, abs=1e-3)
    rng = np.random.default_rng(4)
    points = np.concatenate((rng.normal(size=(500, 4)), np.zeros((300, 4)), rng.integers(0, 2, (300, 4)).astype(float)))
    tree = srs_ann.KdTree(points, 20)
    assert sorted(np.concatenate(tree.leaves)) == list(range(1100))
    part = tree.part(points)
    assert all((part[own] == k).all() for k, own in enumerate(tree.leaves))
    assert (np.bincount(part)[[len(set(map(tuple, points[own]))) > 1 for own in tree.leaves]] <= 20).all()


def test_queries_are_routed(spark, monkeypatch):
    monkeypatch.setattr(srs_ann, "SHARD", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24)) * 3
    rows = [(k, (centres[k % 20] + 0.3 * rng.normal(size=24)).tolist()) for k in range(2000)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], SCHEMA).repartition(3)
    unique = df.select(F.size("embedding").alias("d"), F.hash("vec_id").cast("long").alias("h"), F.col("embedding").cast("array<double>").alias("v"), F.array("vec_id").alias("ids"))
    index = srs_ann.Index(srs_ann.checkpointed(unique))
    cells = len(index.boxes[24][0])
    assert cells >= 16 and index.cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 400
    queries = unique.limit(100).withColumn("qid", F.monotonically_increasing_id())
    asked = queries.withColumn("bound", F.lit(0.02 * index.norms[24] ** 2))
    assert index.routed(queries.withColumn("bound", F.lit(None).cast("double"))).count() == 100 * srs_ann.NEAR
    assert index.routed(asked).count() < 0.5 * 100 * cells
    truth, hits = brute(rows, 20), 0
    for r in nearest(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        hits += len(set(r.ids) & {i for _, i in truth[r.query_id]})
    assert hits >= 0.9 * 20 * len(truth)


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(srs_ann, "SHARD", 150)
    monkeypatch.setattr(srs_ann, "BLOCK", 10)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(500)]
    rows += [(600 + k, rows[40][1]) for k in range(60)] + [(700, [1.0, 2.0]), (720, [2.0, 1.0]), (701, [0.5, -0.0])]
    odd = [(800, None), (820, [0.0] * 16), (840, [math.nan] + [1.0] * 15), (860, [None] + [1.0] * 15), (880, [math.inf] * 16), (900, []), (None, rows[0][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], SCHEMA).repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    truth = brute(rows, 20)
    assert set(got) == set(truth)
    hits = 0
    for q, every in truth.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(every) + 1))
        hits += len({i for _, i, _ in got[q]} & {i for _, i in every}) / len(every)
    assert hits / len(truth) >= 0.95
    copies = [i for _, i, _ in got[40] if 600 <= i < 700]
    assert copies == list(range(600, 600 + len(copies))) and len(copies) > 10
    assert [i for _, i, _ in got[720]] == [700, 701]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
