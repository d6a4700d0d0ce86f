"""Queries of the top-k join reach bins as narrow rows of their own, and no join is left that could be broadcast."""

import numpy as np
from pyspark.sql import functions as F

from srcloom.llm import voronoi_knn


def test_a_query_goes_once_to_a_bin_and_nothing_is_joined(spark, monkeypatch):
    points = np.random.default_rng(5).normal(0, 0.1, (3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(voronoi_knn, "QUERY_BLOCK", 16)
    is_query = F.col("vec_id") % 20 == 0
    assert "Join" not in voronoi_knn.top_k(df, is_query)._jdf.queryExecution().optimizedPlan().toString()
    rows, _ = voronoi_knn.meet(df, is_query, 5, "vec_id", "embedding", None)
    met = rows.select("kind", "bin", "vec_id", F.length("row").alias("bytes")).collect()
    assert {r.bytes for r in met} == {24}
    assert sorted(r.vec_id for r in met if r.kind == 0) == list(range(3000))
    asked = [(r.bin, r.vec_id) for r in met if r.kind == 1]
    assert len(asked) == len(set(asked)) and len({r.bin for r in met}) > 40


def test_numbers_too_wide_for_exact_products(spark):
    big = float(1 << 40)
    df = spark.createDataFrame([(i, [big + i, -big, 3.0 * i]) for i in range(30)], "vec_id long, embedding array<double>")
    whole = [[int(256 * (big + i)), int(-256 * big), 768 * i] for i in range(30)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in voronoi_knn.top_k(df, F.col("vec_id") == 0, 3).collect()}
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    scores = sorted((-cut(sum(a * b for a, b in zip(whole[0], whole[i]))), i) for i in range(1, 30))[:3]
    assert got == {(0, n + 1): (i, -s) for n, (s, i) in enumerate(scores)}
