"""Traversal over whole numbers: lists of neighbours are shuffled once for all queries of a bucket."""

import random

import pytest
from pyspark.sql import functions as F

from srcloom.operators import graph


def test_neighbours_are_not_repeated_for_every_query(spark):
    # One hub that all queries reach: 300 queries times 500 neighbours.
    edges = spark.createDataFrame([(q, 1000) for q in range(300)] + [(1000, 2000 + n) for n in range(500)], "source long, target long")
    seeds = spark.createDataFrame([(q, q) for q in range(300)], "query_id long, node long")
    known = seeds.select(F.lit(0).alias("bucket"), F.col("query_id").alias("query"), "node")
    lists = graph._number_lists(known, edges, 2, "upstream")
    assert lists.select(F.sum(F.size("nodes"))).first()[0] == 300 + 500
    assert graph.traverse(seeds, edges, 2, "upstream").count() == 300 * 502


@pytest.mark.parametrize("mode, depth, kind", [("upstream", 0, "int"), ("upstream", 2, "int"), ("downstream", 2, "bigint"), ("bidirectional", 3, "int")])
def test_numbers_give_what_texts_give(spark, monkeypatch, mode, depth, kind):
    monkeypatch.setattr(graph, "_AT_ONCE", 40)
    monkeypatch.setattr(graph, "_ASKERS", 2)
    rng = random.Random(11)
    links = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(150)] + [(None, 3), (3, None)]
    asked = [(q, rng.randrange(-40, 45)) for q in range(-6, 20) for _ in range(q % 4)] + [(None, 3), (None, 4), (5, None), (None, None), (5, 3), (5, 3)]
    edges, seeds = spark.createDataFrame(links, f"source {kind}, target {kind}"), spark.createDataFrame(asked, f"query_id {kind}, node {kind}")
    got = graph.traverse(seeds, edges, depth, mode)
    texts = graph.traverse(seeds.selectExpr("query_id", "string(node) node"), edges.selectExpr("string(source) source", "string(target) target"), depth, mode)
    assert dict(got.dtypes)["query_id"] == kind and dict(got.dtypes)["node"] == kind
    rows = sorted(map(repr, map(tuple, got.selectExpr("query_id", "string(node)", "depth", "direction").collect())))
    assert rows == sorted(map(repr, map(tuple, texts.collect())))
