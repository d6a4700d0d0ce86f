"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm import common


#: Keys over which the edges of one node are spread, so that a hub is never in one task.
SALTS = 256


def _salted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with a salt, and the least neighbour ``m`` of every ``u`` with the salts it occurs under (``SALTS`` at most)."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    return salted, parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))


def _with_least(salted: DataFrame, least: DataFrame) -> DataFrame:
    return salted.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    salted, least = _salted(edges.union(edges.select("v", "u")))
    least = least.withColumn("m", F.least("u", "m"))
    return _with_least(salted.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    salted, least = _salted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = _with_least(salted, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the least member ``v`` of the component of every node ``u`` that is not itself the least."""
    now, before = common.stage(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return now
        before = mark
        now = common.stage(_small_star(_large_star(now)).distinct(), "edges")
