"""Nearest references with floors and margins. References are compared in blocks of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import cosine

BLOCK = 10_000


def scores(vectors: DataFrame, refs: DataFrame) -> DataFrame:
    """(vec_id, key, score): every vector against every reference; refs has key, ref. References go to the tasks in blocks of
    about BLOCK, so what is held at once is bounded however many they are; the vectors are read once for each block."""
    blocks = max(1, -(-refs.count() // BLOCK))
    made = [refs] if blocks == 1 else [refs.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) for b in range(blocks)]
    parts = [vectors.join(F.broadcast(r)).select("vec_id", "key", cosine("embedding", "ref").alias("score")) for r in made]
    return reduce(DataFrame.union, parts)


def top_two(scored: DataFrame) -> DataFrame:
    """(vec_id, key, score, second): ties to the smaller key; second is -1 with one reference."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("vec_id").agg(F.max(F.when(F.col("rn") == 1, F.col("key"))).alias("key"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(-1.0)).alias("second"))


def accept(top: DataFrame, floor: float, margin: float = 0.0) -> DataFrame:
    ok = (F.col("score") >= floor) & (F.col("score") - F.col("second") >= margin)
    return top.withColumn("value", F.when(ok, F.col("key"))).withColumn("status", F.when(ok, "accepted").when(F.col("score") < floor, "below_floor").otherwise("near_tie"))
