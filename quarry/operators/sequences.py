"""Runs, edges and islands over ordered rows, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Rows where flag holds, with _pos and _run (constant in a run)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("_pos", F.row_number().over(w) - 1)
    v = Window.partitionBy(*keys).orderBy("_pos")
    return at.where(F.col(flag)).withColumn("_run", F.col("_pos") - F.row_number().over(v))


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """(keys, start, length) of the longest run, the earliest of equals; (0, 0) if there is none."""
    runs = _runs(df, keys, order, flag).groupBy(*keys, "_run").agg(F.min("_pos").alias("s"), F.count("*").alias("n"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("s")).alias("m"))).alias("b"))
    every = df.select(*keys).distinct().join(best, keys, "left")
    return every.select(*keys, F.coalesce(-F.col("b.m"), F.lit(0)).cast("long").alias("start"), F.coalesce("b.n", F.lit(0)).cast("long").alias("length"))


def rising_edges(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    up = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return df.withColumn("_up", up).groupBy(*keys).agg(F.count_if("_up").alias("edges"))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: str, level: str, width: int, peak: float) -> DataFrame:
    """(keys, start, end, peak) of runs at least so wide with at least such a peak."""
    runs = _runs(df, keys, order, flag).groupBy(*keys, "_run").agg(F.min("_pos").alias("start"), F.max("_pos").alias("end"), F.count("*").alias("n"), F.max(level).alias("peak"))
    return runs.where((F.col("n") >= width) & (F.col("peak") >= peak)).select(*keys, F.col("start").cast("long"), F.col("end").cast("long"), "peak")


def sections(df: DataFrame, key: str, lines: str, mark: str = "--------") -> DataFrame:
    """(key, section, pos, line): lines numbered by the separators before them."""
    cut = df.select(key, F.posexplode(blocks(F.col(lines), mark)).alias("section", "_b"))
    return cut.select(key, "section", "_b.at", F.posexplode("_b.lines").alias("_i", "line")).where("line is not null").select(key, "section", (F.col("at") + F.col("_i")).alias("pos"), "line")


def blocks(lines: Column, mark: str = "--------") -> Column:
    """Array of struct(at, lines) of the parts of an array between its separators: the part's first position and its lines. It is
    made within the row, in one pass, so nothing is sorted or shuffled."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
    begin, end = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1)), F.concat(at, F.array(F.size(lines)))
    return F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda x: F.struct(x["b"].alias("at"), F.slice(lines, x["b"] + 1, x["e"] - x["b"]).alias("lines")))


def aligned(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, pos, left, right, verdict): two arrays paired by position, null where one has ended. `missing`: the right one has
    fewer, `surplus`: more, `nothing`: both are empty or null (one row). Positional nulls within an array are kept."""
    a, b = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (left, right))
    n, m = F.size(a), F.size(b)
    verdict = F.when((n == 0) & (m == 0), "nothing").when(n == m, "aligned").when(n > m, "missing").otherwise("surplus")
    pairs = df.select(key, verdict.alias("verdict"), F.posexplode_outer(F.arrays_zip(a.alias("left"), b.alias("right"))).alias("pos", "_x"))
    return pairs.select(key, F.col("pos").cast("long").alias("pos"), "_x.left", "_x.right", "verdict")
