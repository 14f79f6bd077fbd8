"""Readers: parquet tables, JSON dimensions with an explicit order, documents with a preferred source, drift-guarded TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of a JSON array of strings in one file; an absent file is an empty list."""
    kind = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("value", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "value"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(ord, key, value) of a JSON object in one file, in its order; `value` is the values' type."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"ord int, key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    keys = whole.select("value", F.posexplode(F.json_object_keys("value")).alias("ord", "key"))
    return keys.select("ord", "key", F.from_json("value", f"map<string,{value}>")[F.col("key")].alias("value"))


def string_or_list(c: Column) -> Column:
    """A field that holds a string or a JSON array of strings, as an array."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c)))


def prefer(df: DataFrame, key: str, source: str, best: str, valid: Column) -> DataFrame:
    """One row per key: of the valid ones, that of the best source, then by source name."""
    w = Window.partitionBy(key).orderBy((F.col(source) != best).cast("int"), source)
    return df.where(valid).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_tsv(df: DataFrame, path: str, stamp: str) -> str:
    """Append rows; if the folder holds other columns, it is set aside under a stamp and a new one begun."""
    spark = df.sparkSession
    if exists(spark, path):
        header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
        if header != df.columns:
            old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{stamp}"))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)
    df.write.mode("append").option("sep", "\t").option("header", True).csv(path)
    return path
