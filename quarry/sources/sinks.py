"""Outputs that are rebuilt as a whole: generations behind one pointer, ordered JSON, hand-kept files that nothing touches.

A rebuild writes all outputs into a new generation and then replaces the file CURRENT, which names it, in one rename. Until
that rename readers see the old generation, whole; after it the new one, whole. A job that dies leaves a generation that
nothing names, which the next rebuild clears. Files beside the generations belong to people and are never written over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import exists

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in place only when it is whole."""
    fs, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, hadoop.Path(path), over)


def read_small(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()[0].strip() if exists(spark, path) else None


def bootstrap(spark: SparkSession, path: str, text: str = "{}\n") -> bool:
    """Begin a hand-kept file if there is none; what is there stays. Tells whether it was begun."""
    if exists(spark, path):
        return False
    write_small(spark, path, text)
    return True


def rebuild(spark: SparkSession, folder: str, outputs: dict[str, Callable[[str], None]]) -> str:
    """Write every output (name to a function of its path) into a new generation, name it in CURRENT, clear the others. Returns the generation's folder."""
    before = read_small(spark, f"{folder}/{POINTER}")
    new = f"generation={uuid.uuid4().hex}"
    for name, write in outputs.items():
        write(f"{folder}/{new}/{name}")
    write_small(spark, f"{folder}/{POINTER}", new)
    fs, p = _fs(spark, folder)
    for x in fs.listStatus(p):
        at = x.getPath()
        if x.isDirectory() and at.getName().startswith("generation=") and at.getName() not in (new, before):
            fs.delete(at, True)  # readers may still be in the last one; it goes with the next rebuild
    return f"{folder}/{new}"


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the generation that readers should use; None before the first rebuild."""
    name = read_small(spark, f"{folder}/{POINTER}")
    return f"{folder}/{name}" if name else None


def write_json_lines(df: DataFrame, path: str, *order) -> None:
    """One object a line, in order over all files, nulls written, lines ended by LF whatever the system."""
    df.orderBy(*order).write.option("lineSep", "\n").option("ignoreNullFields", False).json(path)


def write_json_map(df: DataFrame, path: str, key: str, order: str, note: str | None = None) -> None:
    """One JSON object of the key column to an object of the others, in order, in one file with LF. A definition is small; it
    is streamed through one task, never held whole."""
    rest = [c for c in df.columns if c not in (key, order)]
    # an array of one value is the way to have Spark quote a string as JSON
    quoted = F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)
    lines = df.select(F.col(order).alias("ord"), F.concat(F.lit("  "), quoted, F.lit(": "), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("value"))
    head = "{\n" + (f'  "note": "{note}"' if note else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = bool(note)
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for b in it:
            out = []
            for v in b.column("value").to_pylist():
                out.append((",\n" if begun else "") + v)
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["\n}\n"])], names=["value"])

    one = lines.repartition(1).sortWithinPartitions("ord").select("value")
    one.mapInArrow(run, "value string").write.option("lineSep", "\u0000").text(path)


def write_documents(df: DataFrame, path: str, key: str, lines: str) -> None:
    """A folder for each key, with its lines ended by CRLF."""
    df.select(key, F.array_join(lines, "\r\n").alias("value")).repartition(key).write.partitionBy(key).option("lineSep", "\r\n").text(path)


def export_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    """(key, vector of length 1 in doubles) of every named reference, in order of the key; those nobody has named are left out,
    and so are vectors without a length."""
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    named = df.where(~F.startswith(F.col(key).cast("string"), F.lit("unlabeled_"))).select(key, x.alias(vector), length.alias("_n")).where("_n > 0")
    named.select(key, F.transform(vector, lambda v: v / F.col("_n")).alias(vector)).orderBy(key).write.mode("overwrite").parquet(path)
