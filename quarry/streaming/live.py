"""The live loop: records as they arrive, poison records set apart, and the latest place of each user kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def isolate(df: DataFrame, column: str, parse: Callable[[str], str], out: str = "parsed") -> DataFrame:
    """df with parse(column) and `error`: one that raises has a null result and its error, and takes no other with it."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done: list[str | None] = []
            errors: list[str | None] = []
            for x in pdf[column]:
                try:
                    done.append(parse(x))
                    errors.append(None)
                except Exception as e:  # a record may fail in any way
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: done, "error": errors})

    return df.mapInPandas(run, f"{schema},{out}:string,error:string")


def live_records(spark: SparkSession, source: str, sink: str, checkpoint: str, parse: Callable[[Column], Column], tags: dict[str, str] | None = None, after: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Watch a folder of documents: what parses goes to `sink`/good, what does not to `sink`/dead, each batch into a folder of
    its own that a repetition of the batch writes over, so every document is there once whatever dies when.

    `parse` makes a struct of the text, null for a document that is none. `tags` are constant columns of the session. `after` is
    called when both are written. Without `every` (an interval) the stream ends when all that is there is done."""
    docs = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).format("text").load(source)
    docs = docs.select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))
    held = [F.lit(v).alias(k) for k, v in (tags or {}).items()]

    def write(batch: DataFrame, number: int) -> None:
        read = batch.select("path", "text", parse(F.col("text")).alias("p"), *held).persist()
        try:
            read.where("p is not null").select("path", "p.*", *[k for k in tags or {}]).write.mode("overwrite").parquet(f"{sink}/good/batch={number}")
            why = F.when(F.trim("text") == "", "empty").otherwise("not a document")
            read.where("p is null").select("path", "text", why.alias("error"), *[k for k in tags or {}]).write.mode("overwrite").parquet(f"{sink}/dead/batch={number}")
        finally:
            read.unpersist()
        if after:
            after(batch, number)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class LatestPlace(StatefulProcessor):
    """Per key the place entered last by (ts, ord), whatever the order of arrival; a row for each change of it."""

    def __init__(self, excluded: str):
        self.excluded = excluded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ts timestamp, ord long, place string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.latest.get() if self.latest.exists() else None
        best = tuple(was) if was else None
        for pdf in rows:
            pdf = pdf[pdf["place"].notna()]
            pdf = pdf[~pdf["place"].str.endswith(self.excluded)]
            if len(pdf):
                top = pdf.sort_values(["ts", "ord"]).iloc[-1]
                mine = (top["ts"].to_pydatetime(), int(top["ord"]), str(top["place"]))
                if best is None or mine[:2] > (pd.Timestamp(best[0]).to_pydatetime().replace(tzinfo=mine[0].tzinfo), best[1]):
                    best = mine
        if best is not None and (was is None or best[1:] != tuple(was)[1:] or best[0] != was[0]):
            self.latest.update(best)
            yield pd.DataFrame({"key": [str(key[0])], "ts": [best[0]], "ord": [best[1]], "place": [best[2]]})

    def close(self) -> None:
        pass


def latest_places(events: DataFrame, key: str, excluded: str = "Hideout") -> DataFrame:
    """(key, ts, ord, place) whenever a key's latest place changes, of a stream with key, ts, ord, text; state outlives restarts
    in the state store. Late rows never undo a newer one."""
    from quarry.functions.text import entered_place

    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select(F.col(key).cast("string").alias("key"), "ts", F.col("ord").cast("long").alias("ord"), F.trim(entered_place(F.col("text"))).alias("place"))
    return rows.groupBy("key").transformWithStateInPandas(LatestPlace(excluded), "key string, ts timestamp, ord long, place string", "Update", "None")
