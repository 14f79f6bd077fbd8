"""Vectors of images by a model that the user supplies, one session in each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.pixels import image, prepared
from quarry.sources.tables import exists

#: A model goes to every executor, so its file may have so many bytes; a larger one raises.
MOST_BYTES = 512 << 20
#: Images that go through the model at once.
TOGETHER = 16
_SESSIONS: dict[str, object] = {}


def model_bytes(spark: SparkSession, path: str | None) -> bytes | None:
    """The model's file, None if there is none."""
    if path is None or not exists(spark, path):
        return None
    found = spark.read.format("binaryFile").load(path)
    if found.agg(F.max("length")).first()[0] > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return bytes(found.select("content").first()[0])


def session(data: bytes, name: str):
    """This worker's session of a model, made at its first use; another model takes its place."""
    if name not in _SESSIONS:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark runs a task a core
        _SESSIONS.clear()
        _SESSIONS[name] = onnxruntime.InferenceSession(data, options, providers=["CPUExecutionProvider"])
    return _SESSIONS[name]


def embed(images: DataFrame, path: str | None) -> DataFrame:
    """(id, vector): a vector of length 1 for every colour image (id, height, width, pixels; three bytes a pixel).

    Null for a row that is no image or whose vector has no length, and for all rows if there is no model: whoever compares
    the vectors then finds nothing, as when nothing is alike. The first output of the model is taken, as it comes."""
    spark = images.sparkSession
    data = model_bytes(spark, path)
    if data is None:
        return images.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    name, model = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                read = [image(d, h, w, 3) for d, h, w in zip(*(part.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True)]
                out: list[np.ndarray | None] = [None] * len(read)
                have = [i for i, x in enumerate(read) if x is not None]
                if have:
                    run_of = session(model.value, name)
                    made = run_of.run(None, {run_of.get_inputs()[0].name: np.stack([prepared(read[i]) for i in have])})[0]
                    for i, v in zip(have, made.reshape(len(have), -1), strict=True):
                        length = np.linalg.norm(v)
                        out[i] = v / length if length > 0 else None
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(out, pa.list_(pa.float32()))], names=["id", "vector"])

    return images.select("id", "height", "width", "pixels").mapInArrow(run, "id long, vector array<float>")
