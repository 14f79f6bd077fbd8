"""Product quantisation of vectors in exact integers, by a tree of sums over columnar blocks.

A component x counts as floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts; each part position has a codebook
that starts as that part of the ENTRIES smallest vec_ids. A round assigns every part to its nearest entry (squared distance,
ties to the lower index) and replaces each used entry by the floored mean of its parts. Vectors lie in written blocks of at
most BLOCK, dimension by dimension, so a task adds up distances of a whole block one dimension at a time; sums and counts
(PARTS * ENTRIES * width integers, whatever the input) are merged by a reduction tree, of which the driver gets the top.
Every round reads the same written blocks, so a lost executor costs its blocks alone.

Left out: null vectors, vectors with a null, NaN or infinite component, and vectors whose length is not that of the first
vector by (vec_id, vector) whose length is a positive multiple of PARTS. Components count as at most `limit(length)` in
size (134 million, or 32768 before scaling, at 64 dimensions), so that no sum of squares overflows. Null vec_ids come
last among the first entries and are encoded like others; repeated rows count each; with fewer than ENTRIES vectors there
are fewer entries. Null labels are one label. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Stash

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 2048
_HEX = np.array([b"%02x" % i for i in range(256)], "S2")


def limit(length: int) -> int:
    """Largest size of an integer component: squared differences of a vector then sum to at most 2^62, and it fits 31 bits."""
    return min(isqrt((1 << 62) // length) // 2, (1 << 31) - 1)


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, embedding, label) of the vectors that have finite components only and a length that can be cut."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return vectors.select(F.col("vec_id").cast("long"), x, F.col("label").cast("long")).where((F.size(x) > 0) & (F.size(x) % parts == 0) & finite)


def integers(rows: np.ndarray, most: int, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows.astype(np.float64) * scale), -most, most).astype(np.int64)


def first_entries(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of the smallest vec_ids; None if there is no vector. The driver gets `entries` rows."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = kept.orderBy(*order).select("embedding").first()
    if head is None:
        return None
    length = len(head[0])
    rows = kept.where(F.size("embedding") == length).orderBy(*order).limit(entries).select("embedding").collect()
    x = integers(np.array([r[0] for r in rows]), limit(length), scale)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def blocks(stash: Stash, kept: DataFrame, length: int, scale: int = SCALE) -> DataFrame:
    """Written blocks: vec_id and label lists, and x: 32-bit integers, dimension by dimension."""
    schema = pa.schema([("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks])
        x = integers(flat.reshape(-1, length), limit(length), scale).astype("<i4").T
        lists = [pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], schema=schema)

    same = kept.where(F.size("embedding") == length)
    made_blocks = same.mapInArrow(run, "vec_id array<long>, label array<long>, x binary")
    return stash(made_blocks, "blocks", **{"parquet.block.size": 16 << 20})


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of the columns of x, (width, n), by a codebook, (entries, width)."""
    far = np.zeros((len(book), x.shape[1]), np.int64)
    for d in range(len(x)):
        step = x[d] - book[:, d, None]
        far += step * step
    code = far.argmin(0)
    return code, far[code, np.arange(len(code))]


def cut(data: bytes, parts: int, width: int) -> np.ndarray:
    """(part, dimension, vector)."""
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(parts, width, -1)


def one_round(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round over all blocks."""
    parts, _, width = books.shape

    def add(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        for m, x in enumerate(cut(row.x, parts, width)):
            code, _ = nearest(x, books[m])
            np.add.at(total[0][m], code, x.T)
            np.add.at(total[1][m], code, 1)
        return total

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
    sums, counts = held.select("x").rdd.treeAggregate(zero, add, merge, 2)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def fit(held: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after the rounds; one that changes nothing is the last, since all later ones would not either."""
    for _ in range(rounds):
        before, books = books, one_round(held, books)
        if (before == books).all():
            break
    return books


def encode(held: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over the parts) of every vector."""
    parts, _, width = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                found = [nearest(x, books[m]) for m, x in enumerate(cut(batch.column("x")[i].as_py(), parts, width))]
                code = _HEX[np.stack([c for c, _ in found], 1)].view(f"S{2 * parts}")[:, 0]
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(code.astype(str)), pa.array(error)], schema=schema)

    return held.mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The columns of codes and `approximate`, the entries of its code put end to end, as array<double>."""
    table = F.array(*[F.array(*[F.array(*[F.lit(v / scale) for v in entry]) for entry in book]) for book in books.tolist()])
    part = lambda m: F.element_at(F.element_at(table, m + 1), F.conv(F.substring("code", 2 * m + 1, 2), 16, 10).cast("int") + 1)
    return codes.withColumn("approximate", F.concat(*[part(m) for m in range(len(books))]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error, label_error, codebooks_sha256 of every usable vector; the final codebooks, None if there is no such vector)."""
    stash = Stash(vectors.sparkSession)
    kept = usable(vectors)
    books = first_entries(kept)
    if books is None:
        none = vectors.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long, label_error long, codebooks_sha256 string")
        return none, None
    held = blocks(stash, kept, PARTS * books.shape[2])
    books = fit(held, books)
    coded = stash(encode(held, books), "coded")
    stash.drop(held)
    summed = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(summed, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("codebooks_sha256", F.lit(digest(books))), books
