"""Shared helpers: tables, scratch space, byte-bounded batches, words and their hashes, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import shared_folder, ship

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Stash:
    """Tables written in the shared folder, so that later stages reread them instead of recomputing after a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = ship(spark), f"{shared_folder(spark)}/quarry-{uuid.uuid4().hex}", 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{tag}"

    def __call__(self, df: DataFrame, tag: str, codec: str = "zstd", **options: object) -> DataFrame:
        path = self.path(tag)
        was = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")  # what was shuffled for a table that is written is not read again
        try:
            df.write.option("compression", codec).options(**options).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, was) if was is not None else self.spark.conf.unset(_CLEAN)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            if path := getattr(df, "_stash_path", None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the table does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def text_key(*cols: Column | str) -> Column:
    """128 bits of some columns, as 16 bytes: equal for equal rows, nulls apart from empty texts."""
    made = F.concat_ws("", *(F.coalesce(F.concat(F.lit("+"), F.length(F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(":"), F.col(c) if isinstance(c, str) else c), F.lit("-")) for c in cols))
    return F.unhex(F.md5(made.cast("binary")))


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on between tasks, and by default keep what they freed.
    Where the C library cannot do so only Arrow's pool is returned."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in turns of at most `most` bytes of a column, or one row where that alone has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values on end, their bounds); a null is empty."""
    a = column.cast(pa.large_binary())
    a = pc.fill_null(a, b"") if a.null_count else a
    _, offsets, data = a.buffers()
    bounds = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(index of each word in the distinct words, the distinct words as bytes, words of each text); words are cut at ASCII white space."""
    data, bounds = joined_bytes(column)
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    blank = _SPACE[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    begin[first] = ~blank[first]
    end = ~blank
    end[:-1] &= blank[1:]
    last = np.append(first[1:], len(data)) - 1 if len(first) else first
    end[last] = ~blank[last]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    offsets = np.concatenate([[0], np.cumsum(end - begin + 1)])
    body = data[~blank]
    body = _LOWER[body] if lower else body
    coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.diff(np.searchsorted(begin, bounds))


def hash_words(words: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def rolled(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive word hashes from each place."""
    h = np.full(len(at), n, U64)
    for i in range(n):
        h = mix(h) + w[at + i] * GOLD
    return mix(h)


def joined_values(values: list[np.ndarray], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values on end, number of each)."""
    return np.concatenate([np.zeros(0, kind), *values]), np.array(list(map(len, values)), np.int64)


def binary_rows(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value of each run of `sizes` items."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


class Bits:
    """A table of 2^n bits that tells which 64-bit keys may be in a column. It is of fixed size whatever the column, built by
    an aggregate of at most 2^(n - 6) rows, and may say yes for a key that is not there, never no for one that is."""

    def __init__(self, df: DataFrame, key: str, n: int = 26):
        self.n = n
        low = F.expr(f"`{key}` & {(1 << n) - 1}")
        words = df.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(1 << (n - 6), np.int64)
        table[words.column("w").to_numpy()] = words.column("b").to_numpy()
        self.held = df.sparkSession.sparkContext.broadcast(table.view(U64))

    def __getstate__(self) -> dict:
        return {"n": self.n, "held": self.held}

    def has(self, keys: np.ndarray) -> np.ndarray:
        low = keys.view(np.int64) & ((1 << self.n) - 1)
        return (self.held.value[low >> 6] >> (low & 63).astype(U64)) & U64(1) == 1


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, on end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def components(stash: Stash, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root): smallest node reachable, for every node with an edge (a, b), by alternating large-star and small-star.

    Work per round is linear in the edges and every step is a partial aggregate or an equi-join; each round is one
    written table. Only two numbers per round reach the driver. It ends when a round changes nothing; if `rounds` are
    given and do not suffice, it raises.
    """
    from pyspark.sql import Observation

    def keep(df: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        out = stash(df.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), mark), tag)
        return out, (seen.get["n"], seen.get["h"])

    e, mark = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for i in count():
        if not mark[0]:
            break
        if i == rounds:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        before, (e_new, now) = mark, keep(small, f"star{i}")
        stash.drop(e)
        e, mark = e_new, now
        if now == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over integers 0..n-1, smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
