"""Cost-balanced packing of documents into sequences of at most `capacity` tokens.

The cost of a piece of n tokens is linear * n + quadratic * n * n (attention). Documents are dealt by a hash to shards
of about SHARD documents, so no task or driver holds more than a bounded group. In a shard a document longer than a
sequence is cut into full sequences and a remainder; then, in descending length, each piece goes to the open sequence
of lowest cost that still has room. Pieces that fit nowhere are cut at multiples of `STEP` tokens to fill what is left,
so padding stays under about STEP / 2 tokens a sequence.

Nulls: a null text is empty and gives a document of its end id alone; a null doc_id is kept. Repeated rows are packed
each on their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Stash, slices
from quarry.llm.tokens import default_tokenizer, piece_ids

STEP = 64
SHARD = 2048
POLY = 0xEDB88320
PIECES = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial (bit-reversed, as zlib keeps them)."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ POLY if b & 1 else b >> 1
    return out


@functools.lru_cache(4096)
def _shift(n: int) -> int:
    """x to the power 8 n modulo the polynomial."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(square, out)
        square, n = _times(square, square), n >> 1
    return out


def crc_of_suffix(crc_prefix: int, crc_whole: int, n_bytes: int) -> int:
    """CRC-32 of the last n_bytes of a string, from those of the whole and of what comes before them."""
    return crc_whole ^ (_times(_shift(n_bytes), crc_prefix) if crc_prefix else 0)


def measure_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n tokens, crcs: CRC-32 of the ids before every STEP-th token and of all of them; no: a number of the row, so that
    equal rows can be dealt apart."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step, first = piece_ids(tokenizer), 4 * STEP, TaskContext.get().partitionId() << 40
        for batch in it:
            for b in slices(batch):
                ids, n = held.encode_ended(b.column("text"), end_id)
                raw, crcs = memoryview(ids.tobytes()), []
                ends = 4 * np.cumsum(n)
                for begin, end in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True):
                    crc, marks = 0, [0]
                    for i in range(begin, end, step):
                        crc = zlib.crc32(raw[i : min(i + step, end)], crc)
                        marks.append(crc)
                    crcs.append(np.array(marks, "<u4").tobytes())
                no = np.arange(first, first + len(crcs))
                first += len(crcs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(crcs, pa.binary()), pa.array(no)], names=["doc_id", "n", "crcs", "no"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, crcs binary, no long")


def pack_lengths(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths."""
    out: list[tuple[int, int, int, int, int]] = []
    n_seq, items = 0, []
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity * capacity
        for s in range(0, full, capacity):
            out.append((d, s, capacity, n_seq, 0))
            n_seq += 1
        if n > full:
            items.append((n - full, d, full))
    if not items:
        return out
    items.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(x[0] for x in items) // capacity)
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    late = []

    def put(b: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, n_seq + b, capacity - int(room[b])))
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n

    for n, d, start in items:
        b = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[b] >= n:
            put(b, d, start, n)
        else:
            late.append((n, d, start))
    for n, d, start in late:
        while n:
            b = int(np.argmax(room))
            if room[b] < min(n, STEP):
                room, cost = np.append(room, capacity), np.append(cost, 0.0)
                b = len(room) - 1
            take = n if room[b] >= n else int(room[b]) // STEP * STEP
            put(b, d, start, take)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost."""
    if capacity % STEP:
        raise ValueError(f"capacity must be a multiple of {STEP}")
    stash = Stash(docs.sparkSession)
    sized = stash(measure_documents(docs, tokenizer or default_tokenizer(), end_id), "sizes")
    shards = max(1, -(-sized.count() // SHARD))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n", "crcs"], kind="stable", ignore_index=True)
        ids, lengths, base = pdf.id.tolist(), pdf.n.to_numpy(np.int64), int(pdf.shard.iloc[0]) << 32
        rows = []
        for d, start, n, seq, offset in pack_lengths(lengths, capacity, linear, quadratic):
            crcs = np.frombuffer(pdf.crcs.iat[d], "<u4")
            before, upto = int(crcs[start // STEP]), int(crcs[-(-(start + n) // STEP)])
            rows.append((ids[d], start, n, crc_of_suffix(before, upto, 4 * n), int(lengths[d]), base + seq, offset, linear * n + quadratic * n * n))
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PIECES.split(", ")])

    shard = F.pmod(F.xxhash64("doc_id", "n", "crcs", "no"), F.lit(shards)).alias("shard")
    dealt = sized.select(F.col("doc_id").cast("string").alias("id"), "n", "crcs", shard)  # pandas has no integer column with nulls
    pieces = dealt.groupBy("shard").applyInPandas(place, PIECES)
    return pieces.select(F.col("id").cast("long").alias("doc_id"), *pieces.columns[1:])
