"""Token-ID output: canonical length-limited Huffman files of token ids.

`write_tokens` encodes every text once, counting all ids as it goes, fits one canonical code of at most 16 bits per id by
package-merge over the global counts, and writes files in ascending document order: a file is a parquet container of
independent blocks, each with its documents, its bit stream and a bit offset for every `STEP` ids. `read_tokens` decodes
blocks by one table look-up per id, all checkpoints of a block in lockstep.

Nulls: a null text is empty, a null doc_id sorts first and is kept. Repeated rows are kept, ordered by the checksum of
their ids. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Stash, binary_rows, slices
from quarry.llm.tokens import default_tokenizer, piece_ids

LIMIT = 16
STEP = 256
BLOCK = 1 << 19
FILE_IDS = 8_000_000
BLOCKS = "file int, block int, start long, n_docs int, n_ids int, docs binary, known binary, lens binary, marks binary, bits binary, n_bits long, book binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (0: id not used), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this length limit")
    order = used[np.lexsort((used, counts[used]))]
    leaf = counts[order].astype(np.int64)
    flags, merged = [], leaf
    flags.append(np.ones(len(leaf), bool))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        flags.append(at < len(leaf))
    take, lens = 2 * (len(leaf) - 1), np.zeros(len(leaf), np.int64)
    for f in reversed(flags):
        leaves = int(f[:take].sum())
        lens[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lens
    return out


def canonical(lens: np.ndarray) -> np.ndarray:
    """Canonical codes: ascending by (length, id)."""
    codes = np.zeros(len(lens), np.uint64)
    used = np.flatnonzero(lens)
    order = used[np.lexsort((used, lens[used]))]
    if len(order):
        size = np.uint64(1) << (np.uint64(LIMIT) - lens[order].astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
        codes[order] = first >> (np.uint64(LIMIT) - lens[order].astype(np.uint64))
    return codes


def pack_bits(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(bit stream, its bits, bit offsets of every STEP-th id)."""
    n = lens[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(n.sum())
    word, shift = at >> 6, 64 - (at & 63) - n
    code = codes[ids]
    left = code << np.maximum(shift, 0).astype(np.uint64)
    over = np.flatnonzero(shift < 0)
    left[over] = code[over] >> (-shift[over]).astype(np.uint64)
    out = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(left, first)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], total, at[::STEP].copy()


def decode_table(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each LIMIT-bit prefix."""
    used = np.flatnonzero(lens)
    order = used[np.lexsort((used, lens[used]))]
    reps = (1 << (LIMIT - lens[order].astype(np.int64))) if len(order) else np.zeros(0, np.int64)
    sym, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    n = int(reps.sum())
    sym[:n], size[:n] = np.repeat(order, reps), np.repeat(lens[order].astype(np.int64), reps)
    return sym, size


def unpack_bits(bits: bytes, n_ids: int, marks: np.ndarray, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    quad = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((STEP, len(marks)), np.uint32)
    at, last = marks.astype(np.int64), 8 * len(bits)
    for i in range(min(STEP, n_ids)):
        peek = (quad[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[i] = sym[peek]
        at = np.minimum(at + size[peek], last)
    return out.T.ravel()[:n_ids]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit where the vocabulary allows, else 32-bit), crc of the 32-bit ids, and on
    the last row of each slice the ids that the slice has, with their counts."""
    names = ["doc_id", "ids", "crc", "used", "counts"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = piece_ids(tokenizer)
        kind = id_kind(max(held.size, end_id + 1))
        for batch in it:
            for b in slices(batch):
                ids, n = held.encode_ended(b.column("text"), end_id)
                raw, ends = memoryview(ids.tobytes()), np.cumsum(n)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                found = np.bincount(ids)
                used = np.flatnonzero(found)
                last = [None] * (len(n) - 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), binary_rows(ids.astype(kind), n), pa.array(crcs, pa.int64()), pa.array([*last, used.astype("<u4").tobytes()], pa.binary()), pa.array([*last, found[used].astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, crc long, used binary, counts binary")


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, path: str | None = None) -> str:
    """Write the files of all documents; returns their folder (in the shared scratch folder where none is given)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = id_kind(size)
    stash = Stash(spark)
    coded = stash(encode_documents(docs, tokenizer, end_id), "ids")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in it:
            for used, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(used, "<u4")] += np.frombuffer(n, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    per_slice = coded.select("used", "counts").where("used is not null")
    found = per_slice.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)  # at most one row per id of the vocabulary
    for r in found:
        counts[r.id] = r.n
    lens = code_lengths(counts)
    files = max(1, -(-int(counts.sum()) // FILE_IDS))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, file = canonical(lens), TaskContext.get().partitionId()
        names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split(" ")[0], types[x.split(" ")[1]]) for x in BLOCKS.split(", ")])
        held: list[tuple[int | None, np.ndarray]] = []  # at most BLOCK ids and a document
        state = {"n": 0, "block": 0, "start": 0}

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            bits, n_bits, marks = pack_bits(ids, lens, codes)
            known = np.array([d is not None for d, _ in held], np.uint8)
            row = [file, state["block"], state["start"], len(held), len(ids), np.array([d or 0 for d, _ in held], "<i8").tobytes(), known.tobytes(), np.array([len(x) for _, x in held], "<u4").tobytes(), marks.astype("<u8").tobytes(), bits, n_bits, lens.tobytes() if state["block"] == 0 else None]
            state["block"] += 1
            state["start"] += len(ids)
            state["n"] = 0
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)

        for batch in it:
            for b in slices(batch, "ids"):
                for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    held.append((d, np.frombuffer(x, kind)))
                    state["n"] += len(held[-1][1])
                    if state["n"] >= BLOCK:
                        yield flush()
        if held:
            yield flush()

    out = path or stash.path("files")
    ordered = coded.select("doc_id", "ids", "crc").repartitionByRange(files, "doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(out)
    stash.drop(coded)
    return out


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids unless switched off."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    book = stored.where("block = 0").select("book").first()
    lens = np.frombuffer(bytes(book[0]), np.uint8) if book else np.zeros(0, np.uint8)
    names = ["file", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym, size = decode_table(lens)
        for b in it:
            for r in (row for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
                ids = unpack_bits(r["bits"], r["n_ids"], np.frombuffer(r["marks"], "<u8"), sym, size).astype("<u4")
                n = np.frombuffer(r["lens"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                parts = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                docs = pa.array(np.frombuffer(r["docs"], "<i8"), mask=np.frombuffer(r["known"], np.uint8) == 0)
                cols = [pa.array(np.full(len(n), r["file"], np.int32)), docs, pa.array(r["start"] + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in parts], pa.list_(pa.int64()))] if with_ids else []), names=names)

    kinds = "file int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = stored.select("file", "start", "n_ids", "docs", "known", "lens", "marks", "bits").mapInArrow(decode, kinds)
    # one row per file: file totals are few, and their running sum is the start of each file
    per_file = stored.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = per_file.select("file", F.expr("sum(n) over (order by file) - n").alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
