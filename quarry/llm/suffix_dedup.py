"""Suffix-array removal of long repeated strings.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in the same text or another.

1. Anchors. The first k-gram of least hash in a window of `length` bytes is its anchor, so equal windows have equal
   anchors at equal places. An anchor that occurs once shows that no window it stands for repeats. Only anchors' hashes
   are shuffled to be counted; a table of bits then tells which anchors of a text may repeat, and those are looked at.
2. Copies. Occurrences of an anchor for which the bytes of all windows it stands for are equal are one context, compared
   by 96 bits of two hashes, one modulo 2^64 and one modulo a prime; a context found twice repeats as a whole.
3. Suffix arrays. The other contexts of anchors that occur more than once are dealt to shards by anchor: small anchors
   by a hash, an anchor of over SMALL bytes to a shard of its own. A shard sorts its suffixes by Larsson-Sadakane
   refinement in numpy, gets common prefixes as Kasai does, and windows whose common prefix reaches `length` repeat. An
   anchor of over SHARD_BYTES is split over sub-shards, which are merged pair by pair: windows of one that are still
   single are searched in the suffix array of the other by bisection.

Everything is decided on the input texts, by anchors of all texts; equal texts (128 bits of hash) are one text with a
count. Texts without an anchor that may repeat are never shuffled. Nothing is capped; no task holds more than a batch, a
text's anchors, or a shard and what a few small anchors add to its mean size.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows are copies of each other. Texts below `length` bytes
keep everything. A long text is searched slice by slice. An empty table gives no rows. Other columns are passed through
by `remove_repeats`, whatever their names, but those named as results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from quarry.llm.common import U64, Bits, Stash, binary_rows, give_back, joined_values, mix, slices

GRAM = 32
SLICE = 1 << 17
SHARD_BYTES = 1 << 22
SMALL = 1 << 17
ANCHOR_BITS = 27
_BASE = 0x9E3779B97F4A7C15
_PRIME = 4294967291
_BASE_2 = 2654435761
_POWERS: dict[int, tuple[np.ndarray, ...]] = {}


def _modular(base: int, size: int) -> np.ndarray:
    """Powers modulo _PRIME."""
    out = np.ones(size, U64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, _PRIME)) % U64(_PRIME)
        have += more
    return out


def _powers(n: int) -> tuple[np.ndarray, ...]:
    """The bases' powers and their inverses, modulo 2^64 and modulo _PRIME, at least n of each."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        wide = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS[size] = (*wide, _modular(_BASE_2, size), _modular(pow(_BASE_2, -1, _PRIME), size))
    return _POWERS[size]


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over h[i : i + width], for each i that has it."""
    out, have = h, 1
    while 2 * have <= width:
        out, have = pick(out[: len(out) - have], out[have:]), 2 * have
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hashes c and d, lo, hi) in the joined bytes of texts that end at `ends`, in text order.

    lo and hi bound the bytes of all windows of which this gram is the first of least hash, so each window has one.
    """
    n, wide = len(data), length - GRAM + 1
    none = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < length:
        return none
    power, inverse, power_2, inverse_2 = _powers(n + 1)
    value = data.astype(U64) + U64(1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(value * power[:n])])
    grams = n - GRAM + 1
    h = mix((sums[GRAM:] - sums[:grams]) * inverse[:grams]) | U64(1)
    begins = np.concatenate([[0], ends[:-1]])
    stop = np.repeat(ends, ends - begins)
    at = np.arange(n)
    h[at[:grams] + GRAM > stop[:grams]] = U64(0xFFFFFFFFFFFFFFFF)
    least = _slide(h, wide, np.minimum)
    least[at[: len(least)] + length > stop[: len(least)]] = 0
    edge = np.zeros(wide - 1, U64)
    most = _slide(np.concatenate([edge, least, edge]), wide, np.maximum)
    p = np.flatnonzero(most == h)
    if not len(p):
        return none
    hp, text = h[p], np.searchsorted(ends, p, side="right")
    first, last = np.maximum(begins[text], p - wide + 1), np.minimum(p, ends[text] - length)
    for step, edge_of in ((-1, first), (1, last)):  # the nearest gram of lower hash (or, before it, of the same) ends the range
        todo, other = np.arange(len(p)), np.arange(len(p)) + step
        while True:
            inside = (other >= 0) & (other < len(p))
            todo, other = todo[inside], other[inside]
            near = np.abs(p[other] - p[todo]) < wide
            todo, other = todo[near], other[near]
            if not len(todo):
                break
            ends_it = hp[other] <= hp[todo] if step < 0 else hp[other] < hp[todo]
            i, j = todo[ends_it], other[ends_it]
            edge_of[i] = np.maximum(edge_of[i], p[j] + 1) if step < 0 else np.minimum(edge_of[i], p[j] - wide)
            todo, other = todo[~ends_it], other[~ends_it] + step
    good = first <= last
    p, hp, lo, hi = p[good], hp[good], first[good], last[good] + length
    shape = mix(((p - lo) * 4096 + (hi - p)).astype(U64))
    c = mix(mix((sums[hi] - sums[lo]) * inverse[lo]) ^ shape)
    sums_2 = np.concatenate([np.zeros(1, U64), np.cumsum(value * power_2[:n])]) % U64(_PRIME)  # at most 2^9 * 2^32 * 2^20: no overflow
    d = (sums_2[hi] + U64(_PRIME) - sums_2[lo]) % U64(_PRIME) * inverse_2[lo] % U64(_PRIME)
    return hp, c, d, lo, hi


def text_anchors(batch: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(index, (anchors, contexts c and d, lo, hi)) of each text of at least `length` bytes; long texts go slice by slice."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        ends = np.cumsum([len(x) for _, x in held])
        a, c, d, lo, hi = anchors(np.frombuffer(b"".join(x for _, x in held), np.uint8), ends, length)
        cut = np.concatenate([[0], np.searchsorted(lo, ends)])
        for j, (i, x) in enumerate(held):
            s = slice(cut[j], cut[j + 1])
            if s.stop > s.start:
                yield i, (a[s], c[s], d[s], lo[s] - (ends[j] - len(x)), hi[s] - (ends[j] - len(x)))

    for i, x in batch:
        if len(x) < length:
            continue
        if len(x) > 2 * SLICE:
            raw, found = np.frombuffer(x, np.uint8), []
            for b in range(0, len(x) - length + 1, SLICE):  # the windows that start here
                piece = raw[b : b + SLICE + length - 1]
                a, c, d, lo, hi = anchors(piece, np.array([len(piece)]), length)
                found.append((a, c, d, lo + b, hi + b))
            yield i, tuple(np.concatenate(z) for z in zip(*found, strict=True))
            continue
        held.append((i, x))
        size += len(x)
        if size >= SLICE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) by Larsson-Sadakane: groups equal in h bytes are refined by the ranks h further on."""
    n = len(data)
    key = np.zeros(n, U64)
    for i in range(7):  # the end sorts before any byte
        key <<= U64(9)
        key[: n - i] |= data[i:] + U64(1)
    sa = np.argsort(key).astype(np.int32)
    head = np.ones(n, bool)
    key = key[sa]
    head[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    h = 7
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_at):
            return sa, rank
        act = sa[open_at]
        after = act.astype(np.int64) + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[act].astype(U64) << U64(32)) | nxt.astype(U64)
        order = np.argsort(key)
        act, key = act[order], key[order]
        sa[open_at] = act
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_at] = new
        rank[act] = np.maximum.accumulate(np.where(new, open_at, 0))
        h *= 2


def big_endian(data: np.ndarray, more: int) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts as they do; `more` zero bytes follow the data."""
    out = np.zeros(len(data) + more, U64)
    for i in range(8):
        out <<= U64(8)
        out[: max(len(data) - i, 0)] |= data[i:]
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix of the array with the one before it, at most `cap`: Kasai, in lanes of text side by side."""
    n = len(data)
    words = big_endian(data, cap + 8)
    before = np.where(rank > 0, sa[np.maximum(rank - 1, 0)], -1).astype(np.int32)
    lanes = min(lanes, n)
    step = -(-n // lanes)
    out, start = np.zeros(n, np.int16 if cap < 1 << 15 else np.int32), np.arange(0, n, step)
    h = np.zeros(len(start), np.int64)
    for s in range(step):
        i = start + s
        live = np.flatnonzero(i < n)
        i, j = i[live], before[i[live]].astype(np.int64)
        k = np.where(j >= 0, np.maximum(h[live] - 1, 0), 0)
        limit = np.where(j >= 0, np.minimum(cap, n - np.maximum(i, j)), 0)
        todo = np.flatnonzero(k < limit)
        while len(todo):
            x = words[i[todo] + k[todo]] ^ words[j[todo] + k[todo]]
            k[todo] += np.where(x == 0, 8, np.minimum((64 - np.frexp(x.astype(np.float64))[1]) >> 3, 7))
            todo = todo[(x == 0) & (k[todo] < limit[todo])]
        k = np.minimum(k, limit)
        h[live] = k
        out[i] = k
    return out[sa]


class Shard:
    """Contexts of some anchors: their windows, which of them repeat, and the suffix array."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.length, n = length, pdf.ctx.map(len).to_numpy(np.int64)
        self.data = np.frombuffer(b"".join(pdf.ctx), np.uint8)
        starts, windows = np.cumsum(n) - n, np.maximum(n - length + 1, 0)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), windows)
        self.offset = (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        self.at = (starts[self.row] + self.offset).astype(np.int32)
        self.t, self.u, self.lo = (pdf[c].to_numpy(np.int64) for c in ("t", "u", "lo"))
        self.place = self.t.view(U64)[self.row] + (self.lo[self.row] + self.offset).astype(U64)
        self.twice = pdf.twice.to_numpy(bool)[self.row]
        self.single = np.ones(len(self.at), bool)
        if len(self.at):
            self.sa, self.rank = suffix_array(self.data)
            self._inside(common_prefixes(self.data, self.sa, self.rank, length))

    def _inside(self, prefix: np.ndarray) -> None:
        """A window repeats if another place, or a context found twice, has the same bytes. Equal windows are one run."""
        run = np.cumsum(prefix < self.length, dtype=np.int32)[self.rank[self.at]]
        order = np.argsort(run, kind="stable")
        place, head = self.place[order], np.ones(len(run), bool)
        head[1:] = run[order][1:] != run[order][:-1]
        first = np.flatnonzero(head)
        self.low, self.high = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
        self.run = np.empty(len(run), np.int32)
        self.run[order] = np.cumsum(head) - 1
        many = (self.low != self.high) | np.logical_or.reduceat(self.twice[order], first)
        self.single = ~many[self.run]

    def window_hashes(self) -> np.ndarray:
        """64 bits of each window: hashes of 8, 16, 32, ... bytes, of which a window is put together."""
        level, width = mix(big_endian(self.data, 0)), 8
        out, at = np.zeros(len(self.at), U64), self.at.astype(np.int64)
        for bit in range(3, self.length.bit_length()):
            if self.length >> bit & 1:
                out = mix(out) + level[at]
                at = at + width
            level = mix(level[: max(len(level) - width, 0)]) + level[width:]
            width *= 2
        return mix(out) + big_endian(self.data, 0)[self.at + self.length - 8]

    def merge(self, other: "Shard") -> None:
        """Bisect this shard's single windows in the suffix array of another shard; what is found repeats, unless it is the same place."""
        if not len(self.at) or not len(other.at):
            return
        mine = np.flatnonzero(self.single & np.isin(self.window_hashes(), other.window_hashes()))  # others cannot be found
        key, size = self.length, len(other.sa)
        a, b = big_endian(self.data, key + 8), big_endian(other.data, key + 8)

        def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether other's bytes at j are below the window at i."""
            out, todo = np.zeros(len(i), bool), np.arange(len(i))
            for k in range(0, key, 8):
                x, y = a[i[todo] + k], b[j[todo] + k]
                if k + 8 > key:
                    cut = U64(8 * (k + 8 - key))
                    x, y = x >> cut, y >> cut
                out[todo[y < x]] = True
                todo = todo[x == y]
                if not len(todo):
                    break
            return out

        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), size)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            below = less(self.at[mine[live]].astype(np.int64), other.sa[mid].astype(np.int64))
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        # the first suffix that is not below: the window is there if the next window at or after it has the same bytes
        order = np.argsort(other.rank[other.at])
        next_at = np.searchsorted(other.rank[other.at][order], lo)
        inside = next_at < len(order)
        mine, next_at = mine[inside], order[next_at[inside]]
        i, j, same = self.at[mine].astype(np.int64), other.at[next_at].astype(np.int64), np.ones(len(mine), bool)
        for k in range(0, key, 8):
            cut = U64(8 * max(k + 8 - key, 0))
            same &= a[i + k] >> cut == b[j + k] >> cut
        mine, run = mine[same], other.run[next_at[same]]
        self.single[mine] = (other.low[run] == self.place[mine]) & (other.high[run] == self.place[mine])

    def spans(self) -> pd.DataFrame:
        """(t, u, lo, hi) of repeated windows, joined where they touch, for contexts that are not whole copies anyway."""
        got = np.flatnonzero(~self.single & ~self.twice)
        row, off = self.row[got], self.offset[got].astype(np.int64)
        new = np.ones(len(got), bool)
        new[1:] = (row[1:] != row[:-1]) | (off[1:] > off[:-1] + self.length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(got))[: len(first)] - 1
        at = row[first]
        return pd.DataFrame({"t": self.t[at], "u": self.u[at], "lo": self.lo[at] + off[first], "hi": self.lo[row[last]] + off[last] + self.length}, dtype="int64")


def text_ids(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text as two signed numbers."""
    h = np.frombuffer(b"".join(xxh3_128_intdigest(x).to_bytes(16, "little") for x in data), "<i8").reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy()


def plain(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mark_texts(docs: DataFrame, text: str, length: int) -> DataFrame:
    """A row for each text: t and u (its 128 bits), size in bytes, and its anchors a, contexts c and d, lo and hi, packed;
    a text met before in the same task goes without."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # 16 bytes of each long text of the task
        for batch in it:
            for b in slices(batch, text):
                data = plain(b, text)
                t, u = text_ids(data)
                todo = []
                for i, k in enumerate(zip(t.tolist(), u.tolist(), strict=True)):
                    if len(data[i]) >= length and k not in met:
                        met.add(k)
                        todo.append((i, data[i]))
                made = dict(text_anchors(todo, length))
                none = (np.zeros(0, U64),) * 5
                cols = [joined_values([made.get(i, none)[j] for i in range(len(data))], "u8") for j in range(5)]
                packed = [binary_rows(x.astype(k), n) for (x, n), k in zip(cols, ("<u8", "<u8", "<u4", "<i4", "<i4"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(u), pa.array(list(map(len, data)), pa.int64()), *packed], names=["t", "u", "size", "a", "c", "d", "lo", "hi"])

    return docs.select(text).mapInArrow(mark, "t long, u long, size long, a binary, c binary, d binary, lo binary, hi binary")


def find_spans(docs: DataFrame, text: str, length: int, stash: Stash) -> DataFrame:
    """(t, u, pieces): for each distinct text that has some, its sorted repeated ranges, which may overlap."""
    texts = stash(mark_texts(docs, text, length), "anchors", codec="none")

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch, "a"):
                a, n = np.unique(np.frombuffer(b"".join(b.column("a").to_pylist()), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], names=["a", "n"])

    seen = texts.select("a").mapInArrow(hashes, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    many = Bits(seen, "a", ANCHOR_BITS)

    def repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch, "a"):
                a, c, d, lo, hi = (np.frombuffer(b"".join(b.column(x).to_pylist()), k) for x, k in zip(("a", "c", "d", "lo", "hi"), ("<i8", "<i8", "<u4", "<i4", "<i4"), strict=True))
                n = np.array([len(x) for x in b.column("a").to_pylist()], np.int64) >> 3
                some = np.flatnonzero(many.has(a))
                row = np.repeat(np.arange(len(n)), n)[some]
                t, u = b.column("t").to_numpy()[row], b.column("u").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[some], c[some], d[some].astype(np.int64), t, u, lo[some], hi[some])], names=["a", "c", "d", "t", "u", "lo", "hi"])

    sizes = texts.select("t", "u", "size")
    every = stash(texts.drop("size").mapInArrow(repeated, "a long, c long, d long, t long, u long, lo int, hi int"), "may-repeat")
    o = F.xxhash64("t", "u", "lo")
    once = every.groupBy("a").agg(F.min(o).alias("o1"), F.max(o).alias("o2"), F.min(F.struct("c", "d")).alias("c1"), F.max(F.struct("c", "d")).alias("c2")).where("o1 <> o2")
    held = stash(once.select("a", (F.col("c1") != F.col("c2")).alias("mixed")), "held")  # written, so that the join below can split a hot anchor
    again = stash(every.join(held, "a"), "repeated")
    stash.drop(every, held)
    whole = ["t", "u", "lo", "hi"]
    contexts = again.where("mixed").groupBy("a", "c", "d").agg(F.min(F.struct("t", "u", "lo", "hi")).alias("at"), (F.min(o) != F.max(o)).alias("twice"))
    contexts = stash(contexts.select("a", "c", "d", "at.*", "twice"), "contexts")
    copied = stash(contexts.where("twice").select("a", "c", "d"), "copied")
    pieces = again.where("not mixed").select(*whole).union(again.where("mixed").join(copied, ["a", "c", "d"]).select(*whole))
    copies = sizes.groupBy("t", "u").agg(F.count("*").alias("k"), F.max("size").alias("hi")).where(f"k > 1 and hi >= {length}")
    pieces = pieces.select("t", "u", F.col("lo").cast("long"), F.col("hi").cast("long")).union(copies.select("t", "u", F.lit(0).cast("long").alias("lo"), "hi"))

    wants = contexts.groupBy("t", "u").agg(F.collect_list(F.struct("a", "lo", "hi", "twice")).alias("want"))  # bounded by a text's anchors
    wants = stash(wants, "wanted")
    wanted = Bits(wants, "t")

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in it:
            for b in slices(batch, text):
                data = plain(b, text)
                t, u = text_ids(data)
                some = []
                for i in np.flatnonzero(wanted.has(t)).tolist():
                    if (k := (int(t[i]), int(u[i]))) not in met:
                        met.add(k)
                        some.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(t[some]), pa.array(u[some]), pa.array([data[i] for i in some], pa.binary())], names=["t", "u", "data"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch, "data"):
                rows = [(w["a"], t, u, w["lo"], w["twice"], x[w["lo"] : w["hi"]]) for t, u, x, want in zip(*(b.column(c).to_pylist() for c in ("t", "u", "data", "want")), strict=True) for w in want]
                made = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(z, k) for z, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["a", "t", "u", "lo", "twice", "ctx"])

    texts_wanted = docs.select(text).mapInArrow(fetch, "t long, u long, data binary")
    found = texts_wanted.join(wants, ["t", "u"]).select("t", "u", "data", "want").mapInArrow(cut, "a long, t long, u long, lo long, twice boolean, ctx binary")
    ctx = stash(found.dropDuplicates(["a", "t", "u", "lo"]), "bytes")
    stash.drop(wants)
    total = ctx.agg(F.sum(F.length("ctx"))).first()[0] or 0
    load = stash(ctx.groupBy("a").agg(F.sum(F.length("ctx")).alias("load")).where(f"load > {SMALL}"), "loads")
    shards = max(1, -(-4 * total // SHARD_BYTES))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Shard(pdf, length).spans()
        give_back()
        return out

    def two(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        if i == j:
            return one(pdf)
        left, right = Shard(pdf[pdf.salt == i], length), Shard(pdf[pdf.salt == j], length)
        left.merge(right), right.merge(left)
        out = pd.concat([left.spans(), right.spans()])
        del left, right
        give_back()
        return out

    spans = "t long, u long, lo long, hi long"
    loaded = ctx.join(load, "a", "left")
    own = F.col("load").isNotNull()
    usual = loaded.where(f"load is null or load <= {SHARD_BYTES}").withColumn("own", own).withColumn("shard", F.when(own, F.col("a")).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards))))
    in_shards = usual.groupBy("own", "shard").applyInPandas(one, spans)
    hot = loaded.where(f"load > {SHARD_BYTES}").withColumn("m", F.ceil(2 * F.col("load") / SHARD_BYTES).cast("int")).withColumn("salt", F.pmod(F.xxhash64("t", "u", "lo"), F.col("m")).cast("int"))
    dealt = hot.withColumn("other", F.explode(F.expr("sequence(0, m - 1)"))).withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other"))
    across = dealt.groupBy("a", "i", "j").applyInPandas(two, spans)
    pieces = pieces.union(in_shards).union(across)
    merged = pieces.groupBy("t", "u").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("pieces"))  # bounded by a text's length
    out = stash(merged, "spans")
    stash.drop(texts, again, contexts, copied, ctx, load)
    return out


def join_ranges(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in pieces:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_RANGE = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
_RESULTS = [T.StructField(k, t) for k, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", T.ArrayType(_RANGE)), ("kept_bytes", T.BinaryType()))]


def remove_repeats(docs: DataFrame, length: int = 200, with_bytes: bool = True, text: str = "text") -> DataFrame:
    """The input's columns but the text and those named as results, and n_bytes, n_removed, n_spans, kept_sha256, spans;
    kept_bytes unless switched off.

    Texts without repeats are finished where they are read; only the others are shuffled to their ranges.
    """
    stash = Stash(docs.sparkSession)
    found = find_spans(docs, text, length, stash)
    new = _RESULTS[: 5 + with_bytes]
    results = {f.name for f in new} | {text}
    keep = [c for c in docs.columns if c.lower() not in results]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).cast("string").alias("row"), F.col(text).alias("text"))
    some = Bits(found, "t")
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.binary())[: len(new)]

    def finished(row: pa.Array, texts: list[bytes], pieces: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        made = []
        for data, gone in zip(texts, pieces, strict=True):
            at, kept = 0, []
            for lo, hi in gone:
                kept.append(data[at:lo])
                at = hi
            left = b"".join([*kept, data[at:]]) if gone else data
            made.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in gone], left)[: len(new)])
        cols = list(zip(*made, strict=True)) or [()] * len(new)
        return pa.RecordBatch.from_arrays([row, *(pa.array(list(m), k) for m, k in zip(cols, kinds, strict=True))], names=["row", *(f.name for f in new)])

    def untouched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch):
                t, _ = text_ids(data := plain(b, "text"))
                at = np.flatnonzero(~some.has(t))
                yield finished(b.column("row").take(pa.array(at)), [data[i] for i in at.tolist()], [[]] * len(at))

    def touched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch):
                t, u = text_ids(plain(b, "text"))
                at = np.flatnonzero(some.has(t))
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at)), b.column("text").take(pa.array(at)), pa.array(t[at]), pa.array(u[at])], names=["row", "text", "t", "u"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch):
                yield finished(b.column("row"), plain(b, "text"), [join_ranges([(p["lo"], p["hi"]) for p in x or ()]) for x in b.column("pieces").to_pylist()])

    row = rows.schema["row"]
    out = T.StructType([row, *new])
    more = T.StructType([row, T.StructField("text", T.StringType()), T.StructField("t", T.LongType()), T.StructField("u", T.LongType())])
    left = rows.mapInArrow(touched, more).join(found, ["t", "u"], "left").select("row", "text", "pieces").mapInArrow(cut, out)
    both = rows.mapInArrow(untouched, out).union(left)
    return both.select(*([F.col(f"row.`{c}`").alias(c) for c in keep]), *(f.name for f in new))
