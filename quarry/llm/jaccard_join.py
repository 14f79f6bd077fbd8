"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct shingles of `n` words as 64-bit hashes. Equal sets are collapsed first, by an
aggregate over (size, 128-bit digest). All shingles have one global order: those that are not frequent by hash, then the
frequent ones by count, which is exact for the low hashes that prefixes come from; a pair at the threshold must share one of the first shingles of both (prefix filter) and have
like sizes. That order is cut into FRAGMENTS vertical fragments. Two sets differ in a fragment by what its sizes differ by
at least, and the sum of that over the fragments may not exceed what the threshold lets them differ by in all: pairs that
fail are not made. Then the first fragment's shingles screen candidates in the same way. For those left, every fragment's
overlap is counted on its own and the partial counts are summed per pair.

Components need a spanning forest of the links only, so candidates come in three steps, each of them exact. First, sets
that share a prefix shingle with up to NARROW others are compared with them, and in a larger group with one pivot, the
least of the group. Then, in groups whose members are not all linked yet, those of different components are compared:
in pairs in a group of up to WIDE; in a larger one, such as unlike copies of a form, in blocks of about BLOCK sets.
There the members outside the largest component meet all others in tasks for pairs of blocks, which add up the overlaps
of all their pairs fragment by fragment in memory and return only a spanning forest of the links. Nothing is capped. The table of
frequent shingles has at most FREQUENT rows (which ones only changes the order, never the result), and the table that
tells texts whose fragments are wanted has 2^MARK_BITS bits whatever the corpus (a wrong yes is dropped by the join that
follows); both are broadcast.

Nulls: a null text has no shingles, n_shingles 0, and links with nothing; a null doc_id is kept and never names a
component unless all its members are null. Repeated rows and repeated doc_ids are members of their sets' classes. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import GOLD, U64, Bits, Forest, Stash, components, hash_words, mix, rolled, runs, slices, split_words

FREQUENT = 400_000
FRAGMENTS = 8
ROUND = 2  # fragments that are compared at a time
LOCAL = 4  # a shingle is looked at as frequent if some part of the input has it so often,
REACH = 1.5  # or if its hash is below so many times the share of a set that is its prefix
NARROW = 8
WIDE = 128
LISTED = 16  # tokens of a set that tell where a pair is made
BLOCK = 384
MARK_BITS = 26
_SIEVE = 23  # bits of the table that tells most shingles that are not frequent


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of the n-word shingles of all texts on end, number of each text's); the whole sequence as one if it has fewer words."""
    index, words, count = split_words(column, lower=True)
    w = hash_words(words)[index]
    start = np.cumsum(count) - count
    size = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    flat, first = np.empty(size.sum(), U64), np.cumsum(size) - size
    long = count >= n
    flat[runs(first[long], size[long])] = rolled(w, runs(start[long], size[long]), n)
    for m in range(1, n):
        some = count == m
        flat[first[some]] = rolled(w, start[some], m)
    for a, b in zip(first.tolist(), (first + size).tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[first[size > 0]] = True
    return flat[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.append(first, len(flat))])


def digests(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    at, out = (np.cumsum(size) - size)[size > 0], []
    for seed in (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)):
        d = np.zeros(len(size), U64)
        d[size > 0] = np.add.reduceat(mix((flat ^ seed) * GOLD), at) if len(at) else 0
        out.append(mix(d + size.astype(U64)).view(np.int64))
    return out[0], out[1]


def frequent(docs: DataFrame, n: int, num: int, den: int, stash: Stash) -> np.ndarray:
    """Hashes of frequent shingles, ascending by count. The range of low hashes that most prefixes come from is counted in full,
    so that what is frequent there is known however thinly it is spread; the rest where a part of the input has it LOCAL times."""
    low = U64(min(int(REACH * (den - num) / den * 2**64), 2**64 - 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            some = (c >= LOCAL) | (u < low)
            return pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names=["h", "n"])

        for batch in it:
            for b in slices(batch):
                held.append(shingle_sets(b.column("text"), n)[0])
                size += len(held[-1])
                if size >= 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16")
    top = stash(rows.orderBy(F.desc("n"), "h").limit(FREQUENT), "frequent").toArrow()
    h = top.column("h").to_numpy().view(U64)
    return h[np.lexsort((h, top.column("n").to_numpy()))]


def describe(docs: DataFrame, n: int, num: int, den: int, often: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key (of the row), d1 and d2 (digests of the set), size, shape (sizes of the fragments, a byte each, at most
    255), prefix (first shingles in the global order), first (low bits of fragment 0), and the columns `keep` (64-bit integers)."""
    by_hash = np.argsort(often)
    held = docs.sparkSession.sparkContext.broadcast((often[by_hash], by_hash.astype(np.int32)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = held.value
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[known >> U64(64 - _SIEVE)] = True
        for batch in it:
            for b in slices(batch):
                flat, size = shingle_sets(b.column("text"), n)
                maybe = np.flatnonzero(sieve[flat >> U64(64 - _SIEVE)])
                at = np.minimum(np.searchsorted(known, flat[maybe]), max(len(known) - 1, 0))
                place = np.full(len(flat), -1, np.int32)
                if len(known):
                    place[maybe] = np.where(known[at] == flat[maybe], rank[at], -1)
                wanted = np.where(size > 0, size - (num * size + den - 1) // den + 1, 0)
                low = np.flatnonzero(flat >> U64(64 - (FRAGMENTS - 1).bit_length()) == 0)
                ends = np.cumsum(size)
                cut = np.searchsorted(low, np.append(ends - size, len(flat)))
                prefix, first = [], []
                for i, (start, stop, p) in enumerate(zip((ends - size).tolist(), ends.tolist(), wanted.tolist(), strict=True)):
                    h, r = flat[start:stop], place[start:stop]
                    light = h[r < 0][:p]
                    if len(light) < p:
                        hot = np.flatnonzero(r >= 0)
                        light = np.concatenate([light, h[hot[np.argsort(r[hot])][: p - len(light)]]])
                    prefix.append(light.astype("<u8").tobytes())
                    first.append(np.unique(flat[low[cut[i] : cut[i + 1]]].astype("<u2")).tobytes())
                d1, d2 = digests(flat, size)
                part = np.repeat(np.arange(len(size)), size) * FRAGMENTS + (flat >> U64(64 - (FRAGMENTS - 1).bit_length())).astype(np.int64)
                shape = np.minimum(np.bincount(part, minlength=len(size) * FRAGMENTS), 255).astype(np.uint8).view("<i8")
                cols = [pa.array(d1), pa.array(d2), pa.array(size), pa.array(shape), pa.array(prefix, pa.binary()), pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_key"), *cols, *[b.column(c) for c in keep]], names=["doc_id", "key", "d1", "d2", "size", "shape", "prefix", "first", *keep])

    rows = docs.select("doc_id", row_key().alias("_key"), "text", *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long, key long, d1 long, d2 long, size long, shape long, prefix binary, first binary", *[f"{c} long" for c in keep]]))


def row_key() -> Column:
    """64 bits of a row's doc_id and text: what has one key is taken together, and told apart by its set's digests."""
    return F.xxhash64("doc_id", F.lit("|"), "text")


def postings(classes: DataFrame, wanted: Bits | None = None) -> DataFrame:
    """(token, node, size, shape, pos) of every prefix shingle, or of those that may be wanted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch, "prefix"):
                sets = [np.frombuffer(x, "<i8") for x in b.column("prefix").to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                if n.sum():
                    token = np.concatenate(sets)
                    some = np.flatnonzero(wanted.has(token)) if wanted else np.arange(len(token))
                    rows = pa.array(np.repeat(np.arange(len(n)), n)[some])
                    pos = runs(np.zeros(len(n), np.int64), n)[some].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(token[some]), *(b.column(c).take(rows) for c in ("node", "size", "shape")), pa.array(pos)], names=["token", "node", "size", "shape", "pos"])

    return classes.select("node", "size", "shape", "prefix").mapInArrow(run, "token long, node long, size long, shape long, pos int")


def may_link(num: int, den: int) -> Column:
    """Size, position and fragment size filters on a pair (a, sa, pa, fa), (b, sb, pb, fb) that shares a prefix shingle."""
    small, large = F.least("sa", "sb"), F.greatest("sa", "sb")
    best = F.least("pa", "pb") + 1 + F.least(F.col("sa") - F.col("pa") - 1, F.col("sb") - F.col("pb") - 1)
    sizes = [[F.shiftright(c, 8 * i).bitwiseAND(F.lit(255)) for i in range(FRAGMENTS)] for c in ("fa", "fb")]
    differ = sum((F.abs(x - y) for x, y in zip(*sizes, strict=True)), F.lit(0))
    total = F.col("sa") + F.col("sb")
    return (den * small >= num * large) & ((num + den) * best >= num * total) & ((num + den) * differ <= (den - num) * total)


def screen(pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose first fragments do not differ by more than the threshold allows in all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole, "fa"):
                ok = []
                for x, y, s in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), batch.column("s").to_pylist(), strict=True):
                    w = np.frombuffer(x + y, "<u2").copy()
                    w.sort()
                    ok.append((len(w) - 2 * np.count_nonzero(w[1:] == w[:-1])) * (num + den) <= (den - num) * s)
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = firsts.select(F.col("node").alias("a"), F.col("first").alias("fa"), F.col("size").alias("sa"))
    right = firsts.select(F.col("node").alias("b"), F.col("first").alias("fb"), F.col("size").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb", (F.col("sa") + F.col("sb")).alias("s"))
    return both.mapInArrow(run, "a long, b long")


def fragments(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, size, part, segment): the sets of these classes (node, key, d1, d2), cut by the top bits of the order.

    Texts are read again and those whose row key may be wanted are cut; no text is shuffled.
    """
    wanted = Bits(nodes, "key", MARK_BITS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = U64(64 - (FRAGMENTS - 1).bit_length())
        for whole in it:
            for b in slices(whole.filter(pa.array(wanted.has(whole.column("key").to_numpy())))):
                flat, size = shingle_sets(b.column("text"), n)
                d1, d2 = digests(flat, size)
                ends, raw = np.cumsum(size), flat.astype("<u8").tobytes()
                full = np.flatnonzero(size)
                part = (flat >> top).astype(np.int64)
                cuts = np.searchsorted(np.repeat(np.arange(len(size)), size) * FRAGMENTS + part, np.arange(len(size) * FRAGMENTS + 1))
                cuts = cuts.tolist()
                segments = [raw[8 * cuts[k] : 8 * cuts[k + 1]] for i in full.tolist() for k in range(i * FRAGMENTS, (i + 1) * FRAGMENTS)]
                at = np.repeat(full, FRAGMENTS)
                yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), pa.array(size[at]), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(full))), pa.array(segments, pa.binary())], names=["d1", "d2", "size", "part", "segment"])

    found = docs.select(row_key().alias("key"), "text").mapInArrow(run, "d1 long, d2 long, size long, part int, segment binary")
    return found.join(nodes.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "size", "part", "segment").dropDuplicates(["node", "part"])


def verify(pairs: DataFrame, parts: DataFrame, num: int, den: int, stash: Stash) -> DataFrame:
    """Links (a, b): what the fragments differ by, summed per pair, ROUND fragments at a time. Only pairs that still may differ
    by so much go on to the next ones, and the segments of one round are all that is on its way at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole, "x"):
                n = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    w = np.frombuffer(x + y, "<u8").copy()
                    w.sort()
                    n.append(len(w) - 2 * np.count_nonzero(w[1:] == w[:-1]))
                yield pa.RecordBatch.from_arrays([*batch.select(["a", "b", "s", "d"]).columns, pa.array(n, pa.int64())], names=["a", "b", "s", "d", "n"])

    pairs = pairs.select("a", "b", F.lit(0).cast("long").alias("d"))
    for i in range(0, FRAGMENTS, ROUND):
        some = parts.where(F.col("part").between(i, i + ROUND - 1))
        left = some.select(F.col("node").alias("a"), "part", F.col("segment").alias("x"), F.col("size").alias("sa"))
        right = some.select(F.col("node").alias("b"), "part", F.col("segment").alias("y"), F.col("size").alias("sb"))
        both = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", (F.col("sa") + F.col("sb")).alias("s"), "d", "x", "y")
        counted = both.mapInArrow(run, "a long, b long, s long, d long, n long").groupBy("a", "b", "s", "d").agg(F.sum("n").alias("n"))
        counted = counted.select("a", "b", "s", (F.col("d") + F.col("n")).alias("d"))
        before, pairs = pairs, stash(counted.where((num + den) * F.col("d") <= (den - num) * F.col("s")).select("a", "b", "d"), f"round{i}")
        stash.drop(before)
    return pairs.select("a", "b")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, columns: int = 4096) -> Iterator[tuple[int, int]]:
    """Links between rows `left` and `right` of `sets`: overlaps added up over fragments of the shared shingles."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    count = np.diff(np.append(np.flatnonzero(new), len(flat)))
    shared = np.repeat(count > 1, count)
    ident, row = np.cumsum(new[shared]) - 1, row[shared]
    overlap = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(ident, np.arange(0, (ident[-1] + 1 if len(ident) else 0) + columns, columns))
    for k in range(len(cuts) - 1):
        some = slice(cuts[k], cuts[k + 1])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[some], ident[some] - k * columns] = 1
        overlap += m[left] @ m[right].T
    n = np.rint(overlap).astype(np.int64)
    found = den * n >= num * (size[left][:, None] + size[right][None, :] - n)
    for x, y in zip(*np.nonzero(found), strict=True):
        if left[x] != right[y]:
            yield int(left[x]), int(right[y])


def across_blocks(wide: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, stash: Stash) -> DataFrame:
    """Links (a, b) between the components of each group: wide has token, node, c (component).

    Members of a group's largest component meet only the others, which also meet one another; a set is sent once for
    each block of those.
    """
    per = wide.groupBy("token", "c").agg(F.count("*").alias("k"))
    groups = per.groupBy("token").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("top"))
    blocks = lambda x: F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("int")
    groups = groups.select("token", F.col("top.c").alias("main"), blocks(F.col("top.k")).alias("mb"), blocks(F.col("k") - F.col("top.k")).alias("rb"))
    rows = wide.join(groups, "token").withColumn("rest", F.col("c") != F.col("main"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rb")).otherwise(F.col("mb"))).cast("int"))
    side = "struct({0} as x, {1} as i, {2} as j)"
    to_rest = F.expr(f"transform(sequence(0, rb - 1), o -> {side.format('false', 'salt', 'o')})")
    to_all = F.expr(f"concat(transform(sequence(0, mb - 1), o -> {side.format('false', 'o', 'salt')}), transform(sequence(0, rb - 1), o -> {side.format('true', 'least(salt, o)', 'greatest(salt, o)')}))")
    dealt = rows.select("token", "node", "rest", "salt", F.explode(F.when(F.col("rest"), to_all).otherwise(to_rest)).alias("to")).select("token", "node", "rest", "salt", "to.*")
    parts = stash(fragments(docs, classes.join(wide.select("node").distinct(), "node", "left_semi"), n), "wide-parts")
    one = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("part", "segment"))).alias("segments"))  # one row per set, in order
    one = one.select("node", F.aggregate("segments", F.lit(b""), lambda s, x: F.concat(s, x["segment"])).alias("segment"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in pdf.segment]
        names, rest, salt = pdf.node.tolist(), pdf["rest"].to_numpy(bool), pdf.salt.to_numpy()
        if pdf.x.iloc[0]:
            lo, hi = np.flatnonzero(salt == pdf.i.iloc[0]), np.flatnonzero(salt == pdf.j.iloc[0])
        else:
            lo, hi = np.flatnonzero(~rest), np.flatnonzero(rest)
        forest = Forest(len(sets))
        kept = [(names[x], names[y]) for x, y in block_links(sets, lo, hi, num, den) if forest.join(x, y)] if len(lo) and len(hi) else []
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return dealt.join(one, "node").groupBy("token", "x", "i", "j").applyInPandas(block, "a long, b long")


def join_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and node (the class of equal sets, null without shingles) of every row."""
    return join_groups(docs, n, num, den).drop("root")


def join_groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """As join_components, with root (the component's least node, null without shingles) and the columns `keep` of every row."""
    stash = Stash(docs.sparkSession)
    found = stash(describe(docs, n, num, den, frequent(docs, n, num, den, stash), keep), "sets")
    # copies of one set have the same prefix and first fragment, whichever row of them is taken
    classes = found.where("size > 0").groupBy("d1", "d2", "size").agg(F.first("shape").alias("shape"), F.first("prefix").alias("prefix"), F.first("first").alias("first"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids are those that were written
    rows = stash(found.select("doc_id", "d1", "d2", "size", *keep), "rows")
    stash.drop(found)
    often = stash(postings(classes).groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "tokens")
    index = stash(postings(classes, Bits(often, "token", MARK_BITS)).join(often, "token"), "index")
    whole, classes = classes, stash(classes.drop("prefix"), "classes")
    stash.drop(often, whole)

    def side(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select("token", F.col("node").alias(s), F.col("size").alias(f"s{s}"), F.col("pos").alias(f"p{s}"), F.col("shape").alias(f"f{s}"), *[F.col(c).alias(f"{c}{s}") for c in more])

    def met(df: DataFrame, *more: str) -> DataFrame:
        """Pairs of a token's rows, each at the least of the first LISTED tokens that both have here, or at those after them."""
        listed = df.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LISTED).alias("l"))
        rows = df.join(listed, "node")
        least = F.coalesce(F.try_element_at(F.array_intersect("la", "lb"), F.lit(1)), F.col("token")) >= F.col("token")
        both = side(rows, "a", "l", *more).join(side(rows, "b", "l", *more), "token")
        return both.where("a < b").where(F.col("ca") != F.col("cb") if "c" in more else F.lit(True)).where(may_link(num, den)).where(least)

    def links(pairs: DataFrame, tag: str) -> DataFrame:
        near = stash(screen(pairs.select("a", "b").distinct(), classes.select("node", "size", "first"), num, den), f"near-{tag}")
        nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        parts = stash(fragments(docs, classes.join(nodes, "node", "left_semi"), n), f"parts-{tag}")
        out = verify(near, parts, num, den, stash)
        stash.drop(near, parts)
        return out

    pivots = index.where(f"k > {NARROW}").groupBy("token").agg(F.min(F.struct("node", "size", "shape", "pos")).alias("pivot"))
    star = index.where(f"k > {NARROW}").join(pivots, "token").where("node <> pivot.node").select(F.col("pivot.node").alias("a"), F.col("pivot.size").alias("sa"), F.col("pivot.pos").alias("pa"), F.col("pivot.shape").alias("fa"), F.col("node").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"), F.col("shape").alias("fb"))
    first = links(met(index.where(f"k <= {NARROW}")).select("a", "b").union(star.where(may_link(num, den)).select("a", "b")), "first")
    root = stash(components(stash, first), "linked")
    large = index.where(f"k > {NARROW}").select("token", "node", "size", "shape", "pos", "k").join(root, "node", "left").withColumn("c", F.coalesce("root", "node"))
    large = stash(large.select("token", "node", "size", "shape", "pos", "k", "c"), "large")
    split = large.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    open_ = stash(large.join(split, "token"), "open")
    stash.drop(index, large)
    second = links(met(open_.where(f"k <= {WIDE}"), "c"), "second")
    third = stash(across_blocks(open_.where(f"k > {WIDE}").select("token", "node", "c"), docs, classes, n, num, den, stash), "links-wide")
    stash.drop(open_)
    spanning = root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    root = components(stash, spanning.union(second).union(third))
    shared = classes.select("node", "d1", "d2", "size", "doc_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = shared.join(shared.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("d1", "d2", "size", "node", "root", "component_id")
    out = rows.join(stash(named, "named"), ["d1", "d2", "size"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", "root", *keep)
