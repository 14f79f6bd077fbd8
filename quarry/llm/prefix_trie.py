"""Trie of conversation prefixes, kept as succinct level-order tries, with rollups of every node.

Turns are ordered by (turn, hash of role and text), null turns first; rows with a null conv_id belong to no conversation
and are left out; a null role or text is empty; repeated rows are turns of their own. Conversation c is rebuilt from the
first h = crc32(c) % 6 turns of conversation c - c mod 100 (a mod that is never negative) and its own turns after its first
h. A node is a distinct sequence of first rebuilt turns, known by 128 bits: the exclusive-or of a hash of (depth, turn) over
its turns. Columns other than the four are ignored. An empty table gives no rows.

Texts are hashed where they are read and never shuffled. Places and prefixes are running values over rows sorted in range
partitions by (conversation, turn), and what a conversation had in earlier partitions is added by a table with at most one
row per partition, so a conversation of any length is dealt over many tasks. Nodes are counted by partial aggregates.

A node under which more than SHARD turns lie is heavy, as is the root. What hangs below heavy nodes are prefix shards of at
most SHARD nodes. Whole shards are gathered to forests; each is built by numpy as a LOUDS bit vector (a 1 for each child, a
0 to end a node, level by level from a virtual root) with arrays of labels, and written: `tries` are the operator's output
beside its nodes. Rollups decode the parents from the bits (for the j-th 1, the 0s before it) and add up levels in reverse.
The heavy upper levels are merged apart: shards are summed by their heavy parent, and sums climb 1, 2, 4, ... levels a
round, so that a chain of any depth needs a logarithm of rounds, each an equi-join of heavy nodes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import GOLD, U64, Stash, mix

SHARD = 256
FOREST = 1 << 14
CHUNK = 1 << 16
LEAD = 6
GROUP = 100
ARRAYS = ["bits", "labels", "tops", "conv_id", "n_convs", "chars"]
EMPTY = hashlib.sha256(b"").hexdigest()


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows sorted over range partitions, with the number of each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def carried(local: DataFrame, last: list[str], merge) -> DataFrame:
    """(part, conv_id, the values of `last` with which the partition's first conversation begins); rows for partitions that begin
    amid a conversation. `last` are running values within the partition. The driver gets a row per partition."""
    sums = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", *last)).alias("end"))
    out, was, held = [], None, None
    for r in sums.orderBy("part").collect():
        end = tuple(r.end[c] for c in last)
        if r["first"] == was:
            out.append((r.part, was, *held))
            if r.end.conv_id == was:
                end = merge(held, end)
        was, held = r.end.conv_id, end
    return F.broadcast(local.sparkSession.createDataFrame(out, "part int, conv_id long, " + ", ".join(f"c_{c} long" for c in last)))


def starts(conv: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))


def placed(conversations: DataFrame, stash: Stash) -> DataFrame:
    """conv_id, pos (from 0), k1, k2 (hashes of role and text), chars."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    keys = [F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"), F.length(text).cast("long").alias("chars")]
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, n = None, 0
        for b in it:
            if b.num_rows:
                conv = b.column("conv_id").to_numpy()
                begin = starts(conv)
                pos = np.arange(len(conv)) - np.repeat(begin, np.diff(np.append(begin, len(conv))))
                if conv[0] == was:
                    pos[: begin[1] if len(begin) > 1 else len(conv)] += n
                was, n = conv[-1], pos[-1] + 1
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(pos), b.column("k1"), b.column("k2"), b.column("chars"), b.column("part")], names=["conv_id", "pos", "k1", "k2", "chars", "part"])

    local = stash(in_ranges(turns, "conv_id", F.col("turn").asc_nulls_first(), "k1", "k2").mapInArrow(run, "conv_id long, pos long, k1 long, k2 long, chars long, part int"), "turns")
    before = carried(local, ["pos"], lambda a, b: (a[0] + 1 + b[0],))
    return local.join(before, ["part", "conv_id"], "left").select("conv_id", F.expr("pos + coalesce(c_pos + 1, 0)").alias("pos"), "k1", "k2", "chars")


def rebuilt(turns: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, k1, k2, chars, after: turns that follow; conv_id, length): rebuilt conversations by turns, and whole."""
    base = F.expr(f"conv_id - pmod(conv_id, {GROUP})")
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < LEAD - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "chars"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD).cast("int"))
    lead = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,k1:bigint,k2:bigint,chars:bigint>>")), F.lit(1), F.col("h"))
    convs = own.join(heads, "base", "left").select("conv_id", "h", lead.alias("lead"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
    convs = stash(convs.withColumn("length", F.size("lead") + F.col("rest")), "convs")
    led = convs.select("conv_id", "length", F.inline("lead")).withColumn("depth", F.col("pos") + 1)
    kept = turns.join(convs.select("conv_id", "h", F.size("lead").alias("led"), "length"), "conv_id").where("pos >= h").withColumn("depth", F.expr("led + pos - h + 1"))
    cols = ["conv_id", F.col("depth").cast("long"), "k1", "k2", "chars", (F.col("length") - F.col("depth")).cast("long").alias("after")]
    return led.select(*cols).union(kept.select(*cols)), convs.select("conv_id", "length")


def prefixed(rows: DataFrame, stash: Stash) -> DataFrame:
    """conv_id, depth, chars, after, n1, n2 (the prefix that ends here), p1, p2 (the one before)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, held = None, [U64(0), U64(0)]
        for b in it:
            if not b.num_rows:
                continue
            conv, depth = b.column("conv_id").to_numpy(), b.column("depth").to_numpy().view(U64)
            begin = starts(conv)
            sizes = np.diff(np.append(begin, len(conv)))
            out = []
            for j, k in enumerate(("k1", "k2")):
                salted = mix(b.column(k).to_numpy().view(U64) ^ mix(depth * GOLD + U64(j)))
                upto = np.bitwise_xor.accumulate(salted)
                first = np.where(begin > 0, upto[begin - 1], U64(0))
                if conv[0] == was:
                    first[0] ^= held[j]
                upto ^= np.repeat(first, sizes)
                held[j] = upto[-1]
                out += [upto, upto ^ salted]
            was = conv[-1]
            ids = [pa.array(x.view(np.int64)) for x in (out[0], out[2], out[1], out[3])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "depth", "chars", "after")), *ids, b.column("part")], names=["conv_id", "depth", "chars", "after", "n1", "n2", "p1", "p2", "part"])

    local = stash(in_ranges(rows, "conv_id", "depth").mapInArrow(run, "conv_id long, depth long, chars long, after long, n1 long, n2 long, p1 long, p2 long, part int"), "prefixes")
    before = carried(local, ["depth", "n1", "n2"], lambda a, b: (b[0], a[1] ^ b[1], a[2] ^ b[2]))
    joined = local.join(before, ["part", "conv_id"], "left")
    full = [F.col(c).bitwiseXOR(F.coalesce(F.col(f"c_n{c[1]}"), F.lit(0))).alias(c) for c in ("n1", "n2", "p1", "p2")]
    return joined.select("conv_id", "depth", "chars", "after", *full)


def ranks(columns: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Numbers for pairs of integers, equal for equal pairs, of each of the columns."""
    a, b = (np.concatenate([c[i] for c in columns]) for i in (0, 1))
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return np.split(out, np.cumsum([len(c[0]) for c in columns])[:-1])


def forest(t: dict[str, np.ndarray]) -> dict[str, bytes]:
    """A LOUDS bit vector with arrays in level order, of whole shards."""
    n = len(t["n1"])
    node, above = ranks([(t["n1"], t["n2"]), (t["p1"], t["p2"])])
    where = np.full(max(node.max(), above.max()) + 1, -1)
    where[node] = np.arange(n)
    parent = where[above]
    shard = ranks([(t["r1"], t["r2"])])[0]
    top = np.full(shard.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(top, shard, t["depth"])
    level = t["depth"] - top[shard]
    rank, done, order = np.zeros(n, np.int64), 0, []
    by_level = np.argsort(level, kind="stable")
    for at in np.split(by_level, np.cumsum(np.bincount(level))[:-1]):
        above_rank = np.where(level[at] == 0, -1, rank[parent[at]])
        at = at[np.lexsort((t["n2"][at], t["n1"][at], above_rank))]
        rank[at] = done + np.arange(len(at))
        done += len(at)
        order.append(at)
    order = np.concatenate(order)
    up = np.where(level[order] == 0, 0, rank[parent[order]] + 1)  # 0 is the virtual root
    children = np.bincount(up, minlength=n + 1)
    bits = np.ones(2 * n + 1, np.uint8)
    bits[np.cumsum(children + 1) - 1] = 0
    roots = order[level[order] == 0]
    label = np.stack([t["n1"] ^ t["p1"], t["n2"] ^ t["p2"]], 1)[order]
    return {"bits": np.packbits(bits).tobytes(), "labels": label.tobytes(), "tops": np.stack([t["p1"], t["p2"], t["depth"]], 1)[roots].tobytes(), **{c: t[c][order].tobytes() for c in ("conv_id", "n_convs", "chars")}}


def tries(light: DataFrame) -> DataFrame:
    """Rows of whole prefix shards: bits (LOUDS), labels (128 bits of each edge), tops (parent and depth of the shards' roots), and conv_id, n_convs, chars of the nodes; in level order."""
    cols = ["n1", "n2", "p1", "p2", "r1", "r2", "depth", "conv_id", "n_convs", "chars"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in it:
            now = {c: b.column(c).to_numpy() for c in cols}
            held = {c: np.concatenate([held[c], now[c]]) if held else now[c] for c in cols}
            if len(held["n1"]) >= FOREST:
                cut = int(np.flatnonzero((held["r1"] != held["r1"][-1]) | (held["r2"] != held["r2"][-1])).max(initial=-1)) + 1
                if cut:
                    yield row({c: x[:cut] for c, x in held.items()})
                    held = {c: x[cut:] for c, x in held.items()}
        if held and len(held["n1"]):
            yield row(held)

    def row(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        f = forest(t)
        return pa.RecordBatch.from_arrays([pa.array([f[c]], pa.binary()) for c in ARRAYS], names=ARRAYS)

    ordered = light.select(*cols).repartition("r1", "r2").sortWithinPartitions("r1", "r2")
    return ordered.mapInArrow(run, ", ".join(f"{c} binary" for c in ARRAYS))


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of each node in level order, from 1; 0 is the virtual root: for the j-th 1, the 0s before it."""
    return np.cumsum(bits == 0)[bits == 1]


def levels(up: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the levels among nodes in level order (parents never decrease)."""
    out, lo, last = [], 0, 0
    while lo < len(up):
        hi = int(np.searchsorted(up, last, side="right"))
        out.append((lo, hi))
        lo, last = hi, hi
    return out


def rolled_up(held: DataFrame) -> DataFrame:
    """Every node of written tries: n1, n2, p1, p2, top (whether its parent is outside the trie), depth, conv_id, parent_conv_id (null for tops), n_convs, n_children, n_leaves, saved."""
    schema = pa.schema([(c, pa.bool_() if c == "top" else pa.int64()) for c in ("n1", "n2", "p1", "p2", "top", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")])

    def one(r: dict[str, bytes]) -> pa.RecordBatch:
        label, tops = np.frombuffer(r["labels"], np.int64).reshape(-1, 2), np.frombuffer(r["tops"], np.int64).reshape(-1, 3)
        conv, n_convs, chars = (np.frombuffer(r[c], np.int64) for c in ("conv_id", "n_convs", "chars"))
        n = len(conv)
        up = parents(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=2 * n + 1))
        node, depth, above = np.zeros((n, 2), np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        bounds = levels(up)
        for i, (lo, hi) in enumerate(bounds):
            above[lo:hi] = node[up[lo:hi] - 1] if i else tops[:, :2]
            depth[lo:hi] = depth[up[lo:hi] - 1] + 1 if i else tops[:, 2]
            node[lo:hi] = above[lo:hi] ^ label[lo:hi]
        children = np.bincount(up, minlength=n + 1)[1:]
        leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * chars
        for lo, hi in reversed(bounds[1:]):
            np.add.at(leaves, up[lo:hi] - 1, leaves[lo:hi])
            np.add.at(saved, up[lo:hi] - 1, saved[lo:hi])
        top = up == 0
        values = [node[:, 0], node[:, 1], above[:, 0], above[:, 1], top, depth, conv, pa.array(conv[up - 1], mask=top), n_convs, children, leaves, saved]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                yield one({c: b.column(c)[i].as_py() for c in b.schema.names})

    return held.mapInArrow(run, ", ".join(f"{f.name} {'boolean' if f.name == 'top' else 'long'}" for f in schema))


def upper(heavy: DataFrame, light: DataFrame, root_conv: int, stash: Stash) -> DataFrame:
    """The heavy nodes with their rollups: what shards and heavy children bring, summed up the tree by doubling steps."""
    below = light.where("top").groupBy("p1", "p2").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    inner = heavy.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n"))
    both = below.unionByName(inner, allowMissingColumns=True).groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.sum("n").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    own = heavy.join(both, ["n1", "n2"], "left")
    leaves = F.coalesce("leaves", F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(0))
    saved = F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")
    held = stash(own.select("n1", "n2", "p1", "p2", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), leaves.alias("leaves"), saved.alias("saved")), "upper")
    deepest = held.agg(F.max("depth")).first()[0]
    climb = held.select("n1", "n2", F.when(F.col("depth") > 0, F.col("p1")).alias("a1"), F.when(F.col("depth") > 0, F.col("p2")).alias("a2"), "leaves", "saved")
    for i in range(ceil(log2(deepest + 1))):  # after round i, sums hold all less than 2^(i + 1) levels below
        add = climb.where("a1 is not null").groupBy(F.col("a1").alias("n1"), F.col("a2").alias("n2")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = climb.select(F.col("n1").alias("a1"), F.col("n2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        new = climb.join(add, ["n1", "n2"], "left").join(jump, ["a1", "a2"], "left")
        before, climb = climb, stash(new.select("n1", "n2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.expr("leaves + coalesce(l, 0)").alias("leaves"), F.expr("saved + coalesce(s, 0)").alias("saved")), f"climb{i}")
        stash.drop(before)
    sums = climb.select("n1", "n2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved"))
    return with_parent(held.drop("leaves", "saved").join(sums, ["n1", "n2"]), heavy, root_conv)


def with_parent(rows: DataFrame, heavy: DataFrame, root_conv: int) -> DataFrame:
    """rows whose parents are heavy, with parent_conv_id. Children of the root, which may be most rows, take part in no join."""
    named = heavy.where("depth > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    low = rows.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_conv).cast("long")))
    return low.unionByName(rows.where("depth > 1").join(named, ["p1", "p2"]))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): ids of one node are joined to texts of at most CHUNK ids, and a stream of its texts is hashed."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("n1", "n2", F.expr(f"floor(conv_id / {CHUNK}.0)").alias("chunk")).agg(listed.alias("ids"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in it:
            done: list[tuple] = []
            for a, c, ids in zip(b.column("n1").to_pylist(), b.column("n2").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if (a, c) == key:
                    h.update(b"," + ids.encode())
                else:
                    done += [(*key, h.hexdigest())] if key else []
                    key, h = (a, c), hashlib.sha256(ids.encode())
            yield batch(done)
        yield batch([(*key, h.hexdigest())] if key else [])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("n1", "n2", "ends_sha256"), r, strict=True)) for r in rows], schema=pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())]))

    return chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "chunk").mapInArrow(run, "n1 long, n2 long, ends_sha256 string")


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; the written tries)."""
    spark = conversations.sparkSession
    stash = Stash(spark)
    turns, convs = rebuilt(stash(placed(conversations, stash), "placed"), stash)
    rows = stash(prefixed(turns, stash), "rows")
    nodes = rows.groupBy("n1", "n2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("p1", "p2", "depth", "chars")], F.sum("after").alias("under"))
    nodes = stash(nodes, "nodes")
    all_convs = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not all_convs.n:
        node = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], node), spark.createDataFrame([], ", ".join(f"{c} binary" for c in ARRAYS))
    root = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in (("n1", 0), ("n2", 0), ("conv_id", all_convs.least), ("n_convs", all_convs.n), ("p1", None), ("p2", None), ("depth", 0), ("chars", 0))])
    heavy = stash(nodes.where(F.col("under") >= SHARD).drop("under").unionByName(root), "heavy")
    deep = rows.where("depth > 1").join(heavy.where("depth > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2")), ["p1", "p2"], "left_semi")
    cut = rows.where("depth = 1").unionByName(deep.select(*rows.columns)).groupBy("conv_id").agg(F.max(F.struct("depth", "n1", "n2")).alias("x"))
    light = nodes.where(F.col("under") < SHARD).join(cut.select("conv_id", F.col("x.n1").alias("r1"), F.col("x.n2").alias("r2")), "conv_id")
    written = stash(tries(light), "tries", **{"parquet.block.size": 16 << 20})
    low = stash(rolled_up(written), "light")
    high = upper(heavy, low, all_convs.least, stash)
    inside, tops = low.where("not top"), with_parent(low.where("top").drop("parent_conv_id"), heavy, all_convs.least)
    cols = ["n1", "n2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    ends = rows.where("after = 0").select("n1", "n2", "conv_id").union(convs.where("length = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    every = inside.select(*cols).unionByName(tops.select(*cols)).unionByName(high.select(*cols)).join(end_hashes(ends), ["n1", "n2"], "left")
    out = every.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return out, written
