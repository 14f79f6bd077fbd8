"""Embedding near-duplicates by collision-counting projections.

Vectors of one label and dimension are compared. Every vector gets PROJECTIONS one-dimensional Gaussian projections of its
unit vector. Two vectors collide in a projection if one lies in the window of half-width WINDOW around the other; pairs
at the cosine threshold collide in so many projections that a count of `needed` keeps all but MISS of them, while
others seldom reach it. Pairs that reach it are verified by the cosine in double precision.

To find pairs, wide query-centred windows (a pair at the threshold leaves one with a probability of 2e-4) are used on the
first projections: some of them, more for a larger label, cut space into cells of four half-widths, and a vector visits the
cells that its window touches; in a task, one projection more is sorted and each query takes the range of its window,
and SIEVES more drop pairs. Only for what is left are all collisions counted. A cell is dealt by a hash into blocks of
about BLOCK vectors and each pair of blocks is one task, so a crowd of near copies is many bounded tasks. A task returns
only counts per vector and a spanning forest. Equal unit vectors are one class with a multiplicity. The work of a label
grows with the square of its distinct vectors, less a factor of about 0.64 for each axis of the cells.

Vectors that are null, empty, zero or hold null or non-finite components, or have a null label, link with nothing: 0
links, their own component. Components of any finite size are compared (vectors are scaled by their largest first). A
null vec_id is kept. Repeated rows are links of each other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Forest, Stash, components, runs

PROJECTIONS = 32
WINDOW = 0.3
MISS = 2e-4
SIEVES = 4
MOST_AXES = 12
BLOCK = 1024


def needed(cosine: float, window: float = WINDOW, m: int = PROJECTIONS, miss: float = MISS) -> int:
    """Largest count that pairs at this cosine reach with probability 1 - miss."""
    p = erf(window / sqrt(2 - 2 * cosine) / sqrt(2))
    tail = 0.0
    for k in range(m + 1):
        tail += comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail > miss:
            return k
    return m


def axes(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, m))


def project(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, v (unit vector in doubles), p (projections); dim is 0 and the rest null for what links with nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                column, label = b.column("embedding"), b.column("label").cast(pa.int64())
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
                start, known = np.cumsum(size) - size, ~label.is_null().to_numpy(zero_copy_only=False)
                dim, v, p = np.zeros(len(size), np.int32), [None] * len(size), [None] * len(size)
                for d in np.unique(size[size > 0]).tolist():
                    rows = np.flatnonzero((size == d) & known)
                    x = flat[start[rows][:, None] + np.arange(d)]
                    most = np.abs(x).max(1, initial=0.0)
                    good = np.isfinite(most) & (most > 0)
                    rows, x = rows[good], x[good] / most[good][:, None]
                    x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0
                    y = (x @ axes(d)).astype("<f4")
                    dim[rows] = d
                    for i, u, w in zip(rows.tolist(), x.astype("<f8"), y, strict=True):
                        v[i], p[i] = u.tobytes(), w.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), label, pa.array(dim), pa.array(v, pa.binary()), pa.array(p, pa.binary())], names=["vec_id", "label", "dim", "v", "p"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label long, dim int, v binary, p binary")


def deal(classes: DataFrame, wide: float) -> DataFrame:
    """The columns of classes and, for each cell that a vector is in or visits, cell and home: true for its own one. It visits cells after its own only, so two vectors meet once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_axes = b.column("axes").to_numpy()
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), "<f4").reshape(b.num_rows, -1)
            at = lambda x: np.clip(np.floor(x / (4 * wide)), -8, 7).astype(np.int64) + 8
            own, low, high = at(p), at(p - wide), at(p + wide)
            row, cell, home = [], [], []
            for i, k in enumerate(n_axes.tolist()):
                mine = tuple(own[i, :k].tolist())
                for c in product(*(range(x, y + 1) for x, y in zip(low[i, :k].tolist(), high[i, :k].tolist(), strict=True))):
                    if c >= mine:
                        row.append(i)
                        cell.append(sum(x << (4 * j) for j, x in enumerate(c)))
                        home.append(c == mine)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("label", "dim", "node", "k", "v", "p")), pa.array(cell, pa.int64()), pa.array(home, pa.bool_())], names=["label", "dim", "node", "k", "v", "p", "cell", "home"])

    return classes.select("label", "dim", "node", "k", "v", "p", "axes").mapInArrow(run, "label long, dim int, node long, k long, v binary, p binary, cell long, home boolean")


def collisions(p: np.ndarray, q: np.ndarray, wide: float, window: float, least: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) in each other's wide windows of some projections from `skip` on that collide in `least` or more of all."""
    line = np.argsort(q[:, skip], kind="stable")
    value = q[line, skip]
    lo, hi = np.searchsorted(value, p[:, skip] - wide, "left"), np.searchsorted(value, p[:, skip] + wide, "right")
    i, j = np.repeat(np.arange(len(p)), hi - lo), line[runs(lo, hi - lo)]
    for k in range(skip + 1, skip + 1 + SIEVES):
        near = np.abs(p[i, k] - q[j, k]) <= wide
        i, j = i[near], j[near]
    enough = np.zeros(len(i), bool)
    for s in range(0, len(i), 65_536):
        some = slice(s, s + 65_536)
        enough[some] = np.count_nonzero(np.abs(p[i[some]] - q[j[some]]) <= window, axis=1) >= least
    return i[enough], j[enough]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    stash = Stash(vectors.sparkSession)
    wide, least = 3.7 * sqrt(2 - 2 * cosine), needed(cosine)
    keys = [F.when(F.col("dim") > 0, F.xxhash64("v", "label")).alias("k1"), F.when(F.col("dim") > 0, F.xxhash64(F.lit("second"), "label", "v")).alias("k2")]
    found = stash(project(vectors).select("*", *keys), "projected")
    classes = found.where("dim > 0").groupBy("k1", "k2", "label", "dim").agg(F.count("*").alias("k"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v"), F.first("p").alias("p"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids are those that were written
    rows = stash(found.select("vec_id", "k1", "k2"), "rows")
    stash.drop(found)
    many = F.least(F.lit(MOST_AXES), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK)))).cast("int").alias("axes")
    sizes = classes.groupBy("label", "dim").agg(many)
    met = stash(deal(classes.join(sizes, ["label", "dim"]), wide), "cells")
    blocks = lambda side: F.ceil(F.count_if(side) / BLOCK).cast("int")
    cells = met.groupBy("label", "dim", "cell").agg(blocks(F.col("home")).alias("hb"), blocks(~F.col("home")).alias("vb")).where("hb > 0")
    dealt = met.join(cells, ["label", "dim", "cell"]).withColumn("s", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("vb"))).cast("int"))
    to = "transform(if({n} > 0, sequence(0, {n} - 1), cast(array() as array<int>)), o -> struct({x} as x, {i} as i, {j} as j))"
    at_home = F.expr(f"concat({to.format(n='hb', x='false', i='least(s, o)', j='greatest(s, o)')}, {to.format(n='vb', x='true', i='s', j='o')})")
    away = F.expr(to.format(n="hb", x="true", i="o", j="s"))
    tasks = dealt.withColumn("to", F.explode(F.when(F.col("home"), at_home).otherwise(away))).select("label", "dim", "cell", "node", "k", "v", "p", "home", "s", "to.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        away, i, j = bool(pdf.x.iloc[0]), pdf.i.iloc[0], pdf.j.iloc[0]
        alone = not away and i == j
        left, right = (pdf[pdf.home], pdf[~pdf.home]) if away else (pdf, pdf) if alone else (pdf[pdf.s == i], pdf[pdf.s == j])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        get = lambda d, c, t: np.frombuffer(b"".join(d[c]), t).reshape(len(d), -1)
        p, q, u, v = get(left, "p", "<f4"), get(right, "p", "<f4"), get(left, "v", "<f8"), get(right, "v", "<f8")
        x, y = collisions(p, q, wide, WINDOW, least, MOST_AXES)
        if alone:
            x, y = x[x < y], y[x < y]
        ok = np.zeros(len(x), bool)
        for s in range(0, len(x), 16_384):
            a, b = x[s : s + 16_384], y[s : s + 16_384]
            ok[s : s + 16_384] = (u[a] * v[b]).sum(1) >= cosine
        x, y = x[ok], y[ok]
        ka, kb, na, nb = left.node.to_numpy(), right.node.to_numpy(), left.k.to_numpy(), right.k.to_numpy()
        la = np.bincount(x, nb[y], len(left)).astype(np.int64)
        lb = np.bincount(y, na[x], len(right)).astype(np.int64)
        forest = Forest(len(left) + len(right))
        shift = 0 if alone else len(left)
        tree = [(int(ka[a]), int(kb[b]), 0) for a, b in zip(x.tolist(), y.tolist(), strict=True) if forest.join(a, b + shift)]
        links = [(int(k), 0, int(n)) for ks, ns in ((ka, la), (kb, lb)) for k, n in zip(ks, ns, strict=True) if n]
        return pd.DataFrame(tree + links, columns=["a", "b", "n"], dtype="int64")

    found = stash(tasks.groupBy("label", "dim", "cell", "x", "i", "j").applyInPandas(compare, "a long, b long, n long"), "found")
    stash.drop(met)
    root = components(stash, found.where("n = 0").select("a", "b"))
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    label = classes.select("k1", "k2", "node", "k", "vec_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = label.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = label.join(names, "root").join(links, "node", "left").select("k1", "k2", "component_id", (F.col("k") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(stash(named, "named"), ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
