"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its lower-cased words without edge punctuation and their prefixes of four to six letters, hashed
to SPACE buckets; a text's score is the logistic function of bias + linear weights + pairwise products of factor
vectors over its set of terms, so that a pair of terms (an insult and a group, two halves of a threat) weighs more than
their sum. Terms enter the model only if they are frequent enough in the labelled rows and lean to one class. The model
is fitted on at most `sample` labelled rows (default SAMPLE, those of lowest hash) with crc32(doc_id) mod 3 <> 1 and has
a fixed size whatever the corpus. Texts are scored whole.

Nulls: a null text is empty and scored by the bias; rows with a null label or doc_id are not learned from; a null doc_id
has held_out false. Repeated rows are scored each on their own; a repeated doc_id is learned from once, and of several
labels the largest counts. A text of any length is scored whole. An empty table gives no rows; without labels of both
classes every score is 0. Other columns are ignored; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm.common import Stash, runs, slices, split_words

SPACE = 1 << 20
SAMPLE = 20_000
FACTORS = 8
MOST_TERMS = 1 << 15
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def word_buckets(word: str) -> list[int]:
    """Buckets of the terms of one lower-cased word."""
    core = word.strip(_EDGE)
    made = {f"w:{core}"} | {f"p:{core[:k]}" for k in (4, 5, 6) if len(core) > k} | {f"p:{core}"}
    return [hash_term(x) for x in made] if core else []


def term_sets(column: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct buckets of all texts on end, number of each text's); with `place`, only those with a place >= 0, as places."""
    index, words, n_words = split_words(column)
    each = [[b for w in x.decode().lower().split() for b in word_buckets(w)] for x in words.to_pylist()]
    n, flat = np.array(list(map(len, each)), np.int64), np.array([b for x in each for b in x], np.int64)
    if place is not None:
        at = place[flat]
        n, flat = np.bincount(np.repeat(np.arange(len(n)), n)[at >= 0], minlength=len(n)), at[at >= 0].astype(np.int64)
    first = np.cumsum(n) - n
    text, size = np.repeat(np.arange(len(n_words)), n_words), n[index]
    some = size > 0
    pairs = np.unique(np.repeat(text[some], size[some]) * SPACE + flat[runs(first[index[some]], size[some])])
    return pairs % SPACE, np.diff(np.searchsorted(pairs, np.arange(len(n_words) + 1) * SPACE))


def hash_term(term: str) -> int:
    return xxh64_intdigest(term) % SPACE


@dataclass
class Machine:
    """bias, and for each bucket with a place >= 0 a row of weights and factors."""

    bias: float
    place: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores of texts whose terms have these places, `size` of each text."""
        row = np.repeat(np.arange(len(size)), size)
        s, q, lin = np.zeros((len(size), FACTORS)), np.zeros(len(size)), np.zeros(len(size))
        v = self.v[at].astype(np.float64)
        np.add.at(s, row, v)
        np.add.at(q, row, (v * v).sum(1))
        np.add.at(lin, row, self.w[at].astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(self.bias + lin + 0.5 * ((s * s).sum(1) - q), -30, 30)))


def choose_terms(counts: DataFrame, n1: int, n0: int) -> list[int]:
    """Buckets (bucket, c1, c0) that are frequent enough and lean to a class, the strongest first; at most MOST_TERMS."""
    lean = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
    z = F.round(F.abs(lean) / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5)), 9)
    found = counts.where("c1 + c0 >= 3").withColumn("z", z).where("z > 2.5")
    return [r.bucket for r in found.orderBy(F.desc("z"), "bucket").limit(MOST_TERMS).select("bucket").collect()]


def fit_machine(idx: list[np.ndarray], toxic: np.ndarray, chosen: list[int], epochs: int = 40, seed: int = 1, penalty: float = 1e-4) -> Machine:
    """Adam on the logistic loss, classes weighted alike. idx: the places of each row's terms among the chosen buckets."""
    place = np.full(SPACE, -1, np.int32)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Machine(-30.0, place, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    good = np.array(chosen, np.int64)
    place[good] = np.arange(len(good))
    size = np.array([len(i) for i in idx])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(good)), rng.normal(0, 0.01, (len(good), FACTORS))
    bias, weight = 0.0, np.where(toxic, 0.5 / n1, 0.5 / n0) * len(idx)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, v)] + [[0.0, 0.0]]
    step, batch = 0, 256
    for epoch in range(epochs):
        rate = 0.03 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(idx))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            at = np.concatenate([idx[i] for i in some])
            row = np.repeat(np.arange(len(some)), size[some])
            va = v[at]
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, row, va)
            q, lin = np.zeros(len(some)), np.zeros(len(some))
            np.add.at(q, row, (va * va).sum(1))
            np.add.at(lin, row, w[at])
            zed = bias + lin + 0.5 * ((s * s).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(zed, -30, 30))) - toxic[some]) * weight[some] / len(some)
            gw, gv = penalty * w, penalty * v
            np.add.at(gw, at, g[row])
            np.add.at(gv, at, g[row, None] * (s[row] - va))
            step += 1
            for a, gr, m in ((w, gw, moments[0]), (v, gv, moments[1])):
                m[0] = 0.9 * m[0] + 0.1 * gr
                m[1] = 0.999 * m[1] + 0.001 * gr * gr
                a -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            bias -= rate * float(g.sum())
    return Machine(float(bias), place, w.astype(np.float32), v.astype(np.float32))


def learned_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, terms) of at most `sample` labelled documents that are not held out: a doc_id each, its least terms if it is repeated."""

    def buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch):
                flat, size = term_sets(b.column("text"))
                raw, ends = flat.astype("<u4").tobytes(), np.cumsum(size)
                terms = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_toxic").cast(pa.int32()), pa.array(terms, pa.binary())], names=["doc_id", "toxic", "terms"])

    few = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `sample` rows of two numbers
    return known.mapInArrow(buckets, "doc_id long, toxic int, terms binary").groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Terms are hashed and counted in parallel; what reaches the driver is MOST_TERMS buckets and the places of the sample's terms among them."""
    stash = Stash(docs.sparkSession)
    rows = stash(learned_rows(docs, labels, sample), "learned")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, SPACE), np.int64)
        for batch in it:
            for t, x in zip(batch.column("toxic").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                c[int(t == 1)][np.frombuffer(x, "<u4")] += 1
        used = np.flatnonzero(c.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(c[1, used]), pa.array(c[0, used])], names=["bucket", "c1", "c0"])

    n = {r.toxic == 1: r["count"] for r in rows.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    per = rows.mapInArrow(count, "bucket long, c1 long, c0 long").groupBy("bucket").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    chosen = choose_terms(per, n.get(True, 0), n.get(False, 0)) if len(n) == 2 else []
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = docs.sparkSession.sparkContext.broadcast(place)

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [held.value[np.frombuffer(x, "<u4")] for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([x[x >= 0].astype("<u2").tobytes() for x in made], pa.binary())], names=["doc_id", "toxic", "at"])

    found = sorted(map(tuple, rows.mapInArrow(placed, "doc_id long, toxic int, at binary").collect()))
    stash.drop(rows)
    return fit_machine([np.frombuffer(x, "<u2").astype(np.int64) for _, _, x in found], np.array([t == 1 for _, t, _ in found], bool), chosen)


def score(docs: DataFrame, labels: DataFrame, machine: Machine | None = None, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine or fit(docs, labels, sample))  # of fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in it:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(m.scores(*term_sets(b.column("text"), m.place)))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
