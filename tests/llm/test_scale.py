"""What keeps disk and groups from growing faster than the input."""

import glob
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import jaccard_join as jj
from quarry.llm.common import Stash


def test_thinly_spread_shingles_are_frequent(spark):
    """Words that all documents share, one document in each part of the input: low hashes are known as frequent."""
    common = " ".join(f"common{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"own{i} {common} {' '.join(f'w{i}x{j}' for j in range(50))}") for i in range(20)], "doc_id long, text string").repartition(20, "doc_id")
    found = jj.frequent(docs, 3, 90, 100, Stash(spark))
    shared, _ = jj.shingle_sets(pa.array([common]), 3)
    low = shared[shared < np.uint64(int(0.15 * 2**64))]
    assert len(low) > 10 and set(low.tolist()) <= set(found.tolist()) <= set(shared.tolist())


def test_rounds_of_fragments_give_the_same_links(spark):
    """Sets that part only in the last fragments, and pairs that meet the threshold exactly, against counting."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 380, dtype=np.uint64)
    late = np.sort(base)[-60:]
    sets = [base, base[:-20], np.setdiff1d(base, late[:38]), np.setdiff1d(base, late[:39]), np.setdiff1d(base, late), np.append(base[20:], rng.integers(0, 2**64, 20, dtype=np.uint64)), rng.integers(0, 2**64, 5, dtype=np.uint64)]
    rows = [(i, len(x), k, bytearray(np.sort(x[x >> np.uint64(61) == k]).astype("<u8").tobytes())) for i, x in enumerate(sets) for k in range(jj.FRAGMENTS)]
    parts = spark.createDataFrame(rows, "node long, size long, part int, segment binary")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    got = jj.verify(spark.createDataFrame(pairs, "a long, b long"), parts, 90, 100, Stash(spark))
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for i, j in pairs if 100 * both(i, j) >= 90 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert {tuple(r) for r in got.collect()} == want and (0, 2) in want and (0, 3) not in want


def test_shuffles_of_a_written_table_are_freed(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folder for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = held()
    out = Stash(spark)(spark.range(10_000, numPartitions=3).groupBy((F.col("id") % 1000).alias("k")).count(), "counted")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_ngram_join_shuffles_texts_once(spark):
    """Equal rows, rows without words and null ids are one each, and no exchange is dealt by whole texts."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, f"{text} more"), (None, text), (3, ""), (3, ""), (None, None), (None, None), (4, "other")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.ngram_join(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, text), (3, ""), (None, None), (4, "other")]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning(_row#" in plan and not re.search(r"hashpartitioning\([^)]*text#", plan)
