"""Queries in which every rule must have rows to decide on, and the name ratio against the standard library's."""

import os
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarry.plans import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_shape_rejects_something(spark):
    rows = QUERIES["quota_and_shape_filter"](spark, DATA).collect()
    for rule in (lambda r: not r.plausible, lambda r: r.plausible and not r.recognised and r.quota_full, lambda r: r.kept and not r.recognised, lambda r: r.dropped, lambda r: not r.dropped and not r.recognised):
        assert any(map(rule, rows))


def test_audit_has_all_strengths(spark):
    assert {r.strength for r in QUERIES["audit_strength"](spark, DATA).collect()} == {"exact", "same name", "none"}
    assert QUERIES["audit_strength"](spark, DATA).count() == QUERIES["hash_clusters"](spark, DATA).count()


def test_positions_and_precedence(spark):
    pairs = QUERIES["positional_pairing"](spark, DATA)
    assert pairs.where("n = 0 and aligned").count() and pairs.where("not aligned").count()
    assert pairs.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert {r.verdict for r in QUERIES["aligned_columns"](spark, DATA).select("verdict").distinct().collect()} == {"nothing", "aligned", "missing", "surplus"}
    merged = QUERIES["label_precedence"](spark, DATA)
    assert {r.told_by for r in merged.select("told_by").distinct().collect()} == {"truth", "promotion", "both", "conflict"}
    assert merged.where("told_by = 'conflict' and truth_wins <> promotion_wins").count()


def test_some_keys_are_not_reached(spark):
    n, every = QUERIES["unreached_keys"](spark, DATA).count(), spark.read.parquet(f"{DATA}/part.parquet").select("p_brand", "p_size").distinct().count()
    assert 0 < n < every


def test_name_ratio_decides(spark):
    """Names of one customer on both sides of the floor, as the standard library has them, and edges only on one side."""
    from quarry.plans.resolution import NAME_FLOOR, candidate_pairs, duplicate_edges, records

    rec = records(spark, DATA).persist()
    pairs = candidate_pairs(rec).select("a", "b", "name_a", "name_b").collect()
    bare = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
    ratio = {(r.a, r.b): SequenceMatcher(None, bare(r.name_a), bare(r.name_b)).ratio() if bare(r.name_a) and bare(r.name_b) else 0.0 for r in pairs}
    assert any(NAME_FLOOR <= x < 1 for x in ratio.values()) and any(0 < x < NAME_FLOOR for x in ratio.values())
    edges = {(r.a, r.b) for r in duplicate_edges(rec).collect()}
    assert edges and all(ratio[e] >= NAME_FLOOR for e in edges) and any(ratio[e] < 1 for e in edges)
    same = candidate_pairs(rec.withColumn("name", F.lit("one"))).count()
    assert same == len(pairs)


def test_references_in_blocks(spark, monkeypatch):
    from quarry.operators import vectors
    from quarry.plans.measures import references

    e, refs = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(50), references(spark, DATA)
    whole = sorted(map(tuple, vectors.scores(e, refs).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.scores(e, refs).collect())) == whole and len(whole) == 50 * refs.count()
