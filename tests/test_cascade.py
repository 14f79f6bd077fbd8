"""Every branch of the label cascade has rows, and the rules on made-up clusters."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import cascade

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_all_branches_have_rows(spark):
    from quarry.plans import QUERIES

    got = QUERIES["cluster_labels"](spark, DATA).persist()
    assert {r.branch for r in got.select("branch").distinct().collect()} == {"promoted", "truth", "truth_ambiguous", "manual", "classifier", "collision", "single", "open"}
    assert got.where("anomaly").count() and got.where("tier_narrowed").count() and got.where("branch = 'open' and size(candidates) > 1").count()
    settled = QUERIES["settled_labels"](spark, DATA)
    by = settled.join(got.select("hash", F.col("label").alias("before")), "hash").where("source = 'visual_key_ambiguous'")
    assert by.where("before is not null").count() and by.where("before is null").count() and settled.where("label is not null").count()


DIM = [("Lesser Fire", "fire", "I", "F"), ("Fire", "fire", "II", "F"), ("Ice", "ice", "II", "Ice"), ("Gilded Ice", "gold", "III", "Ice"), ("Jolt", "gold", "III", "Jolt"), ("Wind", "wind", "I", "Wind"), ("Gust", "wind", "I", "Gust")]
OFFERS = [(1, "Lesser Fire", "I"), (1, "Ice", "II"), (2, "Fire", "II"), (2, "Lesser Fire", "I"), (3, "Wind", "I"), (3, "Gust", None), (4, "Ice", "II"), (5, "Jolt", "III"), (5, "Gilded Ice", "III"), (6, "unknown", "I")]


@pytest.fixture(scope="module")
def tables(spark):
    dim = spark.createDataFrame(DIM, "name string, icon string, tier string, identity string").withColumn("key", F.concat_ws("_", "icon", F.lower("tier")))
    return dim, spark.createDataFrame(OFFERS, "item long, name string, tier string")


def run(spark, tables, items, truth=(), promoted=None, tier=None, given=None, seen=None):
    one = lambda kind, v: spark.createDataFrame([("h", v)] if v is not None else [], f"hash string, {kind} string")
    clusters = spark.createDataFrame([("h", list(items), list(truth))], "hash string, items array<long>, truth array<string>")
    out = cascade.label(clusters, tables[1], tables[0], one("promoted", promoted), one("tier", tier), one("given", given), one("seen", seen), lambda i, m: F.coalesce(F.get(F.filter(m, lambda x: ~F.startswith(x, F.lit("Lesser ")) & ~F.startswith(x, F.lit("Gilded "))), F.lit(0)), i))
    r = out.collect()[0]
    return r.branch, r.label, r.key, r.candidates


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"items": [1, 2]}, ("open", None, None, ["Fire"])),  # one identity, but two tiers of it are possible
        ({"items": [1, 2], "tier": "I"}, ("single", "Fire", "fire_i", None)),
        ({"items": [1, 2], "tier": "III"}, ("open", None, None, ["Fire"])),  # a note that would leave nothing is not used
        ({"items": [1, 2], "seen": "fire_ii"}, ("classifier", "Fire", "fire_ii", None)),
        ({"items": [1, 2], "seen": "ice_ii"}, ("open", None, None, ["Fire"])),  # seen, but not possible
        ({"items": [3], "seen": "wind_i"}, ("collision", None, "wind_i", ["Gust", "Wind"])),
        ({"items": [3], "given": "Wind"}, ("manual", "Wind", "wind_i", None)),
        ({"items": [3], "given": "Ice"}, ("open", None, None, ["Gust", "Wind"])),  # an impossible icon
        ({"items": [3], "given": "Wind", "tier": "II"}, ("open", None, None, ["Gust", "Wind"])),
        ({"items": [3], "given": "Typo"}, ("open", None, None, ["Gust", "Wind"])),
        ({"items": [3, 5]}, ("open", None, None, None)),  # nothing in common: an anomaly
        ({"items": [3, 5], "truth": ["Ice"]}, ("truth", "Ice", "ice_ii", None)),
        ({"items": [3], "truth": ["Wind", "Gust"]}, ("truth_ambiguous", None, "wind_i", ["Gust", "Wind"])),
        ({"items": [3], "truth": ["Wind", "Ice"]}, ("truth_ambiguous", None, None, ["Ice", "Wind"])),
        ({"items": [3], "truth": ["Wind"], "promoted": "Jolt"}, ("promoted", "Jolt", "gold_iii", None)),
        ({"items": [4]}, ("open", None, None, ["Ice"])),  # the identity has a gilded member too, so its tier is not sure
        ({"items": [4], "tier": "II"}, ("single", "Ice", "ice_ii", None)),
        ({"items": [6, 4], "tier": "II"}, ("open", None, None, None)),  # an item that offers only unknown names allows no icon
        ({"items": [99, 4], "tier": "II"}, ("single", "Ice", "ice_ii", None)),  # an item without offers says nothing
    ],
)
def test_rules(spark, tables, given, want):
    assert run(spark, tables, **given) == want


def test_reclassified_by_key(spark):
    rows = [("a", "x_i", "A", None), ("b", "x_i", None, ["A", "B"]), ("c", "y_i", "C", None), ("d", "y_i", "C", None), ("e", None, "Z", None), ("f", "z_i", None, ["Q"]), ("g", "w_i", None, None)]
    df = spark.createDataFrame(rows, "hash string, key string, label string, candidates array<string>").withColumn("source", F.lit("s")).withColumn("identity", F.lit("i"))
    got = {r.hash: (r.source, r.label, r.candidates) for r in cascade.reclassified(df).collect()}
    assert got["a"] == got["b"] == ("visual_key_ambiguous", None, ["A", "B"])  # only an unlabelled member tells
    assert got["c"] == ("s", "C", None) and got["e"] == ("s", "Z", None) and got["f"] == ("s", None, ["Q"]) and got["g"] == ("s", None, None)
