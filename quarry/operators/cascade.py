"""Labels of clusters from unequal witnesses: promoted, ground truth, hand, classifier, and what their items leave possible.

Tables: clusters (hash, items: the distinct items of its occurrences, truth: the distinct labels read with it), offers (item,
name, tier: what an item can show), dimension (name, icon, tier, identity, key, with `key` the observed key of icon and tier).
Clusters are many and are only joined and aggregated; arrays per cluster hold names of the dimension, a closed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import shared_folder

NONE = "array<string>"


def possible(clusters: DataFrame, offers: DataFrame, dimension: DataFrame) -> DataFrame:
    """(hash, icons, cands, at_tier): the icons that every known item of a cluster offers, and by them the identities, also
    with their tiers. Clusters whose known items share no icon have no row. An item without offers says nothing; a name that
    the dimension lacks is none."""
    held = offers.join(dimension.select("name", "icon", "identity"), "name").select("item", "icon", "tier", "identity").distinct()
    each = clusters.select("hash", F.explode("items").alias("item")).join(offers.select("item").distinct(), "item")
    total = each.groupBy("hash").agg(F.count("*").alias("n"))
    rows = each.join(held, "item")
    common = rows.groupBy("hash", "icon").agg(F.countDistinct("item").alias("n")).join(total, ["hash", "n"]).select("hash", "icon")
    kept = rows.join(common, ["hash", "icon"]).groupBy("hash")
    return kept.agg(F.array_sort(F.collect_set("icon")).alias("icons"), F.array_sort(F.collect_set("identity")).alias("cands"), F.collect_set(F.struct("tier", "identity")).alias("at_tier"))


def agreed(keys: DataFrame, value: str) -> DataFrame:
    """(hash, value): what all hand-kept entries of a hash say; null where they disagree."""
    return keys.groupBy("hash").agg(F.when(F.countDistinct(value) == 1, F.min(value)).alias(value))


def believed(by_hand: DataFrame, dimension: DataFrame) -> DataFrame:
    """by_hand (hash, given, icons, tier) with `manual`: the given name, if the dimension has it, its icon is possible (or no icon
    is known), and a known tier is its own."""
    d = dimension.select(F.col("name").alias("given"), F.col("icon").alias("_icon"), F.col("tier").alias("_tier"))
    ok = F.col("_icon").isNotNull() & (F.col("icons").isNull() | F.array_contains("icons", F.col("_icon"))) & (F.col("tier").isNull() | (F.col("tier") == F.col("_tier")))
    return by_hand.join(d, "given", "left").withColumn("manual", F.when(ok, F.col("given"))).drop("_icon", "_tier")


def recognised(predicted: DataFrame, dimension: DataFrame) -> DataFrame:
    """predicted (hash, seen, icons, cands) with `matches`: the names of the key that the classifier saw whose identity and icon
    are possible, sorted. Never trusted alone: without candidates there are none."""
    names = dimension.groupBy(F.col("key").alias("seen")).agg(F.array_sort(F.collect_list(F.struct("name", "identity", "icon"))).alias("of"))
    fits = F.filter("of", lambda m: F.array_contains("cands", m["identity"]) & F.array_contains("icons", m["icon"]))
    return predicted.join(names, "seen", "left").withColumn("matches", F.coalesce(F.transform(fits, lambda m: m["name"]), F.array().cast(NONE))).drop("of")


def narrowed(old: Column, new: Column) -> Column:
    """The old set cut to the new one, unless nothing is left."""
    both = F.array_intersect(old, new)
    return F.when(F.size(both) > 0, both).otherwise(old)


def members_of(dimension: DataFrame, shown) -> DataFrame:
    """(identity, members, shown, parts): the names of an identity, the one to show, and each one's tier and icon."""
    held = dimension.groupBy("identity").agg(F.array_sort(F.collect_list("name")).alias("members"), F.collect_list(F.struct("tier", "icon", "key")).alias("parts"))
    return held.withColumn("shown", shown(F.col("identity"), F.col("members")))


def label(clusters: DataFrame, offers: DataFrame, dimension: DataFrame, promoted: DataFrame, notes: DataFrame, by_hand: DataFrame, predicted: DataFrame, shown) -> DataFrame:
    """(hash, branch, source, label, identity, key, candidates, tier, tier_narrowed, anomaly), a row for each cluster.

    Branches, the first that applies: promoted (hash, promoted), truth (one label), truth_ambiguous (more), manual (by_hand:
    hash, given), classifier (predicted: hash, seen; one match), collision (more matches: the key is sure, the name cannot be),
    single (one identity left, after narrowing by a note's tier, whose one name at that tier has a possible icon), open.
    A cluster that only items speak for and whose items share no icon is an anomaly."""
    out = clusters.join(possible(clusters, offers, dimension), "hash", "left").join(promoted, "hash", "left").join(notes, "hash", "left")
    out = believed(out.join(by_hand, "hash", "left"), dimension)
    out = recognised(out.join(predicted, "hash", "left"), dimension)
    n, k = F.size("truth"), F.size("matches")
    inferring = F.col("promoted").isNull() & (n == 0)
    anomaly = inferring & F.col("icons").isNull()
    branch = F.when(F.col("promoted").isNotNull(), "promoted").when(n == 1, "truth").when(n > 1, "truth_ambiguous")
    branch = branch.when(~anomaly & F.col("manual").isNotNull(), "manual").when(k == 1, "classifier").when(k > 1, "collision")
    out = out.withColumn("anomaly", anomaly).withColumn("branch", branch)
    # what is left of the candidates where no witness names the cluster
    at_note = F.transform(F.filter("at_tier", lambda x: x["tier"] == F.col("tier")), lambda x: x["identity"])
    has_note = F.col("branch").isNull() & ~F.col("anomaly") & F.col("tier").isNotNull()
    out = out.withColumn("tier_narrowed", has_note & F.arrays_overlap("cands", F.coalesce(at_note, F.array().cast(NONE))))
    out = out.withColumn("left", F.when(has_note, F.array_sort(narrowed(F.col("cands"), at_note))).otherwise(F.col("cands")))
    out = out.withColumn("one", F.when(F.col("branch").isNull() & (F.size("left") == 1), F.get("left", F.lit(0))))
    held = members_of(dimension, shown)
    out = out.join(held.withColumnRenamed("identity", "one"), "one", "left")
    tier = F.when(F.col("tier_narrowed"), F.col("tier")).when(F.size("members") == 1, F.get("parts", F.lit(0))["tier"])
    out = out.withColumn("_tier", tier)
    out = out.withColumn("at", F.filter("parts", lambda p: (p["tier"] == F.col("_tier")) & F.array_contains("icons", p["icon"])))
    # read several times below: one written table, which also cuts the lineage
    shared_folder(clusters.sparkSession)
    out = out.withColumn("branch", F.coalesce("branch", F.when(F.size("at") == 1, "single"), F.lit("open"))).checkpoint()
    given = F.when(F.col("branch") == "promoted", F.col("promoted")).when(F.col("branch") == "truth", F.get("truth", F.lit(0))).when(F.col("branch") == "manual", F.col("manual")).when(F.col("branch") == "classifier", F.get("matches", F.lit(0)))
    out = out.withColumn("given_name", given).join(dimension.select(F.col("name").alias("given_name"), F.col("identity").alias("_identity"), F.col("key").alias("_key")), "given_name", "left")
    # a key of conflicting labels stands if all of them have it
    told = clusters.where(F.size("truth") > 1).select("hash", F.explode("truth").alias("name")).join(dimension.select("name", "key"), "name", "left")
    told = told.groupBy("hash").agg(F.when((F.countDistinct("key") == 1) & (F.count("key") == F.count("*")), F.min("key")).alias("_told"))
    out = out.join(told, "hash", "left")
    is_ = lambda b: F.col("branch") == b
    key = F.when(is_("truth_ambiguous"), F.col("_told")).when(is_("collision"), F.col("seen")).when(is_("single"), F.get("at", F.lit(0))["key"]).otherwise(F.col("_key"))
    source = F.when(is_("promoted"), "campaign_confirmed").when(is_("truth"), "ground_truth").when(is_("truth_ambiguous"), "ground_truth_ambiguous").when(is_("manual"), "manual").when(is_("classifier"), "embedding_confirmed").otherwise("inferred")
    named = dimension.select("name", "identity")
    # candidates are shown where no label is: identities by the name to show, conflicting labels as they are
    tied = out.where(is_("collision")).select("hash", F.explode("matches").alias("name")).join(named, "name").select("hash", "identity")
    open_ = out.where(is_("open") & ~F.col("anomaly")).select("hash", F.explode("left").alias("identity")).union(tied).distinct().join(held.select("identity", "shown"), "identity").select("hash", "shown")
    listed = open_.union(out.where(is_("truth_ambiguous")).select("hash", F.explode("truth"))).groupBy("hash").agg(F.array_sort(F.collect_set("shown")).alias("candidates"))
    labels = F.when(is_("single"), F.col("shown")).otherwise(F.col("given_name"))
    done = out.select("hash", "branch", source.alias("source"), labels.alias("label"), F.when(is_("single"), F.col("one")).otherwise(F.col("_identity")).alias("identity"), key.alias("key"), F.when(inferring, F.col("tier")).alias("tier"), (F.col("tier_narrowed") & inferring).alias("tier_narrowed"), "anomaly")
    return done.join(listed, "hash", "left")


def reclassified(labelled: DataFrame) -> DataFrame:
    """labelled with source, label, identity and candidates settled per key: if the labels of a key's clusters, and the
    candidates of those without a label, are more than one, none of them is believed. Labels per key are names of the
    dimension, so the sets are small; clusters are only joined with them."""
    said = labelled.where("key is not null").select("key", F.explode(F.when(F.col("label").isNotNull(), F.array("label")).otherwise(F.coalesce("candidates", F.array().cast(NONE)))).alias("x"))
    many = said.groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("_all")).where(F.size("_all") > 1)
    out = labelled.join(many, "key", "left")
    torn = F.col("_all").isNotNull()
    settled = {"source": F.when(torn, "visual_key_ambiguous").otherwise(F.col("source")), "label": F.when(~torn, F.col("label")), "identity": F.when(~torn, F.col("identity")), "candidates": F.when(torn, F.col("_all")).otherwise(F.col("candidates"))}
    return out.select(*[settled[c].alias(c) if c in settled else F.col(c) for c in labelled.columns])
