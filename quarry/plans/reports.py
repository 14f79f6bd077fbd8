"""Ordered reports: manifests, queues, audits, collisions, notes, counters, and the small forms that go with them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.operators import cascade
from quarry.operators.ranking import dense_ids
from quarry.operators.vectors import scores, top_two
from quarry.plans.cascade import _TABLES, full_dimension, offers, witnesses
from quarry.plans.catalog import query
from quarry.plans.identities import shown_name
from quarry.plans.lineage import _CLUSTERS, clusters
from quarry.plans.measures import _SCORES, references
from quarry.sources.tables import read


def first_and_more(names: Column, n: int, sep: str) -> Column:
    """The first n of a list, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, n), sep), F.when(F.size(names) > n, F.concat(F.lit(", +"), (F.size(names) - n).cast("string"), F.lit(" more"))).otherwise(""))


@query(f"""
WITH {_CLUSTERS}, m AS (SELECT hash, n, CASE WHEN first_id % 3 > 0 THEN sources[1] END AS key FROM clu)
SELECT hash, n, key, row_number() OVER (ORDER BY key IS NULL, key, n DESC, hash) AS place FROM m""")
def manifest_order(spark, sf_dir):
    """Every cluster's place in the manifest: by key, those without one last, then the most frequent first; ranked over ranges."""
    m = clusters(spark, sf_dir).select("hash", "n", F.when(F.col("first_id") % 3 > 0, F.get("sources", F.lit(0))).alias("key"))
    return dense_ids(m, [F.col("key").asc_nulls_last(), F.desc("n"), "hash"], "place").select("hash", "n", "key", F.col("place").cast("long"))


@query(f"""
WITH {_TABLES}
SELECT hash, candidates, row_number() OVER (ORDER BY len(candidates), hash) AS place FROM lab WHERE source = 'inferred' AND label IS NULL AND len(candidates) > 0""")
def review_queue(spark, sf_dir):
    """What a person should look at: inferred clusters without a label that have candidates, the fewest candidates first."""
    lab = cascade.label(**witnesses(spark, sf_dir), shown=shown_name).where("source = 'inferred' and label is null and candidates is not null")
    ranked = dense_ids(lab.select("hash", "candidates").withColumn("many", F.size("candidates")), ["many", "hash"], "place")
    return ranked.select("hash", "candidates", F.col("place").cast("long"))


@query(f"""
WITH {_TABLES}
SELECT key, count(*) AS n, list_sort(list(DISTINCT source)) AS sources, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label FROM lab WHERE key LIKE '%\\_i' ESCAPE '\\' GROUP BY 1""")
def first_tier_audit(spark, sf_dir):
    """Keys of the first tier with their clusters, who labelled them, and the label if all agree."""
    lab = cascade.label(**witnesses(spark, sf_dir), shown=shown_name).where(F.endswith("key", F.lit("_i")))
    return lab.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), F.when(F.countDistinct("label") == 1, F.min("label")).alias("label"))


_CLASH = f"""{_TABLES}, grp AS (SELECT key, list(name ORDER BY name) AS names FROM d GROUP BY 1 HAVING count(*) > 1),
clash AS (SELECT key, item FROM (SELECT DISTINCT item, name FROM off) JOIN d USING (name) GROUP BY 1, 2 HAVING count(*) > 1)"""


def clashes(spark, sf_dir):
    """(key, item): an item that offers several names of one key."""
    held = offers(spark, sf_dir).select("item", "name").distinct().join(full_dimension(spark, sf_dir).select("name", "key"), "name")
    return held.groupBy("key", "item").agg(F.count("*").alias("n")).where("n > 1").select("key", "item")


@query(f"""
WITH {_CLASH}, per AS (SELECT key, list_sort(list(item)) AS items FROM clash GROUP BY 1)
SELECT key, array_to_string(names[1:6], ' / ') || CASE WHEN len(names) > 6 THEN ', +' || (len(names) - 6) || ' more' ELSE '' END AS names, coalesce(len(items), 0) AS n_items,
  CASE WHEN items IS NULL THEN NULL ELSE array_to_string(items[1:3], ', ') || CASE WHEN len(items) > 3 THEN ', +' || (len(items) - 3) || ' more' ELSE '' END END AS items
FROM grp LEFT JOIN per USING (key)""")
def collision_report(spark, sf_dir):
    """Keys that several names share, and the items that offer two or more of them, the first few of both written out."""
    shared = full_dimension(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") > 1)
    per = clashes(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    shown = first_and_more(F.transform("items", lambda x: x.cast("string")), 3, ", ")
    return shared.join(per, "key", "left").select("key", first_and_more(F.col("names"), 6, " / ").alias("names"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.when(F.col("items").isNotNull(), shown).alias("items"))


@query(f"""
WITH {_CLASH}
SELECT count(DISTINCT off.item) AS containers, count(DISTINCT clash.item) AS colliding, round(count(DISTINCT clash.item) * 100.0 / count(DISTINCT off.item), 6) AS share FROM off LEFT JOIN clash USING (item)""")
def collision_prevalence(spark, sf_dir):
    """How many items offer at least two names that look alike."""
    bad = clashes(spark, sf_dir).select("item").distinct().withColumn("bad", F.lit(1))
    both = offers(spark, sf_dir).select("item").distinct().join(bad, "item", "left").agg(F.count("*").alias("containers"), F.count("bad").alias("colliding"))
    return both.withColumn("share", F.round(F.col("colliding") * 100.0 / F.col("containers"), 6))


@query("""
WITH known AS (SELECT DISTINCT p_name AS name FROM part), notes AS (SELECT p_brand || '/' || p_size % 4 AS reason, CASE WHEN p_partkey % 3 = 0 OR p_size % 4 = 3 THEN p_name || '?' ELSE p_name END AS name FROM part WHERE p_size < 9)
SELECT reason, list_sort(list(DISTINCT known.name) FILTER (WHERE known.name IS NOT NULL)) AS names, coalesce(list_sort(list(DISTINCT notes.name) FILTER (WHERE known.name IS NULL)), []) AS dropped FROM notes LEFT JOIN known USING (name) GROUP BY 1 HAVING count(known.name) > 0""")
def flag_notes(spark, sf_dir):
    """Hand-kept groups of names under a reason: names that the dimension lacks are told and dropped, groups without any left too."""
    part = read(spark, sf_dir, "part")
    notes = part.where("p_size < 9").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("reason"), F.when((F.col("p_partkey") % 3 == 0) | (F.col("p_size") % 4 == 3), F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"))
    grouped = notes.groupBy("reason").agg(F.collect_set("name").alias("names"))  # as the file has them
    return checked_notes(grouped, part.select(F.col("p_name").alias("name")).distinct())


def checked_notes(notes, known):
    """notes (reason, names) with `dropped`: the names that known (name) lacks; groups with no known name go."""
    flat = notes.select("reason", F.explode("names").alias("name")).distinct().join(known.select("name", F.lit(True).alias("_ok")), "name", "left")
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    return flat.groupBy("reason").agg(some(F.col("_ok").isNotNull()).alias("names"), some(F.col("_ok").isNull()).alias("dropped")).where(F.size("names") > 0)


@query("""
WITH n AS (SELECT p_type AS block, p_name AS item, count(*) AS n FROM part GROUP BY 1, 2)
SELECT block, item, n, row_number() OVER (PARTITION BY block ORDER BY n DESC, item) AS place FROM n""")
def stats_order(spark, sf_dir):
    """The items of a block by how often they are filled, equals by name. Blocks and items are closed lists."""
    n = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("block"), F.col("p_name").alias("item")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("n"), "item")).cast("long"))


@query("""
WITH b AS (SELECT p_name AS name, count(DISTINCT p_brand) FILTER (WHERE p_size > 10) AS breadth FROM part GROUP BY 1)
SELECT name, breadth, row_number() OVER (ORDER BY breadth DESC, name) AS place FROM b WHERE breadth > 0""")
def breadth_order(spark, sf_dir):
    """Names by how many containers allow them, the broadest first; those that none allows are not in the report."""
    b = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct(F.when(F.col("p_size") > 10, F.col("p_brand"))).alias("breadth")).where("breadth > 0")
    return dense_ids(b, [F.desc("breadth"), "name"], "place").withColumn("place", F.col("place").cast("long"))


@query(f"""
WITH {_SCORES}, occ AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), mid AS (SELECT median(n) AS m FROM occ),
g AS (SELECT best.vec_id, embeddings.label, key AS first, CASE WHEN best.vec_id % 7 = 0 THEN label WHEN best.vec_id % 5 = 0 THEN (key + 1) % 10 ELSE key END AS guess, n >= m AS multi FROM best JOIN embeddings USING (vec_id) JOIN occ USING (label), mid)
SELECT count(*) AS total, count(*) FILTER (WHERE guess = label) AS exact, count(*) FILTER (WHERE guess % 5 = label % 5) AS family, count(*) FILTER (WHERE multi) AS multi_total, count(*) FILTER (WHERE multi AND guess = label) AS multi_exact,
  count(*) FILTER (WHERE guess <> first) AS overrides, count(*) FILTER (WHERE guess = label AND first <> label) AS helped, count(*) FILTER (WHERE first = label AND guess <> label) AS hurt,
  count(*) FILTER (WHERE guess = label AND first <> label) - count(*) FILTER (WHERE first = label AND guess <> label) AS net FROM g""")
def accuracy_counters(spark, sf_dir):
    """What a classifier gets right, alone and after its tier was overridden, and what the overriding helped and hurt."""
    e = read(spark, sf_dir, "embeddings")
    occ = e.groupBy("label").agg(F.count("*").alias("n"))
    mid = F.broadcast(occ.agg(F.median("n").alias("m")))  # one row
    g = top_two(scores(e, references(spark, sf_dir))).join(e.select("vec_id", "label"), "vec_id").join(occ, "label").join(mid)
    guess = F.when(F.col("vec_id") % 7 == 0, F.col("label")).when(F.col("vec_id") % 5 == 0, (F.col("key") + 1) % 10).otherwise(F.col("key"))
    g = g.select("label", F.col("key").alias("first"), guess.alias("guess"), (F.col("n") >= F.col("m")).alias("multi"))
    right, was = F.col("guess") == F.col("label"), F.col("first") == F.col("label")
    made = {"exact": right, "family": F.col("guess") % 5 == F.col("label") % 5, "multi_total": F.col("multi"), "multi_exact": F.col("multi") & right, "overrides": F.col("guess") != F.col("first"), "helped": right & ~was, "hurt": was & ~right}
    return g.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in made.items()]).withColumn("net", F.col("helped") - F.col("hurt"))


@query(f"""WITH {_SCORES}, m AS (SELECT vec_id, key, 1 - score AS margin FROM sc JOIN embeddings USING (vec_id) WHERE label = 0 AND key <> 0)
SELECT round(min(margin), 6) AS margin, arg_min(vec_id, (margin, vec_id, key)) AS vec_id, arg_min(key, (margin, vec_id, key)) AS key FROM m""")
def worst_pair(spark, sf_dir):
    """The pair of a vector of one label and a reference of another that come nearest, with what lies between them."""
    e = read(spark, sf_dir, "embeddings")
    m = scores(e.where("label = 0"), references(spark, sf_dir).where("key <> 0")).withColumn("margin", 1 - F.col("score"))
    return m.agg(F.min(F.struct("margin", "vec_id", "key")).alias("x")).select(F.round("x.margin", 6).alias("margin"), "x.vec_id", "x.key")


@query("""
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS record, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, 'captures/' || lower(o_orderstatus) || '/' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS path FROM orders""")
def record_stamps(spark, sf_dir):
    """Record ids, ISO seconds, and paths below a root with one kind of slash."""
    at = F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    raw = F.concat(F.lit("C:\\root\\captures\\"), F.lower("o_orderstatus"), F.lit("/"), at)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.alias("record"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), relative_path(raw, "C:/root").alias("path"))


def relative_path(path: Column, root: str) -> Column:
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(plain, F.lit(f"{root}/")), F.substr(plain, F.lit(len(root) + 2))).otherwise(plain)


@query("""
WITH refs AS (SELECT p_name AS name, p_type AS category, p_partkey AS ord FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL')), first_ AS (SELECT name, arg_min(category, ord) AS category FROM refs GROUP BY 1)
SELECT p_partkey AS id, category FROM part LEFT JOIN first_ ON first_.name = p_name""")
def name_category(spark, sf_dir):
    """The category of a name: that of the first reference of it in the allowed categories; null if they have none."""
    from quarry.sources.records import category_of

    part = read(spark, sf_dir, "part")
    refs = part.where(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")).select(F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"), F.lit("").alias("path"))
    return category_of(part.select(F.col("p_partkey").alias("id"), "p_name"), "p_name", refs).select("id", "category")


@query("""
WITH s AS (SELECT l_orderkey AS id, unnest(range(1, 7)) AS slot FROM (SELECT DISTINCT l_orderkey FROM lineitem)), r AS (SELECT l_orderkey AS id, l_linenumber AS slot, min(p_name) AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 8 GROUP BY 1, 2)
SELECT id, coalesce(list(item ORDER BY slot) FILTER (WHERE item IS NOT NULL), []) AS items, coalesce(list(slot - 1 ORDER BY slot) FILTER (WHERE item IS NULL), []) AS unread FROM s LEFT JOIN r USING (id, slot) GROUP BY 1""")
def compact_rows(spark, sf_dir):
    """Six slots of a record without those that were not read, in order, and which these are."""
    item = F.when(F.col("l_quantity") > 8, F.struct(F.col("l_linenumber").cast("int").alias("slot"), F.col("p_name").alias("item")))
    per = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(item)).alias("x"))
    slots = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.get(F.filter("x", lambda s: s["slot"] == i), F.lit(0))["item"])
    rows = per.select("id", slots.alias("rows"))
    unread = F.filter(F.transform("rows", lambda r, i: F.when(r.isNull(), i.cast("long"))), lambda i: i.isNotNull())
    return rows.select("id", compacted(F.col("rows")).alias("items"), unread.alias("unread"))


def compacted(rows: Column) -> Column:
    """Without the nulls; only where positions no longer matter."""
    return F.filter(rows, lambda r: r.isNotNull())
