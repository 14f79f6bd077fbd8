"""Duplicate records: blocked pairs, compatibility, components, representatives, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import multiset_compatible, name_similarity
from quarry.functions.text import normalize_name
from quarry.operators.graph import connected_components
from quarry.operators.ranking import dense_ids
from quarry.plans.catalog import query
from quarry.runtime import shared_folder
from quarry.sources.tables import read

NAME_FLOOR = 0.85
_RECORDS = """slot AS (
  SELECT l_orderkey AS id, p_type AS item, CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN 'Unknown' ELSE l_returnflag || l_linestatus END AS att,
    row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC, l_linestatus DESC, l_discount DESC, l_tax DESC) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey
), rec AS (
  SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p, o_orderkey % 17 <> 0 AS named, o_orderkey % 5 = 3 AS other, nullif(o_orderstatus, 'P') AS level, list_sort(list(item) FILTER (WHERE rn = 1)) AS items,
    list(struct_pack(i := item, a := att) ORDER BY item) FILTER (WHERE rn = 1) AS blocks, bool_or(att IS NOT NULL) AS has
  FROM orders JOIN slot ON slot.id = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderstatus
)"""
_PAIRS = """pair AS (
  SELECT a.id AS a, b.id AS b, len(list_filter(a.items, lambda v: NOT list_contains(b.items, v))) AS x, len(list_filter(b.items, lambda v: NOT list_contains(a.items, v))) AS y,
    a.level IS NULL OR b.level IS NULL OR a.level = b.level AS level_fits, a.has AND b.has AS have_both,
    len(list_filter(a.blocks, lambda u: len(list_filter(b.blocks, lambda v: v.i = u.i AND CASE WHEN (u.a IS NULL) <> (v.a IS NULL) THEN true WHEN u.a IS NULL THEN false ELSE u.a <> 'Unknown' AND v.a <> 'Unknown' AND u.a <> v.a END)) > 0)) = 0 AS fits
  FROM rec a JOIN rec b ON a.c = b.c AND a.p = b.p AND a.id < b.id WHERE a.named AND b.named AND a.other = b.other
)"""
_EDGES = """edge AS (
  SELECT a, b, x + y > 0 OR NOT have_both AS low FROM pair WHERE level_fits AND ((x = 0 AND y <= 1) OR (y = 0 AND x <= 1)) AND (fits OR NOT have_both)
)"""


def records(spark, sf_dir: str) -> DataFrame:
    """(id, c, p, name, level, items, blocks, has): an order with its sorted distinct item kinds and, for each, the attachments
    of its last line; has: whether any line has some. Block keys are customer and priority; level may be null."""
    orders, lines, part = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    att = F.when(F.col("l_discount") == 0, F.array().cast("array<string>")).when(F.col("l_tax") == 0, F.array(F.lit("Unknown"))).otherwise(F.array(F.concat("l_returnflag", "l_linestatus")))
    last = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    slot = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id"), F.col("p_type").alias("i"))
    slot = slot.agg(F.max_by(att, last).alias("a"), F.bool_or(F.size(att) > 0).alias("has"))
    per = slot.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("blocks"), F.bool_or("has").alias("has"))
    # names as they are read of one customer: not at all, in other cases and marks, without a letter (a ratio of 0.95), or as
    # another name altogether (a ratio of 0.5 at most)
    said = F.concat(F.lit("customer "), "o_custkey")
    k = F.col("o_orderkey") % 5
    name = F.when(F.col("o_orderkey") % 17 == 0, "").when(k == 3, F.concat(F.lit("Qwxz Vwj "), "o_custkey")).when(k == 2, F.concat(F.lit("custmer "), "o_custkey")).when(k == 1, F.concat(F.upper(said), F.lit("!"))).otherwise(said)
    out = orders.join(per, F.col("o_orderkey") == F.col("id"))
    return out.select("id", F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), name.alias("name"), F.nullif("o_orderstatus", F.lit("P")).alias("level"), F.transform("blocks", lambda x: x["i"]).alias("items"), "blocks", "has")


def candidate_pairs(rec: DataFrame) -> DataFrame:
    """Pairs a < b of one block whose item sets differ by two at most, with the sizes of their differences and what else is compared."""
    side = lambda s: rec.select(F.col("id").alias(s), "c", "p", *[F.col(k).alias(f"{k}_{s}") for k in ("name", "level", "items", "blocks", "has")])
    pairs = side("a").join(side("b"), ["c", "p"]).where("a < b")
    pairs = pairs.withColumn("x", F.size(F.array_except("items_a", "items_b"))).withColumn("y", F.size(F.array_except("items_b", "items_a")))
    return pairs.where("x + y <= 2")  # what no rule below looks at goes before any name is compared


def judged_pairs(rec: DataFrame) -> DataFrame:
    """(a, b, x, y, same, low) of the pairs whose names are alike: whether they are one, and whether with low confidence.

    One: level equal where both have one, item sets equal or one of them short of one item, and, where both records have
    attachments, those of every shared item compatible. Low: an item short, or attachments missing.
    """
    near = (F.col("x") == 0) & (F.col("y") <= 1) | (F.col("y") == 0) & (F.col("x") <= 1)
    level = F.coalesce(F.col("level_a") == F.col("level_b"), F.lit(True))
    clash = F.exists("blocks_a", lambda u: F.exists("blocks_b", lambda v: (u["i"] == v["i"]) & ~multiset_compatible(u["a"], v["a"])))
    both = F.col("has_a") & F.col("has_b")
    pairs = candidate_pairs(rec).withColumn("same", near & level & (~both | ~clash)).withColumn("low", (F.col("x") + F.col("y") > 0) | ~both)
    alike = (normalize_name(F.col("name_a")) == normalize_name(F.col("name_b"))) & (normalize_name(F.col("name_a")) != "")
    # one pass over the pairs: names that are alike go to Python as nulls
    rest = [F.when(~alike, F.col(c)) for c in ("name_a", "name_b")]
    ratio = F.when(alike, 1.0).otherwise(name_similarity(*rest))
    return pairs.where(ratio >= NAME_FLOOR).select("a", "b", "x", "y", "same", "low")


def duplicate_edges(rec: DataFrame) -> DataFrame:
    """(a, b, low) of the pairs that are one."""
    return judged_pairs(rec).where("same").select("a", "b", "low")


@query(f"""
WITH RECURSIVE {_RECORDS}, {_PAIRS}, {_EDGES}, two_way AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, root) AS (SELECT a, a FROM two_way UNION SELECT b, root FROM reach JOIN two_way ON a = node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
lows AS (SELECT root, bool_or(low) AS low FROM edge JOIN comp ON node = a GROUP BY root)
SELECT root AS representative, count(*) AS members, count(*) - 1 AS rematch_count, any_value(low) AS low_confidence
FROM comp JOIN lows USING (root) GROUP BY root""")
def resolve_duplicates(spark, sf_dir):
    shared_folder(spark)
    edges = duplicate_edges(records(spark, sf_dir)).checkpoint()
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    comp = connected_components(nodes, edges)
    lows = edges.join(comp, F.col("a") == F.col("id")).groupBy("root").agg(F.bool_or("low").alias("low_confidence"))
    sizes = comp.groupBy("root").agg(F.count("*").alias("members"))
    return sizes.join(lows, "root").select(F.col("root").alias("representative"), "members", (F.col("members") - 1).alias("rematch_count"), "low_confidence")


@query(f"""
WITH {_RECORDS}, {_PAIRS}, {_EDGES}
SELECT a, b, x + y AS differing FROM pair WHERE x + y BETWEEN 1 AND 2 AND (a, b) NOT IN (SELECT (a, b) FROM edge)""")
def near_misses(spark, sf_dir):
    """Pairs of alike names whose items differ by one or two and that are not one."""
    pairs = judged_pairs(records(spark, sf_dir)).where("not same and x + y between 1 and 2")
    return pairs.select("a", "b", (F.col("x") + F.col("y")).cast("long").alias("differing"))


@query("""
WITH pool AS (SELECT DISTINCT o_orderpriority AS block, p_type AS item FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT p_type FROM part)),
n AS (SELECT o_orderpriority AS block, p_type AS item, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT block, item, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (PARTITION BY block), 6) AS share
FROM pool LEFT JOIN n USING (block, item)""")
def share_of_fills(spark, sf_dir):
    orders, lines, part = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    # the pool: a handful of blocks and kinds, both closed lists
    pool = orders.select(F.col("o_orderpriority").alias("block")).distinct().crossJoin(part.select(F.col("p_type").alias("item")).distinct())
    n = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("block"), F.col("p_type").alias("item")).agg(F.count("*").alias("n"))
    full = pool.join(n, ["block", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("block")), 6))


@query("""
WITH lots AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag || l_linestatus AS att FROM lineitem),
got AS (SELECT id, list(att ORDER BY pos, att) AS atts FROM lots GROUP BY id)
SELECT id, list_extract(atts, 1) AS a1, coalesce(list_extract(atts, 2), '') AS a2, coalesce(list_extract(atts, 3), '') AS a3, coalesce(list_extract(atts, 4), '') AS a4,
  CASE WHEN len(atts) > 4 THEN 'Y' ELSE '' END AS more
FROM got""")
def pad_to_four(spark, sf_dir):
    from quarry.functions.text import pad

    lots = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("att")).alias("x"))
    got = lots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["att"]).alias("atts"))
    four = pad(F.col("atts"), 4)
    return got.select("id", *[four[i].alias(f"a{i + 1}") for i in range(4)], F.when(F.size("atts") > 4, "Y").otherwise("").alias("more"))


@query(f"""
WITH {_RECORDS}
SELECT 'm' || lpad(CAST(row_number() OVER (ORDER BY c, p) AS VARCHAR), CAST(greatest(4, len(CAST(row_number() OVER (ORDER BY c, p) AS VARCHAR))) AS INTEGER), '0') AS identity, c, p, min(id) AS representative, count(*) - 1 AS rematch_count
FROM rec GROUP BY c, p""")
def dense_identities(spark, sf_dir):
    """Blocks as identities, numbered m0001 onwards in key order."""
    g = records(spark, sf_dir).groupBy("c", "p").agg(F.min("id").alias("representative"), (F.count("*") - 1).alias("rematch_count"))
    return dense_ids(g, ["c", "p"], "n").select(F.format_string("m%04d", "n").alias("identity"), "c", "p", "representative", "rematch_count")
