"""Vectors, runs and shares."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import masked_ncc, multiset_compatible
from quarry.operators import sequences as S
from quarry.operators.vectors import accept, scores, top_two
from quarry.plans.catalog import query
from quarry.sources.tables import read

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_SCORES = f"""ref AS (SELECT label AS key, embedding, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
sc AS (SELECT a.vec_id, b.key, {_COS} AS score FROM embeddings a CROSS JOIN ref b),
top AS (SELECT vec_id, key, score, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, key) AS nxt, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, key) AS rn FROM sc),
best AS (SELECT vec_id, key, score, coalesce(nxt, -1) AS second FROM top WHERE rn = 1)"""


def references(spark, sf_dir):
    """One vector per label: that of the smallest id."""
    e = read(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").alias("key")).agg(F.min_by("embedding", "vec_id").alias("ref"))


def best(spark, sf_dir):
    return top_two(scores(read(spark, sf_dir, "embeddings"), references(spark, sf_dir)))


@query(f"WITH {_SCORES} SELECT vec_id, CASE WHEN score >= 0.2 THEN key END AS value, round(score, 6) AS score, CASE WHEN score >= 0.2 THEN 'accepted' ELSE 'below_floor' END AS status FROM best")
def nn_top1_floor(spark, sf_dir):
    return accept(best(spark, sf_dir), 0.2, -2.0).select("vec_id", "value", F.round("score", 6).alias("score"), "status")


@query(f"""WITH {_SCORES}, two AS (SELECT vec_id, max(CASE WHEN key = 0 THEN score END) AS s0, max(CASE WHEN key = 1 THEN score END) AS s1 FROM sc WHERE key IN (0, 1) GROUP BY 1)
SELECT vec_id, CASE WHEN abs(s0 - s1) >= 0.02 THEN CASE WHEN s0 > s1 THEN 0 ELSE 1 END END AS value FROM two""")
def nn_pair_margin(spark, sf_dir):
    two = scores(read(spark, sf_dir, "embeddings"), references(spark, sf_dir).where("key in (0, 1)")).groupBy("vec_id").agg(F.max(F.when(F.col("key") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("key") == 1, F.col("score"))).alias("s1"))
    return two.select("vec_id", F.when(F.abs(F.col("s0") - F.col("s1")) >= 0.02, F.when(F.col("s0") > F.col("s1"), 0).otherwise(1)).alias("value"))


@query(f"WITH {_SCORES} SELECT vec_id, CASE WHEN score >= 0.15 AND score - second >= 0.025 THEN key END AS value, CASE WHEN score >= 0.15 AND score - second >= 0.025 THEN 'accepted' WHEN score < 0.15 THEN 'below_floor' ELSE 'near_tie' END AS status FROM best")
def nn_top2_margin(spark, sf_dir):
    return accept(best(spark, sf_dir), 0.15, 0.025).select("vec_id", "value", "status")


@query(f"""WITH {_SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE key = label) AS exact, count(*) FILTER (WHERE key % 5 = label % 5) AS family, count(*) FILTER (WHERE score >= 0.2 AND key <> label) AS hurt
FROM best JOIN embeddings USING (vec_id)""")
def classifier_report(spark, sf_dir):
    both = best(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    same = F.col("key") == F.col("label")
    return both.agg(F.count("*").alias("total"), F.count_if(same).alias("exact"), F.count_if(F.col("key") % 5 == F.col("label") % 5).alias("family"), F.count_if((F.col("score") >= 0.2) & ~same).alias("hurt"))


@query(f"WITH {_SCORES} SELECT label, round(min(score - second), 6) AS margin, arg_min(vec_id, (score - second, vec_id)) AS vec_id FROM best JOIN embeddings USING (vec_id) GROUP BY label")
def worst_margin_pair(spark, sf_dir):
    both = best(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").withColumn("m", F.col("score") - F.col("second"))
    return both.groupBy("label").agg(F.round(F.min("m"), 6).alias("margin"), F.min_by("vec_id", F.struct("m", "vec_id")).alias("vec_id"))


@query(f"""WITH {_SCORES}, real_key AS (SELECT DISTINCT p_size % 10 AS icon, length(p_type) % 3 AS tier FROM part WHERE p_size < 8)
SELECT vec_id, key AS icon, CASE WHEN r.icon IS NULL THEN key % 3 ELSE vec_id % 3 END::BIGINT AS tier, CASE WHEN score < 0.1 THEN 'Unknown' ELSE 'v' || key END AS name
FROM best LEFT JOIN real_key r ON r.icon = key AND r.tier = vec_id % 3""")
def tier_override(spark, sf_dir):
    """A badge's tier counts only if icon and tier are a key of the dimension."""
    real = read(spark, sf_dir, "part").where("p_size < 8").select((F.col("p_size") % 10).alias("icon"), (F.length("p_type") % 3).alias("badge")).distinct()
    b = best(spark, sf_dir).withColumn("badge", F.col("vec_id") % 3)
    out = b.join(real, (F.col("key") == F.col("icon")) & (b.badge == real.badge), "left")
    return out.select("vec_id", F.col("key").alias("icon"), F.when(F.col("icon").isNull(), F.col("key") % 3).otherwise(b.badge).cast("long").alias("tier"), F.when(F.col("score") < 0.1, "Unknown").otherwise(F.concat(F.lit("v"), F.col("key").cast("string"))).alias("name"))


@query("""
WITH t AS (SELECT embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT 1), m AS (SELECT vec_id, embedding::DOUBLE[] AS y, x FROM embeddings, t)
SELECT vec_id, round(list_dot_product(list_transform(x, lambda v: CASE WHEN v > 0 THEN v ELSE 0 END), y) / sqrt(list_dot_product(list_transform(x, lambda v: CASE WHEN v > 0 THEN v ELSE 0 END), x) * list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] > 0 THEN y[i] * y[i] ELSE 0 END))), 6) AS ncc FROM m""")
def masked_correlation(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("y"))
    one = e.orderBy("vec_id").limit(1).select(F.col("y").alias("x"))
    mask = F.transform("x", lambda v: v > 0)
    return e.join(F.broadcast(one)).select("vec_id", F.round(masked_ncc(F.col("x"), F.col("y"), mask), 6).alias("ncc"))


@query("SELECT l_orderkey AS id, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1 HAVING stddev_pop(l_quantity) >= 5.0")
def occupancy_filter(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_quantity").alias("m"), spread("l_quantity").alias("s"))
    return g.where("s >= 5.0").select("id", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"))


def spread(column: str) -> Column:
    """stddev_pop of a group. Where sums of whole numbers are exact in doubles it is rounded only at the end, so that a group
    which meets a floor exactly meets it in whatever order its rows are merged."""
    x, n = F.col(column), F.count(column)
    total, squares = F.sum(x), F.sum(x * x)
    exact = F.bool_and(x == F.floor(x)) & (n * squares < 2.0**53)  # (sum of x)^2 is at most that
    return F.when(exact, F.sqrt((n * squares - total * total) / (n * n))).otherwise(F.stddev_pop(x))


_FLAGS = "ev AS (SELECT user_id, event_id, value, event_type IN ('click', 'view') AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), runs AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM ev WHERE f)"


def flagged(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("f", F.col("event_type").isin("click", "view"))


@query(f"WITH {_FLAGS}, g AS (SELECT user_id, min(pos) AS s, count(*) AS n FROM runs GROUP BY user_id, run), b AS (SELECT user_id, s, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1) SELECT u.user_id, coalesce(s, 0) AS start, coalesce(n, 0) AS length FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)")
def longest_run(spark, sf_dir):
    return S.longest_run(flagged(spark, sf_dir), ["user_id"], ["ts", "event_id"], "f")


@query(f"WITH {_FLAGS} SELECT user_id, count(*) FILTER (WHERE f AND NOT p) AS edges FROM (SELECT user_id, f, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY pos), false) AS p FROM ev) GROUP BY 1")
def rising_edges(spark, sf_dir):
    return S.rising_edges(flagged(spark, sf_dir), ["user_id"], ["ts", "event_id"], "f")


@query(f'WITH {_FLAGS} SELECT user_id, min(pos) AS start, max(pos) AS "end", max(value) AS peak FROM runs GROUP BY user_id, run HAVING count(*) >= 5 AND max(value) >= 20')
def islands_min_width(spark, sf_dir):
    return S.islands(flagged(spark, sf_dir), ["user_id"], ["ts", "event_id"], "f", "value", 5, 20)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_qualifying_event(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, o_orderstatus AS tier, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY floor(o_totalprice / 50000)), 6) AS share FROM orders GROUP BY floor(o_totalprice / 50000), o_orderstatus")
def level_band_share(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("band"), F.col("o_orderstatus").alias("tier")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("band")), 6))


@query("SELECT l_orderkey AS id, least(5, CAST(floor(l_quantity / 2 / (50.0 / 12)) AS INTEGER)) AS row, array_to_string(list(l_returnflag || l_linestatus ORDER BY l_extendedprice, l_linenumber), ' ') AS text FROM lineitem GROUP BY 1, 2")
def row_binning(spark, sf_dir):
    row = F.least(F.lit(5), F.floor(F.col("l_quantity") / 2 / (50.0 / 12)).cast("int"))
    x = F.struct("l_extendedprice", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("w"))
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), row.alias("row")).agg(F.array_sort(F.collect_list(x)).alias("x"))
    return g.select("id", "row", F.array_join(F.transform("x", lambda v: v["w"]), " ").alias("text"))


@query("""
WITH a AS (SELECT l_orderkey AS id, l_linenumber AS pos, min(CASE WHEN l_quantity > 25 THEN l_returnflag END) AS p, min(CASE WHEN l_discount > 0.03 THEN l_linestatus END) AS s FROM lineitem GROUP BY 1, 2),
n AS (SELECT id, count(p) AS np, count(s) AS ns FROM a GROUP BY 1)
SELECT id, pos, CASE WHEN np >= ns THEN coalesce(p, s) ELSE coalesce(s, p) END AS item FROM a JOIN n USING (id)""")
def two_pass_fill(spark, sf_dir):
    """The pass with more readings leads (the first on ties); the other fills its gaps by position."""
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos")).agg(F.min(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("p"), F.min(F.when(F.col("l_discount") > 0.03, F.col("l_linestatus"))).alias("s"))
    w = Window.partitionBy("id")
    a = a.withColumn("np", F.count("p").over(w)).withColumn("ns", F.count("s").over(w))
    return a.select("id", "pos", F.when(F.col("np") >= F.col("ns"), F.coalesce("p", "s")).otherwise(F.coalesce("s", "p")).alias("item"))


@query("SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS section, l_returnflag AS item, l_linestatus || ' (Tier: ' || (l_linenumber % 3 + 1) || ')' AS attachment FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag, l_linestatus, l_quantity) = 1")
def sections_roundtrip(spark, sf_dir):
    """Orders rendered as sectioned documents, then parsed back."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    docs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("all"))
    first = lambda x, i: (i == 0) | ~x["l_linenumber"].eqNullSafe(F.get("all", i - 1)["l_linenumber"])
    block = lambda x: F.array(F.lit("--------"), x["l_returnflag"], F.concat(x["l_linestatus"], F.lit(" (Tier: "), (x["l_linenumber"] % 3 + 1).cast("string"), F.lit(")")))
    docs = docs.select("id", F.filter("all", first).alias("bs"))
    text = docs.select("id", F.array_join(F.concat(F.array(F.lit("Sample Title")), F.flatten(F.transform("bs", block))), "\n").alias("text"), F.transform("bs", lambda x: x["l_linenumber"]).alias("ns"))
    parsed = text.select("id", "ns", F.split("text", "\n").alias("lines")).select("id", "ns", F.posexplode(S.blocks(F.col("lines"))).alias("section", "b"))
    rows = parsed.where("section between 1 and size(ns) and size(b.lines) > 0")
    return rows.select("id", F.get("ns", F.col("section") - 1).cast("int").alias("section"), F.get("b.lines", F.lit(0)).alias("item"), F.get("b.lines", F.lit(1)).alias("attachment"))


@query()
def multiset_compatibility(spark, sf_dir):
    """Attachment lists of neighbouring orders, matched greedily."""
    opt = F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_returnflag", F.lit(" or "), "l_linestatus")).otherwise(F.col("l_returnflag"))
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", opt.alias("o")))), lambda x: x["o"]).alias("x"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return a.join(b, "id").select("id", multiset_compatible("x", "y").alias("compatible"))
