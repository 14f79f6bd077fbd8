"""Dimensions: keys to names, fallbacks, pools, groups, collisions, validity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.lookup import cull, lookup, names_from_ids, with_fallback_key
from quarry.operators.sequences import aligned
from quarry.plans.catalog import query
from quarry.sources.tables import read


@query("""
SELECT l_orderkey AS id, list(trim(concat_ws(' ', p_name, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'I' WHEN p_size % 4 = 2 THEN 'II' ELSE 'III' END)) ORDER BY l_linenumber, l_partkey) AS names
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def fk_array_flatten(spark, sf_dir):
    tier = F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4)
    part = read(spark, sf_dir, "part").withColumn("shown", T.display_name(F.col("p_name"), tier))
    x = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))
    ids = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(x)), lambda v: v["k"]).alias("ids"))
    return names_from_ids(ids, "id", "ids", part, "p_partkey", "shown")


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE coalesce(n_name, 'Unknown') END AS nation
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = s_nationkey AND s_suppkey % 10 <> 0""")
def fk_default_unknown(spark, sf_dir):
    sup = read(spark, sf_dir, "supplier").withColumn("fk", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")))
    nation = read(spark, sf_dir, "nation").where("n_regionkey <> 2")
    out = sup.join(nation, F.col("fk") == F.col("n_nationkey"), "left")
    return out.select(F.col("s_suppkey").alias("id"), F.when(F.col("fk").isNull(), None).otherwise(F.coalesce("n_name", F.lit("Unknown"))).alias("nation"))


@query("""
WITH dim AS (SELECT p_brand || ' ' || p_type AS k, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1)
SELECT p_partkey AS id, coalesce(a.n, b.n) AS n FROM part LEFT JOIN dim a ON a.k = p_brand || ' ' || p_type LEFT JOIN dim b ON b.k = p_type""")
def fallback_key_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    full = T.join_qualifier(F.col("p_brand"), F.col("p_type"))
    dim = part.where("p_size > 48").groupBy(full.alias("k")).agg(F.count("*").alias("n")).union(part.groupBy("p_type").agg(F.count("*")))
    return with_fallback_key(part.select("p_partkey", "p_brand", "p_type"), dim, full, F.col("p_type"), "k", "n").select(F.col("p_partkey").alias("id"), "n")


_HOLES = "p_name = 'Do Nothing' OR starts_with(p_name, '[DNT]')"


@query(f"""
WITH part2 AS (SELECT p_brand, p_type, CASE WHEN p_size = 50 THEN 'Do Nothing' WHEN p_size = 49 THEN '[DNT] ' || p_name ELSE p_name END AS p_name, p_size, p_partkey FROM part),
per AS (SELECT p_brand AS brand, CASE p_size % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS bucket, p_name, p_partkey FROM part2 WHERE NOT ({_HOLES})),
quota AS (SELECT brand, coalesce(max(n) FILTER (WHERE bucket = 'first'), 0) + coalesce(max(n) FILTER (WHERE bucket = 'second'), 0) + coalesce(max(n) FILTER (WHERE bucket = 'third'), 0) AS quota
  FROM (SELECT brand, bucket, count(DISTINCT p_name) AS n FROM per GROUP BY 1, 2) GROUP BY 1)
SELECT brand, list(p_name ORDER BY bucket, p_partkey) AS pool, any_value(quota) AS quota FROM per JOIN quota USING (brand) GROUP BY brand""")
def pool_union(spark, sf_dir):
    """The three lists of a category as one, in order and without placeholders; its quota is the sum of theirs."""
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") == 50, "Do Nothing").when(F.col("p_size") == 49, F.concat(F.lit("[DNT] "), "p_name")).otherwise(F.col("p_name"))
    bucket = F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third")), F.col("p_size") % 3 + 1)
    rows = part.select(F.col("p_brand").alias("brand"), bucket.alias("bucket"), name.alias("name"), "p_partkey").where(~T.is_placeholder(F.col("name")))
    lists = rows.groupBy("brand").pivot("bucket", ["first", "second", "third"]).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "name"))).alias("l"), F.countDistinct("name").alias("n"))
    none = F.array().cast("array<struct<p_partkey:bigint,name:string>>")
    pool = F.transform(F.concat(*[F.coalesce(f"{k}_l", none) for k in ("first", "second", "third")]), lambda x: x["name"])
    return lists.select("brand", pool.alias("pool"), sum((F.coalesce(f"{k}_n", F.lit(0)) for k in ("first", "second", "third")), F.lit(0)).cast("long").alias("quota"))


def pool_sql() -> str:
    return "pools AS (SELECT p_brand AS category, list_sort(list(DISTINCT p_name)) AS pool FROM part WHERE p_size <= 25 GROUP BY 1)"


def pool_of(spark, sf_dir):
    """(category, pool): the items that each category is known to have."""
    return read(spark, sf_dir, "part").where("p_size <= 25").groupBy(F.col("p_brand").alias("category")).agg(F.array_sort(F.collect_set("p_name")).alias("pool"))


@query("""
WITH sig AS (SELECT p_type AS category, list_sort(list(DISTINCT p_brand)) AS expected FROM part WHERE p_size = 1 GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN len(expected) = 1 THEN expected[1] WHEN expected IS NULL THEN 'none' ELSE 'Unknown' END AS signature
FROM part LEFT JOIN sig ON category = p_type""")
def signature_explode(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    sig = part.where("p_size = 1").groupBy(F.col("p_type").alias("category")).agg(F.array_sort(F.collect_set("p_brand")).alias("expected"))
    out = part.join(sig, F.col("category") == F.col("p_type"), "left")
    return out.select(F.col("p_partkey").alias("id"), F.when(F.size("expected") == 1, F.get("expected", F.lit(0))).when(F.col("expected").isNull(), "none").otherwise("Unknown").alias("signature"))


_GROUPS = "grp AS (SELECT p_brand || '_' || p_size AS k, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY 1)"


def groups(spark, sf_dir):
    """(k, names): names that share an observed key."""
    return read(spark, sf_dir, "part").groupBy(T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")).alias("k")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@query(f"WITH {_GROUPS} SELECT k, names, len(names) AS n FROM grp WHERE len(names) > 1")
def observed_key_groups(spark, sf_dir):
    return groups(spark, sf_dir).select("k", "names", F.size("names").cast("long").alias("n")).where("n > 1")


@query(f"""
WITH {_GROUPS}, held AS (SELECT DISTINCT l_orderkey AS id, p_brand || '_' || p_size AS k, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT id, k, count(*) AS n, list_sort(list(p_name))[1:3] AS shown FROM held GROUP BY id, k HAVING count(*) > 1""")
def same_container_collisions(spark, sf_dir):
    key = T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")).alias("k")
    held = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    held = held.select(F.col("l_orderkey").alias("id"), key, "p_name").distinct()
    return held.groupBy("id", "k").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("p_name")), 1, 3).alias("shown")).where("n > 1")


@query("""
SELECT p_brand AS icon, count(DISTINCT p_type) AS identities, min(p_name) AS shown FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def multi_identity_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("icon")).agg(F.countDistinct("p_type").alias("identities"), F.min("p_name").alias("shown")).where("identities > 1")


_ALLOWED = "allowed AS (SELECT p_type AS item, list(DISTINCT p_name) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND p_size % 3 = 0 GROUP BY 1)"


def allowed_sets(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_size % 3 = 0")
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("item")).agg(F.collect_set("p_name").alias("names"))


@query(f"""
WITH {_GROUPS}, {_ALLOWED}
SELECT p_partkey AS id, CASE WHEN len(grp.names) > 1 AND allowed.names IS NOT NULL AND len(list_intersect(grp.names, allowed.names)) > 0
  THEN list_sort(list_intersect(grp.names, allowed.names)) ELSE grp.names END AS names
FROM part JOIN grp ON k = p_brand || '_' || p_size LEFT JOIN allowed ON item = p_type""")
def cull_with_fallback(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("k", T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")))
    out = part.join(groups(spark, sf_dir), "k").join(allowed_sets(spark, sf_dir).withColumnRenamed("names", "ok"), F.col("item") == F.col("p_type"), "left")
    return out.select(F.col("p_partkey").alias("id"), F.array_sort(cull(F.col("names"), F.col("ok"))).alias("names"))


@query(f"""
WITH {_ALLOWED}
SELECT l_orderkey AS id, l_linenumber AS pos, p_type AS item, p_name AS text
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN allowed ON item = p_type WHERE NOT list_contains(names, p_name)""")
def disallowed_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("opts", T.options(F.col("p_name")))
    bad = rows.join(allowed_sets(spark, sf_dir), F.col("item") == F.col("p_type")).where(~F.arrays_overlap("opts", "names"))
    return bad.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), "item", F.col("p_name").alias("text"))


@query(f"""
WITH {_GROUPS}, slot AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS part, k, names, count(*) OVER (PARTITION BY l_orderkey, k) AS n, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber, l_partkey) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN grp ON k = p_brand || '_' || p_size)
SELECT id, pos, part, CASE WHEN len(names) > 1 AND n = len(names) THEN names[rn] ELSE array_to_string(names, ' or ') END AS name FROM slot""")
def same_item_collision_assign(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")).alias("k"))
    slot = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("p_partkey") == F.col("l_partkey")).where("k is not null")
    w = Window.partitionBy("l_orderkey", "k").orderBy("l_linenumber", "l_partkey")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slot = slot.withColumn("n", F.count("*").over(every)).withColumn("rn", F.row_number().over(w))
    # names come after the window, so that no sort has to hold them
    slot = slot.join(groups(spark, sf_dir).withColumn("all", F.array_join("names", " or ")), "k")
    name = F.when((F.size("names") > 1) & (F.col("n") == F.size("names")), F.try_element_at("names", F.col("rn"))).otherwise(F.col("all"))
    return slot.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), name.alias("name"))


@query("""
SELECT l_orderkey AS id, count(*) AS n, count(*) - count(DISTINCT p_type) AS repeats FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY 1 HAVING count(*) > count(DISTINCT p_type) OR count(DISTINCT p_type) NOT BETWEEN 1 AND 4""")
def family_budget_violations(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("d"))
    return g.where("n > d or d not between 1 and 4").select("id", "n", (F.col("n") - F.col("d")).alias("repeats"))


@query("""
WITH a AS (SELECT l_orderkey AS id, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_quantity > 10), []) AS pos, count(*) FILTER (WHERE l_quantity > 10) AS n FROM lineitem GROUP BY 1)
SELECT id, n, pos = range(1, n::BIGINT + 1) AS aligned FROM (SELECT id, n, list_transform(pos, lambda x: x::BIGINT) AS pos FROM a)""")
def positional_pairing(spark, sf_dir):
    """Whether the occupied columns of a record are the first ones; a record without any is aligned."""
    used = F.when(F.col("l_quantity") > 10, F.col("l_linenumber"))
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(used)).alias("pos"), F.count(used).alias("n"))
    want = F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")))
    return a.select("id", "n", (F.col("pos") == want).alias("aligned"))


@query("""
WITH a AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, p_type) - 1 AS pos, p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 15),
b AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) - 1 AS pos, l_returnflag || l_linestatus AS att FROM lineitem WHERE l_discount > 0.02),
both_ AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.pos, b.pos) AS pos, item, att FROM a FULL JOIN b ON a.id = b.id AND a.pos = b.pos),
per AS (SELECT id, count(item) AS items, count(att) AS atts FROM both_ GROUP BY 1)
SELECT o_orderkey AS id, pos, item, att, CASE WHEN coalesce(items, 0) = 0 AND coalesce(atts, 0) = 0 THEN 'nothing' WHEN items = atts THEN 'aligned' WHEN items > atts THEN 'missing' ELSE 'surplus' END AS verdict
FROM orders LEFT JOIN per ON per.id = o_orderkey LEFT JOIN both_ ON both_.id = o_orderkey""")
def aligned_columns(spark, sf_dir):
    """Two row-aligned arrays of every record paired by position: what one has beyond the other stays, with a null beside it, and
    the record is told to have missing or surplus columns; records with nothing have one row."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    order = lambda x: F.struct("l_linenumber", "l_partkey", x.alias("v"))
    items, atts = F.when(F.col("l_quantity") > 15, order(F.col("p_type"))), F.when(F.col("l_discount") > 0.02, order(F.concat("l_returnflag", "l_linestatus")))
    plain = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda r: r["v"])
    per = lines.groupBy(F.col("l_orderkey").alias("id")).agg(plain(items).alias("items"), plain(atts).alias("atts"))
    every = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(per, "id", "left")
    return aligned(every, "id", "items", "atts").select("id", "pos", F.col("left").alias("item"), F.col("right").alias("att"), "verdict")


@query("""
WITH pool AS (SELECT p_brand AS b, p_type AS t, min(length(p_name)) FILTER (WHERE p_size <= 10) AS least, count(*) FILTER (WHERE p_size <= 10) AS matched, any_value(length(p_type)) % 3 + 2 AS quota,
  list(DISTINCT lower(p_name)) FILTER (WHERE p_size <= 10) AS kept FROM part GROUP BY 1, 2),
judged AS (SELECT p_partkey AS id, p_size <= 10 AS recognised, length(p_name) >= coalesce(least, 0) AND regexp_full_match(p_name, '[A-Za-z'' :]+') AS plausible, matched >= quota AS quota_full,
  p_size > 10 AND len(list_filter(coalesce(kept, []), lambda x: contains(x, lower(p_name)))) = 0 AS dropped FROM part JOIN pool ON b = p_brand AND t = p_type)
SELECT id, recognised, plausible, quota_full, dropped, recognised OR (plausible AND NOT quota_full) AS kept FROM judged""")
def quota_and_shape_filter(spark, sf_dir):
    """Every reading of a container: leftovers stay only if their shape allows a name and the container's quota is not
    full; what is not recognised, nor part of a name that is, is told as dropped. A leftover shorter than the shortest name
    that the container's pool has cannot be one."""
    part = read(spark, sf_dir, "part").withColumn("recognised", F.col("p_size") <= 10)
    names = F.coalesce(F.collect_set(F.when(F.col("recognised"), F.lower("p_name"))), F.array().cast("array<string>"))
    pool = part.groupBy("p_brand", "p_type").agg(F.coalesce(F.min(F.when(F.col("recognised"), F.length("p_name"))), F.lit(0)).alias("least"), F.count_if("recognised").alias("matched"), names.alias("kept_names"))
    out = part.join(pool, ["p_brand", "p_type"])
    plausible = (F.length("p_name") >= F.col("least")) & F.col("p_name").rlike("^[A-Za-z' :]+$")
    full = F.col("matched") >= F.length("p_type") % 3 + 2
    dropped = ~F.col("recognised") & ~F.exists("kept_names", lambda x: F.contains(x, F.lower("p_name")))
    return out.select(F.col("p_partkey").alias("id"), "recognised", plausible.alias("plausible"), full.alias("quota_full"), dropped.alias("dropped"), (F.col("recognised") | (plausible & ~full)).alias("kept"))


@query("""
SELECT p_partkey AS id, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS bare,
  array_to_string(list_transform(string_split(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_'), '_'), lambda w: CASE WHEN w = 'of' THEN w ELSE upper(w[1:1]) || w[2:] END), ' ') AS title
FROM part""")
def slug_and_title(spark, sf_dir):
    slug = T.slugify(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug.alias("slug"), T.normalize_name(F.col("p_name")).alias("bare"), T.deslugify(slug).alias("title"))


@query("""
SELECT p_partkey AS id, CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER) AS first_number, regexp_extract(p_name || '_' || p_size, '^(.*)_([^_]+)$', 1) AS icon,
  p_name || ' (Tier: ' || (p_size % 3 + 1) || ')' AS shown, CAST(p_size % 3 + 1 AS INTEGER) AS tier FROM part""")
def regex_fields(spark, sf_dir):
    shown = F.concat(F.col("p_name"), F.lit(" (Tier: "), (F.col("p_size") % 3 + 1).cast("string"), F.lit(")"))
    name, tier = T.parse_display(shown)
    icon, _ = T.split_key(T.observed_key(name, F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.first_int(F.col("p_brand")).alias("first_number"), icon.alias("icon"), shown.alias("shown"), tier.alias("tier"))


@query("""
WITH pool AS (SELECT DISTINCT p_name AS item FROM part), q AS (SELECT DISTINCT p_name[1:(1 + p_partkey % 12)::INTEGER] AS query FROM part),
ex AS (SELECT query, max(item) AS item FROM q JOIN pool ON lower(item) = lower(query) GROUP BY 1),
least AS (SELECT min(length(item)) AS n FROM pool),
pre AS (SELECT query, count(*) AS n, max(item) AS item FROM q JOIN pool ON starts_with(lower(item), lower(query)) WHERE length(query) >= (SELECT n FROM least) AND query NOT IN (SELECT query FROM ex) GROUP BY 1)
SELECT query, coalesce(ex.item, CASE WHEN pre.n = 1 THEN pre.item END) AS value, CASE WHEN ex.item IS NOT NULL THEN 'exact' WHEN pre.n = 1 THEN 'prefix' ELSE 'none' END AS status
FROM q LEFT JOIN ex USING (query) LEFT JOIN pre USING (query)""")
def lookup_exact_prefix(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    q = part.select(F.substr("p_name", F.lit(1), (F.col("p_partkey") % 12 + 1).cast("int")).alias("query"))
    return lookup(q, part.select(F.col("p_name").alias("item")), cutoff=2.0).select("query", "value", "status")


@query()
def lookup_fuzzy(spark, sf_dir):
    """Names with a letter lost or doubled, against the closed pool of names."""
    part = read(spark, sf_dir, "part")
    cut = (F.col("p_partkey") % 7 + 2).cast("int")
    q = part.select(F.concat(F.substr("p_name", F.lit(1), cut), F.substr("p_name", cut + 2)).alias("query"))
    return lookup(q, part.select(F.col("p_name").alias("item")))


@query("""
SELECT event_id AS id, coalesce(CASE WHEN v <= 100 THEN v END, w) AS level FROM (
  SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS v, CAST(floor(value) AS INTEGER) AS w FROM events)""")
def plausible_value(spark, sf_dir):
    v, w = F.get_json_object("props", "$.k").cast("int"), F.floor("value").cast("int")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(F.when(v <= 100, v), w).alias("level"))


@query("""
WITH b AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 50 AS t FROM part), leaf AS (
  SELECT id, 'name' AS region, s AS x0, t AS y0, s + 60 AS x1, t + 20 AS y1 FROM b UNION ALL SELECT id, 'level', s + 5, 5, s + 35, 25 FROM b UNION ALL
  SELECT id, 'quadrant.ne', s + 50, 0, s + 60, 10 FROM b UNION ALL SELECT id, 'quadrant.sw', 0, s + 50, 10, s + 60 FROM b),
cell AS (SELECT id, 'cell.' || r || '.' || c AS region, 14 * c AS x0, 10 * r AS y0, 14 * c + 12 AS x1, 10 * r + 8 AS y1 FROM b, range(3) AS rr(r), range(2) AS cc(c))
SELECT id, region, (x0 + 2)::INTEGER AS x0, (y0 + 2)::INTEGER AS y0, (x1 - 2)::INTEGER AS x1, (y1 - 2)::INTEGER AS y1 FROM leaf UNION ALL SELECT id, region, x0::INTEGER, y0::INTEGER, x1::INTEGER, y1::INTEGER FROM cell""")
def region_geometry(spark, sf_dir):
    """The crop plan of every configuration: named boxes and quadrants, inset, and the grid's cells from the grid's own corner."""
    return crop_plan(region_configs(spark, sf_dir), "id", "config")


_BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
_CONFIG = f"struct<regions:map<string,struct<absolute:{_BOX},note:string>>,quadrants:map<string,struct<absolute:{_BOX}>>,grid:struct<columns:array<struct<x0:int,x1:int>>,rows:array<struct<y0:int,y1:int>>>>"


def region_configs(spark, sf_dir):
    """(id, config): a JSON document of regions for each part."""
    s, t = F.col("p_size"), (F.col("p_partkey") % 50).cast("int")
    box = lambda *v: F.struct(*[(x if isinstance(x, type(s)) else F.lit(x)).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    named = lambda b: F.struct(b.alias("absolute"), F.lit("by hand").alias("note"))
    regions = F.create_map(F.lit("name"), named(box(s, t, s + 60, t + 20)), F.lit("level"), named(box(s + 5, 5, s + 35, 25)))
    quadrants = F.create_map(F.lit("ne"), F.struct(box(s + 50, 0, s + 60, 10).alias("absolute")), F.lit("sw"), F.struct(box(0, s + 50, 10, s + 60).alias("absolute")))
    columns = F.array(*[F.struct((s + 14 * c).alias("x0"), (s + 14 * c + 12).alias("x1")) for c in range(2)])
    rows = F.array(*[F.struct((t + 10 * r).alias("y0"), (t + 10 * r + 8).alias("y1")) for r in range(3)])
    config = F.struct(regions.alias("regions"), quadrants.alias("quadrants"), F.struct(columns.alias("columns"), rows.alias("rows")).alias("grid"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.to_json(config).alias("config"))


def crop_plan(configs, key: str, config: str, inset: int = 2):
    """(key, region, x0, y0, x1, y1): the leaves of nested regions less an inset; grid cells, `cell.row.column`, by the offsets
    from the grid's first column and row. A document that does not parse has no leaves."""
    parsed = configs.select(key, F.from_json(config, _CONFIG).alias("c"))
    leaves = lambda field, name: parsed.select(key, F.explode(field).alias("k", "v")).select(key, name.alias("region"), "v.absolute.*")
    boxes = leaves("c.regions", F.col("k")).union(leaves("c.quadrants", F.concat(F.lit("quadrant."), "k")))
    boxes = boxes.select(key, "region", *[(F.col(v) + d).alias(v) for v, d in (("x0", inset), ("y0", inset), ("x1", -inset), ("y1", -inset))])
    rows = parsed.select(key, F.col("c.grid").alias("g"), F.posexplode("c.grid.rows").alias("r", "row"))
    cells = rows.select(key, "r", "row", F.col("g.columns")[0]["x0"].alias("ox"), F.col("g.rows")[0]["y0"].alias("oy"), F.posexplode("g.columns").alias("c", "col"))
    region = F.concat(F.lit("cell."), F.col("r").cast("string"), F.lit("."), F.col("c").cast("string"))
    return boxes.union(cells.select(key, region.alias("region"), F.col("col.x0") - F.col("ox"), F.col("row.y0") - F.col("oy"), F.col("col.x1") - F.col("ox"), F.col("row.y1") - F.col("oy")))
