"""Names, families and observed keys of a dimension, and which outside labels are believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.catalog import query
from quarry.plans.dimensions import pool_of, pool_sql
from quarry.plans.lineage import clusters
from quarry.sources.tables import read

#: The count of attachments that each tier of an item allows.
COUNT_RANGES = {"None": (0, 0), "Low": (1, 2), "Medium": (2, 3), "High": (3, 5)}
DECORATED = ("Lesser ", "Greater ", "Gilded ")

_NAME = "CASE p_size % 4 WHEN 0 THEN 'Lesser ' WHEN 1 THEN '' WHEN 2 THEN 'Greater ' ELSE 'Gilded ' END || p_name"
_DIM = f"""dim AS (SELECT name, max(x).icon AS icon, max(x).family AS family, max(x).tier AS tier FROM (SELECT {_NAME} AS name,
  struct_pack(k := p_partkey, icon := p_brand, family := CASE WHEN p_partkey % 3 = 0 THEN p_type END, tier := p_size % 3 + 1) AS x FROM part) GROUP BY name),
bared AS (SELECT *, regexp_replace(name, '^(Lesser|Greater) ', '') AS bare FROM dim),
ident AS (SELECT *, CASE WHEN family IS NOT NULL THEN family WHEN count(*) FILTER (WHERE family IS NULL) OVER (PARTITION BY icon, bare) > 1 THEN '[' || bare || ']' ELSE name END AS identity FROM bared)"""


def dimension(spark, sf_dir: str) -> DataFrame:
    """(name, icon, family, tier): of the rows of a name the last one counts; family may be null."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("Lesser ", "", "Greater ", "Gilded ")]), F.col("p_size") % 4 + 1)
    row = F.struct(F.col("p_partkey").alias("k"), F.col("p_brand").alias("icon"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("family"), (F.col("p_size") % 3 + 1).alias("tier"))
    return read(spark, sf_dir, "part").groupBy(F.concat(prefix, "p_name").alias("name")).agg(F.max(row).alias("x")).select("name", "x.icon", "x.family", "x.tier")


def with_identity(dim: DataFrame) -> DataFrame:
    """The dimension with each name's identity: its family; else its bare name in brackets, if others of its icon without a
    family share it; else itself."""
    out = dim.withColumn("bare", T.bare_name(F.col("name")))
    alike = F.count(F.when(F.col("family").isNull(), 1)).over(Window.partitionBy("icon", "bare"))
    return out.withColumn("identity", F.coalesce("family", F.when(alike > 1, F.concat(F.lit("["), "bare", F.lit("]"))), "name"))


def shown_name(identity: Column, members: Column) -> Column:
    """The first member without a decoration, else the identity itself."""
    plain = F.filter(members, lambda m: ~(F.startswith(m, F.lit(DECORATED[0])) | F.startswith(m, F.lit(DECORATED[1])) | F.startswith(m, F.lit(DECORATED[2]))))
    return F.coalesce(F.get(plain, F.lit(0)), identity)


@query(f"""
WITH {_DIM}, grp AS (SELECT identity, list_sort(list(name)) AS members FROM ident GROUP BY 1)
SELECT identity, members, coalesce(list_filter(members, lambda m: NOT (starts_with(m, 'Lesser ') OR starts_with(m, 'Greater ') OR starts_with(m, 'Gilded ')))[1], identity) AS shown FROM grp""")
def identity_members(spark, sf_dir):
    grp = with_identity(dimension(spark, sf_dir)).groupBy("identity").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return grp.select("identity", "members", shown_name(F.col("identity"), F.col("members")).alias("shown"))


@query(f"""
WITH {_DIM}, slot AS (SELECT DISTINCT p_type AS item, {_NAME} AS name, CASE WHEN p_size % 5 > 0 THEN p_size % 3 + 1 END AS tier FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT DISTINCT p_type, 'Never heard of', 1 FROM part)
SELECT DISTINCT item, icon, slot.tier, identity FROM slot JOIN ident USING (name)""")
def icon_tier_identities(spark, sf_dir):
    """(item, icon, tier, identity): what an item can show by an icon at a tier; names that are not in the dimension are skipped."""
    part = read(spark, sf_dir, "part").withColumn("tier", F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 3 + 1))
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("Lesser ", "", "Greater ", "Gilded ")]), F.col("p_size") % 4 + 1)
    held = read(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("item"), F.concat(prefix, "p_name").alias("name"), "tier").distinct()
    odd = part.select(F.col("p_type").alias("item"), F.lit("Never heard of").alias("name"), F.lit(1).alias("tier")).distinct()
    dim = with_identity(dimension(spark, sf_dir)).select("name", "icon", "identity")
    return held.union(odd).join(dim, "name").select("item", "icon", "tier", "identity").distinct()


_CLU = "clu AS (SELECT md5(text) AS hash, min(doc_id) AS id, count(*) AS n, list_sort(list(DISTINCT source)) AS icons FROM documents GROUP BY 1)"


@query(f"""
WITH {_CLU}, names AS (SELECT source AS name, min(lang) AS tier FROM documents GROUP BY 1),
keys AS (SELECT hash AS key, icons[1] AS name FROM clu WHERE id % 2 = 0 UNION ALL SELECT hash[1:10], CASE WHEN id % 5 = 0 THEN 'nobody' ELSE icons[1] END FROM clu WHERE id % 3 = 0 UNION ALL
  SELECT hash[1:10], (SELECT max(name) FROM names) FROM clu WHERE id % 7 = 0),
hit AS (SELECT hash, list_sort(list(DISTINCT name)) AS names FROM clu JOIN keys ON key = hash OR key = hash[1:10] GROUP BY 1),
note AS (SELECT hash, CASE WHEN id % 11 = 0 THEN 'xx' WHEN id % 4 = 0 THEN NULL ELSE (SELECT min(tier) FROM names) END AS tier FROM clu)
SELECT clu.hash, CASE WHEN hit.names IS NULL THEN 'no key' WHEN len(hit.names) > 1 THEN 'keys disagree' WHEN d.name IS NULL THEN 'unknown name' WHEN NOT list_contains(icons, d.name) THEN 'impossible icon'
  WHEN note.tier <> d.tier THEN 'other tier' ELSE 'accepted' END AS outcome, CASE WHEN len(hit.names) = 1 AND d.name IS NOT NULL AND list_contains(icons, d.name) AND NOT coalesce(note.tier <> d.tier, false) THEN d.name END AS label
FROM clu LEFT JOIN hit USING (hash) LEFT JOIN note USING (hash) LEFT JOIN names d ON len(hit.names) = 1 AND d.name = hit.names[1]""")
def override_acceptance(spark, sf_dir):
    """A name given by hand, by a hash or its beginning, is taken only if its keys agree, it is in the dimension, one of the
    cluster's icons can show it, and a note of its tier does not say otherwise; else the reason is told."""
    docs = read(spark, sf_dir, "documents")
    clu = clusters(spark, sf_dir).select("hash", F.col("first_id").alias("id"), F.col("sources").alias("icons"))
    names = docs.groupBy(F.col("source").alias("name")).agg(F.min("lang").alias("tier"))
    ends = F.broadcast(names.agg(F.max("name").alias("last"), F.min("tier").alias("usual")))  # one row
    own, short = F.get("icons", F.lit(0)), F.substring("hash", 1, 10)
    keys = clu.where("id % 2 = 0").select(F.col("hash").alias("key"), own.alias("given"))
    keys = keys.union(clu.where("id % 3 = 0").select(short, F.when(F.col("id") % 5 == 0, "nobody").otherwise(own))).union(clu.where("id % 7 = 0").join(ends).select(short, "last"))
    both = clu.select("hash", F.explode(F.array(F.col("hash"), short)).alias("key"))
    hit = both.join(keys, "key").groupBy("hash").agg(F.array_sort(F.collect_set("given")).alias("names"))
    note = F.when(F.col("id") % 11 == 0, "xx").when(F.col("id") % 4 != 0, F.col("usual"))
    out = clu.join(ends).join(hit, "hash", "left").withColumn("one", F.when(F.size("names") == 1, F.get("names", F.lit(0)))).join(names, F.col("one") == F.col("name"), "left")
    why = F.when(F.col("names").isNull(), "no key").when(F.size("names") > 1, "keys disagree").when(F.col("name").isNull(), "unknown name")
    why = why.when(~F.array_contains("icons", F.col("name")), "impossible icon").when(note != F.col("tier"), "other tier").otherwise("accepted")
    return out.select("hash", why.alias("outcome"), F.when(why == "accepted", F.col("name")).alias("label"))


@query(f"""
WITH {_CLU}, live AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE doc_id % 6 = 0), names AS (SELECT DISTINCT source AS name FROM documents WHERE lang <> 'de'),
promo AS (SELECT hash, id, n, icons[1] AS name, CASE WHEN id % 5 > 0 THEN CASE WHEN id % 7 = 0 THEN md5(hash) ELSE hash END END AS file FROM clu)
SELECT hash, CASE WHEN live.hash IS NOT NULL THEN 'seen live' WHEN file IS NULL THEN 'file missing' WHEN names.name IS NULL THEN 'unknown name' WHEN file <> promo.hash THEN 'other content' ELSE 'taken' END AS outcome
FROM promo LEFT JOIN live USING (hash) LEFT JOIN names USING (name)""")
def promotion_guard(spark, sf_dir):
    """A promoted label comes in only if its hash is not seen live, its file is there, its name known and its content's hash the same."""
    docs = read(spark, sf_dir, "documents")
    promo = clusters(spark, sf_dir).select("hash", F.col("first_id").alias("id"), F.get("sources", F.lit(0)).alias("name"))
    promo = promo.withColumn("file", F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 7 == 0, F.md5("hash")).otherwise(F.col("hash"))))
    live = docs.where("doc_id % 6 = 0").select(F.md5("text").alias("hash")).distinct().withColumn("live", F.lit(True))
    names = docs.where("lang <> 'de'").select(F.col("source").alias("name")).distinct().withColumn("known", F.lit(True))
    out = promo.join(live, "hash", "left").join(names, "name", "left")
    why = F.when(F.col("live"), "seen live").when(F.col("file").isNull(), "file missing").when(F.col("known").isNull(), "unknown name").when(F.col("file") != F.col("hash"), "other content")
    return out.select("hash", why.otherwise("taken").alias("outcome"))


@query(f"""
WITH {_CLU}, truth AS (SELECT hash, id, icons[1] AS name FROM clu WHERE id % 2 = 0), arg AS (SELECT DISTINCT hash[1:(2 + id % 9)::INTEGER] AS arg FROM clu),
hits AS (SELECT arg, count(hash) AS n, min(hash) AS hash FROM arg LEFT JOIN truth ON starts_with(hash, arg) GROUP BY 1), names AS (SELECT DISTINCT source AS name FROM documents WHERE lang <> 'de')
SELECT arg, CASE WHEN n = 0 THEN 'no entry' WHEN n > 1 THEN 'ambiguous' WHEN names.name IS NULL THEN 'unknown name' WHEN id % 5 = 0 THEN 'file missing' WHEN id % 3 = 0 THEN 'promoted anew' ELSE 'promoted' END AS outcome
FROM hits LEFT JOIN truth ON n = 1 AND truth.hash = hits.hash LEFT JOIN names USING (name)""")
def promotion_eligibility(spark, sf_dir):
    """Arguments that name a label to promote by the beginning of its hash, with what becomes of each."""
    docs = read(spark, sf_dir, "documents")
    clu = clusters(spark, sf_dir).select("hash", F.col("first_id").alias("id"), F.get("sources", F.lit(0)).alias("name"))
    arg = clu.select(F.substr("hash", F.lit(1), (F.col("id") % 9 + 2).cast("int")).alias("arg")).distinct()
    truth = clu.where("id % 2 = 0")
    begins = truth.select("*", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k")).withColumn("arg", F.substr("hash", F.lit(1), F.col("k")))
    hits = arg.join(begins, "arg", "left").groupBy("arg").agg(F.count("hash").alias("n"), F.min(F.struct("hash", "id", "name")).alias("x")).select("arg", "n", "x.id", "x.name")
    names = docs.where("lang <> 'de'").select(F.col("source").alias("name")).distinct().withColumn("known", F.lit(True))
    why = F.when(F.col("n") == 0, "no entry").when(F.col("n") > 1, "ambiguous").when(F.col("known").isNull(), "unknown name").when(F.col("id") % 5 == 0, "file missing").when(F.col("id") % 3 == 0, "promoted anew")
    return hits.join(names, "name", "left").select("arg", why.otherwise("promoted").alias("outcome"))


@query(f"""
WITH {_CLU}, mine AS (SELECT hash, icons[1] || '/' || id % 9 AS name FROM clu), theirs AS (SELECT hash, icons[1] || '/' || id % 9 AS name FROM clu WHERE id % 18 < 6)
SELECT mine.hash, CASE WHEN theirs.hash IS NOT NULL THEN 'exact' WHEN EXISTS (SELECT 1 FROM theirs t WHERE t.name = mine.name) THEN 'same name' ELSE 'none' END AS strength FROM mine LEFT JOIN theirs USING (hash)""")
def audit_strength(spark, sf_dir):
    """How strongly another source backs a label: by the same content, by the same name on other content, or not."""
    name = F.concat_ws("/", F.get("sources", F.lit(0)), (F.col("first_id") % 9).cast("string"))
    clu = clusters(spark, sf_dir).select("hash", F.col("first_id").alias("id"), name.alias("name"))
    theirs = clu.where("id % 18 < 6")
    exact = theirs.select("hash", F.lit(True).alias("same"))
    named = theirs.select("name").distinct().withColumn("backed", F.lit(True))
    out = clu.join(exact, "hash", "left").join(named, "name", "left")
    return out.select("hash", F.when(F.col("same"), "exact").when(F.col("backed"), "same name").otherwise("none").alias("strength"))


@query(f"""
WITH {pool_sql()}, every AS (SELECT list_sort(list(DISTINCT x)) AS pool FROM (SELECT unnest(pool) AS x FROM pools)),
slot AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS k, CASE WHEN l_tax > 0.07 THEN 'nothing known' ELSE p_brand END AS category, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT id, pos, k, item, pools.category IS NULL AS fell_back, list_contains(coalesce(pools.pool, every.pool), item) AS known FROM slot LEFT JOIN pools USING (category) CROSS JOIN every""")
def pool_fallback(spark, sf_dir):
    """Items against the pool of their category, or against all pools where the category is not known."""
    pools = pool_of(spark, sf_dir)
    flat = pools.select("category", F.explode("pool").alias("item"))
    part = read(spark, sf_dir, "part")
    slot = read(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    slot = slot.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"), F.when(F.col("l_tax") > 0.07, "nothing known").otherwise(F.col("p_brand")).alias("category"), F.col("p_name").alias("item"))
    has = pools.select("category", F.lit(True).alias("has"))
    own, any_ = flat.distinct().withColumn("mine", F.lit(True)), flat.select("item").distinct().withColumn("some", F.lit(True))
    out = slot.join(has, "category", "left").join(own, ["category", "item"], "left").join(any_, "item", "left")
    fell = F.col("has").isNull()
    return out.select("id", "pos", "k", "item", fell.alias("fell_back"), F.when(fell, F.col("some").isNotNull()).otherwise(F.col("mine").isNotNull()).alias("known"))


@query("""
WITH r AS (SELECT * FROM (VALUES ('None', 0, 0), ('Low', 1, 2), ('Medium', 2, 3), ('High', 3, 5)) AS r(tier, lo, hi)),
n AS (SELECT l_orderkey AS id, count(DISTINCT p_type) AS n, CASE l_orderkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Other' END AS tier FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, n, tier, lo, hi, CASE WHEN lo IS NULL THEN 'unknown tier' WHEN n BETWEEN lo AND hi THEN 'fits' ELSE 'out of range' END AS status FROM n LEFT JOIN r USING (tier)""")
def attachment_budget(spark, sf_dir):
    """Counts of families against the range that the item's count tier allows."""
    per = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("p_type").alias("n"))
    tiers = F.array(*[F.lit(x) for x in (*COUNT_RANGES, "Other")])
    per = per.withColumn("tier", F.element_at(tiers, (F.col("id") % 5 + 1).cast("int")))
    bound = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, r in COUNT_RANGES.items() for x in (t, r[k])]), F.col("tier"))
    out = per.select("id", "n", "tier", bound(0).alias("lo"), bound(1).alias("hi"))
    return out.withColumn("status", F.when(F.col("lo").isNull(), "unknown tier").when(F.col("n").between(F.col("lo"), F.col("hi")), "fits").otherwise("out of range"))


@query("""
WITH miss AS (SELECT p_brand || '_' || p_size AS k FROM part GROUP BY 1), seen AS (SELECT DISTINCT p_brand || '_' || p_size AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linenumber = 7)
SELECT k FROM miss WHERE k NOT IN (SELECT k FROM seen)""")
def unreached_keys(spark, sf_dir):
    """Keys of the dimension that no record of one kind reaches."""
    part = read(spark, sf_dir, "part").withColumn("k", T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")))
    seen = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 7").join(part, F.col("p_partkey") == F.col("l_partkey")).select("k")
    return part.select("k").distinct().join(seen, "k", "left_anti")


@query("""
SELECT vec_id, label, CASE WHEN label % 3 = 0 THEN 'unlabeled_' || vec_id ELSE 'key' || label END || '.png' AS file, label % 3 <> 0 AS used FROM embeddings""")
def reference_files(spark, sf_dir):
    """Which files of a folder are references: those that are named, not those still unlabelled."""
    e = read(spark, sf_dir, "embeddings")
    file = F.concat(F.when(F.col("label") % 3 == 0, F.concat(F.lit("unlabeled_"), "vec_id")).otherwise(F.concat(F.lit("key"), "label")), F.lit(".png"))
    return e.select("vec_id", "label", file.alias("file"), (~F.startswith(T.stem(file), F.lit("unlabeled_"))).alias("used"))


@query("""
SELECT label AS visual_key, count(*) AS occurrences, sum(vec_id % 5 + 1)::BIGINT AS total FROM embeddings GROUP BY 1""")
def occurrence_rollup(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("visual_key")).agg(F.count("*").alias("occurrences"), F.sum(F.col("vec_id") % 5 + 1).cast("long").alias("total"))
