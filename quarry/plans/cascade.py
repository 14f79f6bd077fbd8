"""The full label cascade over content clusters of the documents; items, offers and witnesses are stand-ins from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cascade
from quarry.plans.catalog import query
from quarry.plans.identities import _DIM, _NAME, dimension, shown_name, with_identity
from quarry.runtime import shared_folder
from quarry.sources.tables import read

_ROMAN = "CASE {} WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' END"


def full_dimension(spark, sf_dir: str) -> DataFrame:
    """(name, icon, tier as Roman, identity, key, idx, total); idx numbers the names, a closed list, in order."""
    from pyspark.sql import Window

    d = with_identity(dimension(spark, sf_dir)).withColumn("tier", T.tier_roman(F.col("tier")))
    d = d.withColumn("key", T.observed_key(F.col("icon"), F.col("tier")))
    numbered = d.withColumn("idx", F.row_number().over(Window.orderBy("name")) - 1)
    return numbered.withColumn("total", F.count("*").over(Window.partitionBy())).select("name", "icon", "tier", "identity", "key", "idx", "total")


def offers(spark, sf_dir: str) -> DataFrame:
    """(item, name, tier): what a supplier's lines of one kind have; some of them offer a name that nobody knows."""
    part = read(spark, sf_dir, "part").withColumn("tier", F.when(F.col("p_size") % 5 > 0, T.tier_roman(F.col("p_size") % 3 + 1)))
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("Lesser ", "", "Greater ", "Gilded ")]), F.col("p_size") % 4 + 1)
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_returnflag = 'R' and l_tax < 0.035D").join(part, F.col("p_partkey") == F.col("l_partkey"))
    odd = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("item"), F.lit("Never heard of").alias("name"), F.lit("I").alias("tier"))
    return lines.select(F.col("l_suppkey").alias("item"), F.concat(prefix, "p_name").alias("name"), "tier").union(odd).distinct()


def witnesses(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of `cascade.label`, by its arguments."""
    shared_folder(spark)
    # closed lists that nearly every join below reads
    docs, dim, off = read(spark, sf_dir, "documents"), full_dimension(spark, sf_dir).checkpoint(), offers(spark, sf_dir).checkpoint()
    names = dim.select("name", F.col("idx").alias("i"))
    total = F.broadcast(dim.select("total").limit(1))  # one row
    occ = docs.select(F.md5("text").alias("hash"), "doc_id", F.explode(F.array(F.col("doc_id") % 10 + 1, F.col("doc_id") % 7 + 1)).alias("item"))
    clu = occ.groupBy("hash").agg(F.min("doc_id").alias("id"), F.array_sort(F.collect_set("item")).alias("items")).checkpoint()
    lab = docs.where("doc_id % 2 = 0").join(read(spark, sf_dir, "labels"), "doc_id").join(total).select(F.md5("text").alias("hash"), ((F.col("doc_id") % 3 + F.col("quality") * 5 + F.col("toxic") * 11) % F.col("total")).alias("i"))
    truth = lab.join(names, "i").groupBy("hash").agg(F.array_sort(F.collect_set("name")).alias("truth"))
    clusters = clu.join(truth, "hash", "left").withColumn("truth", F.coalesce("truth", F.array().cast("array<string>")))
    any_ = clu.join(total).withColumn("i", F.col("id") % F.col("total")).join(names, "i")
    offered = off.join(dim.select("name", "key"), "name")
    first = clu.withColumn("item", F.get("items", F.lit(0))).join(offered.groupBy("item").agg(F.min("name").alias("low"), F.max_by("key", "name").alias("high")), "item")
    roman = lambda c: T.tier_roman(c)
    noted = clu.where("id % 4 = 1").select("hash", roman(F.col("id") % 3 + 1).alias("tier")).union(clu.where("id % 8 = 1").select("hash", roman(F.col("id") % 5 % 3 + 1)))
    return {
        "clusters": clusters.select("hash", "items", "truth"),
        "offers": off,
        "dimension": dim.drop("idx", "total"),
        "promoted": any_.where("id % 13 = 5").select("hash", F.col("name").alias("promoted")),
        "notes": cascade.agreed(noted, "tier"),
        "by_hand": first.where("id % 12 = 2").select("hash", F.col("low").alias("given")).union(any_.where("id % 12 = 8").select("hash", "name")),
        "predicted": first.where("id % 10 = 3").select("hash", F.col("high").alias("seen")).union(any_.where("id % 10 = 8").join(dim.select("name", "key"), "name").select("hash", "key")),
    }


_TABLES = f"""{_DIM},
d AS (SELECT name, icon, {_ROMAN.format('tier')} AS tier, identity, icon || '_' || lower({_ROMAN.format('tier')}) AS key, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS total FROM ident),
off AS (SELECT DISTINCT l_suppkey AS item, {_NAME} AS name, CASE WHEN p_size % 5 > 0 THEN {_ROMAN.format('(p_size % 3 + 1)')} END AS tier FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 7 AND l_returnflag = 'R' AND l_tax < 0.035
  UNION SELECT s_suppkey, 'Never heard of', 'I' FROM supplier WHERE s_suppkey % 4 = 0),
occ AS (SELECT md5(text) AS hash, doc_id, unnest([doc_id % 10 + 1, doc_id % 7 + 1]) AS item FROM documents),
clu AS (SELECT hash, min(doc_id) AS id, list_sort(list(DISTINCT item)) AS items FROM occ GROUP BY 1),
truth AS (SELECT md5(text) AS hash, list_sort(list(DISTINCT name)) AS truth FROM documents JOIN labels USING (doc_id) JOIN d ON d.idx = (doc_id % 3 + quality * 5 + toxic * 11) % d.total WHERE doc_id % 2 = 0 GROUP BY 1),
anyn AS (SELECT hash, id, name, key FROM clu JOIN d ON d.idx = id % d.total),
first AS (SELECT hash, id, low, high FROM clu JOIN (SELECT item, min(name) AS low, arg_max(key, name) AS high FROM off JOIN d USING (name) GROUP BY 1) f ON f.item = items[1]),
noted AS (SELECT hash, {_ROMAN.format('(id % 3 + 1)')} AS tier FROM clu WHERE id % 4 = 1 UNION ALL SELECT hash, {_ROMAN.format('(id % 5 % 3 + 1)')} FROM clu WHERE id % 8 = 1),
note AS (SELECT hash, CASE WHEN count(DISTINCT tier) = 1 THEN min(tier) END AS tier FROM noted GROUP BY 1),
hand AS (SELECT hash, low AS given FROM first WHERE id % 12 = 2 UNION ALL SELECT hash, name FROM anyn WHERE id % 12 = 8),
pred AS (SELECT hash, high AS seen FROM first WHERE id % 10 = 3 UNION ALL SELECT hash, key FROM anyn WHERE id % 10 = 8),
each_ AS (SELECT DISTINCT hash, item FROM occ WHERE item IN (SELECT item FROM off)),
held AS (SELECT DISTINCT item, icon, off.tier, identity FROM off JOIN d USING (name)),
rows_ AS (SELECT hash, item, icon, tier, identity FROM each_ JOIN held USING (item)),
common AS (SELECT hash, icon FROM rows_ GROUP BY 1, 2 HAVING count(DISTINCT item) = (SELECT count(*) FROM each_ e WHERE e.hash = rows_.hash)),
ok AS (SELECT rows_.* FROM rows_ JOIN common USING (hash, icon)),
poss AS (SELECT hash, list(DISTINCT icon) AS icons, list_sort(list(DISTINCT identity)) AS cands FROM ok GROUP BY 1),
mem AS (SELECT identity, list_sort(list(name)) AS members FROM d GROUP BY 1),
shown AS (SELECT identity, coalesce(list_filter(members, lambda m: NOT (starts_with(m, 'Lesser ') OR starts_with(m, 'Greater ') OR starts_with(m, 'Gilded ')))[1], identity) AS shown, len(members) AS n FROM mem),
man AS (SELECT hand.hash, given AS manual FROM hand JOIN d ON d.name = given LEFT JOIN poss USING (hash) LEFT JOIN note USING (hash) WHERE (icons IS NULL OR list_contains(icons, d.icon)) AND (note.tier IS NULL OR note.tier = d.tier)),
mat AS (SELECT hash, list_sort(list(name)) AS matches, any_value(seen) AS seen FROM pred JOIN d ON d.key = seen JOIN poss USING (hash) WHERE list_contains(cands, d.identity) AND list_contains(icons, d.icon) GROUP BY 1),
base AS (SELECT hash, id, truth.truth, anyn.name AS promoted, note.tier, poss.icons, poss.cands, man.manual, mat.matches, mat.seen, anyn.hash IS NULL AND truth.truth IS NULL AS inferring FROM clu LEFT JOIN truth USING (hash)
  LEFT JOIN (SELECT hash, name FROM anyn WHERE id % 13 = 5) anyn USING (hash) LEFT JOIN note USING (hash) LEFT JOIN poss USING (hash) LEFT JOIN man USING (hash) LEFT JOIN mat USING (hash)),
b1 AS (SELECT *, inferring AND icons IS NULL AS anomaly, CASE WHEN promoted IS NOT NULL THEN 'promoted' WHEN len(truth) = 1 THEN 'truth' WHEN len(truth) > 1 THEN 'truth_ambiguous' WHEN icons IS NOT NULL AND manual IS NOT NULL THEN 'manual' WHEN len(matches) = 1 THEN 'classifier' WHEN len(matches) > 1 THEN 'collision' END AS b FROM base),
cut AS (SELECT hash, list_sort(list(DISTINCT ok.identity)) AS few FROM b1 JOIN ok USING (hash) WHERE b IS NULL AND ok.tier = b1.tier GROUP BY 1),
b2 AS (SELECT *, few IS NOT NULL AS narrowed, CASE WHEN b IS NULL THEN coalesce(few, cands) END AS left_ FROM b1 LEFT JOIN cut USING (hash)),
b3 AS (SELECT b2.*, CASE WHEN len(left_) = 1 THEN left_[1] END AS one FROM b2),
b4 AS (SELECT b3.*, shown.shown, CASE WHEN narrowed THEN b3.tier WHEN shown.n = 1 THEN (SELECT max(tier) FROM d WHERE d.identity = one) END AS at_tier FROM b3 LEFT JOIN shown ON shown.identity = one),
sing AS (SELECT hash, min(d.key) AS skey FROM b4 JOIN d ON d.identity = one AND d.tier = at_tier AND list_contains(icons, d.icon) GROUP BY 1 HAVING count(*) = 1),
b5 AS (SELECT b4.*, skey, coalesce(b, CASE WHEN skey IS NOT NULL THEN 'single' END, 'open') AS branch FROM b4 LEFT JOIN sing USING (hash)),
b6 AS (SELECT *, CASE branch WHEN 'promoted' THEN promoted WHEN 'truth' THEN truth[1] WHEN 'manual' THEN manual WHEN 'classifier' THEN matches[1] END AS given FROM b5),
told AS (SELECT hash, CASE WHEN count(DISTINCT key) = 1 AND count(key) = count(*) THEN min(key) END AS tkey FROM (SELECT hash, unnest(truth) AS name FROM truth WHERE len(truth) > 1) LEFT JOIN d USING (name) GROUP BY 1),
can AS (SELECT hash, list_sort(list(DISTINCT x)) AS candidates FROM (
  SELECT hash, shown AS x FROM (SELECT hash, unnest(left_) AS identity FROM b6 WHERE branch = 'open' AND NOT anomaly) JOIN shown USING (identity)
  UNION ALL SELECT hash, shown FROM (SELECT hash, unnest(matches) AS name FROM b6 WHERE branch = 'collision') JOIN d USING (name) JOIN shown USING (identity)
  UNION ALL SELECT hash, unnest(truth) FROM b6 WHERE branch = 'truth_ambiguous') GROUP BY 1),
lab AS (SELECT hash, branch, CASE branch WHEN 'promoted' THEN 'campaign_confirmed' WHEN 'truth' THEN 'ground_truth' WHEN 'truth_ambiguous' THEN 'ground_truth_ambiguous' WHEN 'manual' THEN 'manual' WHEN 'classifier' THEN 'embedding_confirmed' ELSE 'inferred' END AS source,
  CASE WHEN branch = 'single' THEN shown ELSE given END AS label, CASE WHEN branch = 'single' THEN one ELSE d.identity END AS identity,
  CASE branch WHEN 'truth_ambiguous' THEN tkey WHEN 'collision' THEN seen WHEN 'single' THEN skey ELSE d.key END AS key, CASE WHEN inferring THEN b6.tier END AS tier, narrowed AND inferring AS tier_narrowed, anomaly, candidates
  FROM b6 LEFT JOIN d ON d.name = given LEFT JOIN told USING (hash) LEFT JOIN can USING (hash))"""


@query(f"WITH {_TABLES} SELECT * FROM lab")
def cluster_labels(spark, sf_dir):
    """Each cluster's label, the branch that gave it, and what is possible where none did."""
    return cascade.label(**witnesses(spark, sf_dir), shown=shown_name)


@query(f"""
WITH {_TABLES}, said AS (SELECT key, unnest(CASE WHEN label IS NOT NULL THEN [label] ELSE candidates END) AS x FROM lab WHERE key IS NOT NULL),
many AS (SELECT key, list_sort(list(DISTINCT x)) AS every FROM said GROUP BY 1 HAVING count(DISTINCT x) > 1)
SELECT hash, branch, CASE WHEN every IS NULL THEN source ELSE 'visual_key_ambiguous' END AS source, CASE WHEN every IS NULL THEN label END AS label, CASE WHEN every IS NULL THEN identity END AS identity, key, tier, tier_narrowed, anomaly, coalesce(every, candidates) AS candidates
FROM lab LEFT JOIN many USING (key)""")
def settled_labels(spark, sf_dir):
    """The labels after clusters of one key have been compared: those of a key with several labels are all ambiguous."""
    return cascade.reclassified(cascade.label(**witnesses(spark, sf_dir), shown=shown_name))
