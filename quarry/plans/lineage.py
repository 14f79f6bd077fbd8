"""Content clusters and label lineage over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.ranking import dense_ids
from quarry.plans.catalog import query
from quarry.sources.tables import read

_CLUSTERS = "clu AS (SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1)"


def clusters(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.array_sort(F.collect_set("source")).alias("sources"))


def labelled(spark, sf_dir):
    """(hash, names): the distinct labels of a cluster, as text."""
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy(F.md5("text").alias("hash")).agg(F.array_sort(F.collect_set(F.concat_ws("/", "quality", "toxic"))).alias("names"))


def merged(truth: DataFrame, promotions: DataFrame) -> DataFrame:
    """(hash, truth_wins, promotion_wins, told_by) of two label tables (hash, name), either of which may lack a hash."""
    both = truth.select("hash", F.col("name").alias("_t")).join(promotions.select("hash", F.col("name").alias("_p")), "hash", "full")
    told = F.when(F.col("_p").isNull(), "truth").when(F.col("_t").isNull(), "promotion").when(F.col("_t") == F.col("_p"), "both").otherwise("conflict")
    return both.select("hash", F.coalesce("_t", "_p").alias("truth_wins"), F.coalesce("_p", "_t").alias("promotion_wins"), told.alias("told_by"))


_LABELLED = "lab AS (SELECT md5(text) AS hash, list_sort(list(DISTINCT quality || '/' || toxic)) AS names FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


@query(f"WITH {_CLUSTERS} SELECT hash, n, first_id, sources, row_number() OVER (PARTITION BY sources[1] ORDER BY n DESC, hash) AS place FROM clu")
def hash_clusters(spark, sf_dir):
    """Clusters with their place among those of their first source: ranked over range partitions, less what comes before the source."""
    own = clusters(spark, sf_dir).withColumn("first", F.get("sources", F.lit(0)))
    ranked = dense_ids(own, ["first", F.desc("n"), "hash"], "rank")
    begins = ranked.groupBy("first").agg(F.min("rank").alias("begin"))
    out = ranked.join(begins, "first")
    return out.select("hash", "n", "first_id", "sources", (F.col("rank") - F.col("begin") + 1).cast("long").alias("place"))


@query(f"WITH {_LABELLED} SELECT hash, names, CASE WHEN len(names) = 1 THEN names[1] END AS label, CASE WHEN len(names) > 1 THEN 'ambiguous' ELSE 'ground_truth' END AS source FROM lab")
def label_conflicts(spark, sf_dir):
    n = F.size("names")
    return labelled(spark, sf_dir).select("hash", "names", F.when(n == 1, F.get("names", F.lit(0))).alias("label"), F.when(n > 1, "ambiguous").otherwise("ground_truth").alias("source"))


@query(f"""
WITH {_CLUSTERS}, {_LABELLED}, ov AS (SELECT hash[1:10] AS prefix, 'manual' AS name FROM clu WHERE first_id % 11 = 0)
SELECT hash, CASE WHEN len(names) > 1 THEN 'ground_truth_ambiguous' WHEN len(names) = 1 THEN 'ground_truth' WHEN ov.prefix IS NOT NULL THEN 'manual' WHEN n > 1 THEN 'inferred' ELSE 'unresolved' END AS source,
  CASE WHEN len(names) = 1 THEN names[1] WHEN names IS NULL THEN ov.name END AS label
FROM clu LEFT JOIN lab USING (hash) LEFT JOIN ov ON prefix = hash[1:10]""")
def label_cascade(spark, sf_dir):
    clu = clusters(spark, sf_dir)
    manual = clu.where("first_id % 11 = 0").select(F.substring("hash", 1, 10).alias("prefix"), F.lit("manual").alias("manual"))
    all_ = clu.join(labelled(spark, sf_dir), "hash", "left").join(manual, F.substring("hash", 1, 10) == F.col("prefix"), "left")
    k = F.when(F.col("names").isNull(), 0).otherwise(F.size("names"))
    source = F.when(k > 1, "ground_truth_ambiguous").when(k == 1, "ground_truth").when(F.col("prefix").isNotNull(), "manual").when(F.col("n") > 1, "inferred").otherwise("unresolved")
    return all_.select("hash", source.alias("source"), F.when(k == 1, F.get("names", F.lit(0))).when(k == 0, F.col("manual")).alias("label"))


@query(f"""
WITH {_CLUSTERS}, truth AS (SELECT hash, sources[1] || '/' || first_id % 4 AS name FROM clu WHERE first_id % 2 = 0), promo AS (SELECT hash, sources[1] || '/' || first_id % 3 AS name FROM clu WHERE first_id % 3 < 2)
SELECT coalesce(truth.hash, promo.hash) AS hash, coalesce(truth.name, promo.name) AS truth_wins, coalesce(promo.name, truth.name) AS promotion_wins,
  CASE WHEN promo.hash IS NULL THEN 'truth' WHEN truth.hash IS NULL THEN 'promotion' WHEN truth.name = promo.name THEN 'both' ELSE 'conflict' END AS told_by FROM truth FULL JOIN promo ON truth.hash = promo.hash""")
def label_precedence(spark, sf_dir):
    """Two maps of labels as one, by either precedence, and who told."""
    clu = clusters(spark, sf_dir)
    name = lambda k: F.concat_ws("/", F.get("sources", F.lit(0)), (F.col("first_id") % k).cast("string")).alias("name")
    return merged(clu.where("first_id % 2 = 0").select("hash", name(4)), clu.where("first_id % 3 < 2").select("hash", name(3)))


@query("""
WITH per AS (SELECT l_orderkey AS id, p_brand AS icon, count(DISTINCT l_linenumber) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
tot AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT id, icon FROM per JOIN tot USING (id, n) WHERE n > 1""")
def candidate_intersection(spark, sf_dir):
    """Icons that every contributor (line) of an order allows: relational division."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    per = lines.groupBy(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("icon")).agg(F.countDistinct("l_linenumber").alias("n"))
    total = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_linenumber").alias("n"))
    return per.join(total, ["id", "n"]).where("n > 1").select("id", "icon")


@query(f"""
WITH {_CLUSTERS}, arg AS (SELECT 'unlabeled_' || hash[1:(4 + first_id % 7)::INTEGER] || '.png' AS raw FROM clu),
norm AS (SELECT DISTINCT raw, regexp_replace(regexp_replace(trim(raw), '^unlabeled_', ''), '\\.png$', '') AS prefix FROM arg)
SELECT raw, count(hash) AS hits, CASE WHEN count(hash) = 1 THEN min(hash) END AS hash FROM norm LEFT JOIN clu ON starts_with(hash, prefix) GROUP BY raw""")
def prefix_overrides(spark, sf_dir):
    """Prefixes of hashes: an equi-join on the first characters for each length in use; two or more hits are refused."""
    clu = clusters(spark, sf_dir).select("hash", "first_id")
    cut = (F.col("first_id") % 7 + 4).cast("int")
    raw = clu.select(F.concat(F.lit("unlabeled_"), F.substr("hash", F.lit(1), cut), F.lit(".png")).alias("raw")).distinct()
    norm = raw.withColumn("prefix", T.override_key(F.col("raw")))
    by_length = clu.select("hash", F.explode(F.sequence(F.lit(4), F.lit(10))).alias("k")).select("hash", F.substr("hash", F.lit(1), F.col("k")).alias("prefix"))
    hit = norm.join(by_length, "prefix", "left").groupBy("raw").agg(F.count("hash").alias("hits"), F.min("hash").alias("h"))
    return hit.select("raw", "hits", F.when(F.col("hits") == 1, F.col("h")).alias("hash"))


@query("""
WITH lab AS (SELECT md5(text) AS hash, md5(text)[1:10] AS prefix, min(doc_id) AS first_id, list_sort(list(DISTINCT lang || '/' || (doc_id % 2))) AS forms FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
one AS (SELECT prefix, min(hash) AS hash, arg_min(first_id, hash) AS first_id, arg_min(forms, hash) AS forms FROM lab GROUP BY 1),
ans AS (SELECT doc_id, md5(text)[1:10] AS prefix, lang || '/' || (doc_id % 2) AS name FROM documents)
SELECT doc_id, CASE WHEN one.hash IS NULL THEN 'unknown hash' WHEN first_id % 4 = 0 THEN 'already promoted' WHEN name NOT LIKE 'e%' THEN 'unknown name' WHEN NOT list_contains(forms, name) THEN 'not allowed'
  WHEN first_id % 3 = 0 AND forms[1] <> name THEN 'conflicting' WHEN first_id % 3 = 0 THEN 'unchanged' ELSE 'merged' END AS outcome
FROM ans LEFT JOIN one USING (prefix)""")
def answer_merge(spark, sf_dir):
    """What becomes of each answer, given by a prefix of its hash (the first hash that has it): merged, unchanged, or ignored for a reason."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), F.concat_ws("/", "lang", F.col("doc_id") % 2).alias("name"))
    lab = docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.array_sort(F.collect_set("name")).alias("forms"))
    one = lab.groupBy(F.substring("hash", 1, 10).alias("prefix")).agg(F.min(F.struct("hash", "first_id", "forms")).alias("x")).select("prefix", "x.*")
    out = docs.select("doc_id", F.substring("hash", 1, 10).alias("prefix"), "name").join(one, "prefix", "left")
    known, settled = F.startswith("name", F.lit("e")), F.col("first_id") % 3 == 0
    why = F.when(F.col("hash").isNull(), "unknown hash").when(F.col("first_id") % 4 == 0, "already promoted").when(~known, "unknown name").when(~F.array_contains("forms", F.col("name")), "not allowed")
    return out.select("doc_id", why.when(settled & (F.get("forms", F.lit(0)) != F.col("name")), "conflicting").when(settled, "unchanged").otherwise("merged").alias("outcome"))


@query("""
WITH truth AS (SELECT doc_id, quality FROM labels), promo AS (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 4 = 0)
SELECT doc_id, 'promotions' AS target, quality FROM promo UNION ALL SELECT doc_id, 'truth', quality FROM truth WHERE doc_id NOT IN (SELECT doc_id FROM promo)""")
def promotion_move(spark, sf_dir):
    truth = read(spark, sf_dir, "labels").select("doc_id", "quality")
    promo = truth.where("doc_id % 4 = 0").withColumn("quality", 1 - F.col("quality"))
    return promo.select("doc_id", F.lit("promotions").alias("target"), "quality").union(truth.join(promo.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("truth").alias("target"), "quality"))


@query(f"""
WITH {_LABELLED}, d AS (SELECT doc_id, md5(text) AS hash FROM documents)
SELECT CASE WHEN labels.doc_id IS NULL THEN 'not_audited' WHEN list_contains(names, quality || '/' || toxic) AND len(names) = 1 THEN 'audited' ELSE 'audited_disagree' END AS status, count(*) AS n
FROM d LEFT JOIN labels USING (doc_id) LEFT JOIN lab USING (hash) GROUP BY 1""")
def audit_status(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    all_ = d.join(read(spark, sf_dir, "labels"), "doc_id", "left").join(labelled(spark, sf_dir), "hash", "left")
    agree = F.array_contains("names", F.concat_ws("/", "quality", "toxic")) & (F.size("names") == 1)
    return all_.groupBy(F.when(F.col("quality").isNull(), "not_audited").when(agree, "audited").otherwise("audited_disagree").alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH need AS (SELECT DISTINCT p_brand || '_' || p_size AS k FROM part), have AS (SELECT p_brand || '_' || p_size AS k, l_returnflag AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
by_key AS (SELECT need.k, list(s) AS ss FROM need LEFT JOIN have USING (k) GROUP BY 1)
SELECT CASE WHEN list_contains(ss, 'A') THEN 'confirmed' WHEN list_contains(ss, 'R') THEN 'manual' WHEN list_contains(ss, 'N') THEN 'inferred' ELSE 'missing' END AS category, count(*) AS n FROM by_key GROUP BY 1""")
def coverage_report(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("k", T.observed_key(F.col("p_brand"), F.col("p_size").cast("string")))
    have = read(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("k", F.col("l_returnflag").alias("s")).distinct()
    by_key = part.select("k").distinct().join(have, "k", "left").groupBy("k").agg(F.collect_list("s").alias("ss"))
    has = lambda x: F.array_contains("ss", x)
    return by_key.groupBy(F.when(has("A"), "confirmed").when(has("R"), "manual").when(has("N"), "inferred").otherwise("missing").alias("category")).agg(F.count("*").alias("n"))


@query("""
SELECT p_name AS name, count(DISTINCT p_brand) FILTER (WHERE p_size > 5) AS breadth, arg_min(p_type, (p_brand, p_partkey)) FILTER (WHERE p_size > 5) AS example,
  count(DISTINCT p_brand) FILTER (WHERE p_size > 5) BETWEEN 1 AND 2 AS narrow FROM part WHERE p_name NOT IN (SELECT max(p_name) FROM part) GROUP BY 1""")
def breadth_and_example(spark, sf_dir):
    """For each name that is not flagged: how many containers allow it, the first example, and whether they are one or two."""
    part = read(spark, sf_dir, "part")
    flagged = part.agg(F.max("p_name").alias("p_name"))
    allows = F.col("p_size") > 5
    g = part.join(F.broadcast(flagged), "p_name", "left_anti").groupBy(F.col("p_name").alias("name"))  # one row
    g = g.agg(F.countDistinct(F.when(allows, F.col("p_brand"))).alias("breadth"), F.min_by(F.when(allows, F.col("p_type")), F.when(allows, F.struct("p_brand", "p_partkey"))).alias("example"))
    return g.withColumn("narrow", F.col("breadth").between(1, 2))


@query("""
WITH miss AS (SELECT DISTINCT p_name AS key, p_brand AS item FROM part)
SELECT item, count(*) AS n FROM (SELECT item, row_number() OVER (PARTITION BY key ORDER BY item) AS rn FROM miss) WHERE rn = 1 GROUP BY 1""")
def coverage_first_container(spark, sf_dir):
    miss = read(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("item")).distinct()
    return miss.groupBy("key").agg(F.min("item").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z][A-Za-z,.\-'' ]*[A-Za-z]')) AS runs
FROM (SELECT doc_id, translate(text, '‘’', '''''') AS t FROM documents)""")
def word_runs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.word_runs(F.translate("text", "‘’", "''"))).cast("long").alias("runs"))


@query()
def name_spans(spark, sf_dir):
    """Words of a turn that have the shape of a name, with the word before each."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(T.repair_article_comma(T.straight_quotes(F.col("text"))), r"\s+")).alias("pos", "word"))
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    c = c.withColumn("before", F.lag("word").over(w)).withColumn("core", F.regexp_replace("word", r"^[^A-Za-z]+|[^A-Za-z]+$", ""))
    return c.where(T.looks_like_name(F.col("core"))).select("conv_id", "turn", "pos", "core", F.coalesce(F.lower("before").isin("the", "of"), F.lit(False)).alias("after_article"))


@query(r"""
SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(string_split(text, chr(10))) >= 9 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(#|Licensed)'))) = 0 AS valid FROM documents""")
def document_validity(spark, sf_dir):
    """Long enough, and without a flagged line."""
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), ((F.size(lines) >= 9) & ~F.exists(lines, lambda x: x.rlike("^(#|Licensed)"))).alias("valid"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Prime' END AS qualifier, source AS base, CASE WHEN doc_id % 3 = 0 THEN 'Prime ' || source ELSE source END AS full_name FROM documents""")
def qualifier_split(spark, sf_dir):
    """Qualified names taken apart, whatever their case, and put together again."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.when(F.col("doc_id") % 2 == 0, "Prime ").otherwise("pRIME   "), "source")).otherwise(F.col("source"))
    q, base = T.split_qualifier(raw, "Prime")
    return read(spark, sf_dir, "documents").select("doc_id", q.alias("qualifier"), base.alias("base"), T.join_qualifier(q, base).alias("full_name"))


@query("""
WITH sig AS (SELECT source, list_sort(list(DISTINCT lang)) AS expected FROM documents WHERE doc_id % 7 = 0 GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN [] WHEN expected IS NULL THEN list_transform(range(doc_id % 4), lambda i: 'Unknown')
  WHEN len(expected) = 1 THEN list_transform(range(doc_id % 4), lambda i: expected[1]) WHEN doc_id % 4 = 1 THEN expected ELSE list_transform(range(doc_id % 4), lambda i: 'Unknown') END AS names
FROM documents LEFT JOIN sig USING (source)""")
def presence_cascade(spark, sf_dir):
    """None counted: none; one expected: repeated; several: the matches or Unknown; no pool: Unknown."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sig = docs.where("doc_id % 7 = 0").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("expected"))
    n = (F.col("doc_id") % 4).cast("int")
    unknown = F.array_repeat(F.lit("Unknown"), n)
    names = F.when(n == 0, F.array().cast("array<string>")).when(F.col("expected").isNull(), unknown).when(F.size("expected") == 1, F.array_repeat(F.get("expected", F.lit(0)), n)).when(n == 1, F.col("expected")).otherwise(unknown)
    return docs.join(sig, "source", "left").select("doc_id", names.alias("names"))
