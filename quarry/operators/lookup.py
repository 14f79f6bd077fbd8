"""Lookups that refuse rather than guess: each returns value, status, score, runner-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import ratio


#: Parts of the queries of one length.
SALTS = 16


def names_from_ids(df: DataFrame, key: str, ids: str, dim: DataFrame, dim_id: str, name: str) -> DataFrame:
    """(key, names): array foreign keys to names in their order; misses are dropped."""
    flat = df.select(key, F.posexplode(ids).alias("pos", "_id")).join(dim.select(F.col(dim_id).alias("_id"), F.col(name).alias("_name")), "_id")
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_name"))), lambda x: x["_name"]).alias("names"))


def with_fallback_key(df: DataFrame, dim: DataFrame, exact: Column, base: Column, key: str, value: str) -> DataFrame:
    """The dimension's value under the exact key, else under the base key."""
    one = dim.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    two = dim.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    out = df.join(one, exact == F.col("_k1"), "left").join(two, base == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def letters(text: Column | str) -> Column:
    """The letters of a text, each with its number among its equals, so that two texts share as many entries as a matching of
    their letters can have."""
    each = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    at = F.transform(each, lambda c, i: F.concat(c, (i - F.array_position(each, c).cast("int")).cast("string")))
    return at


def lookup(queries: DataFrame, pool: DataFrame, cutoff: float = 0.6, margin: float = 0.05) -> DataFrame:
    """queries(query) in pool(item), whatever the case: exact, the only item that the query begins, the closest by ratio.

    The two closest items (ties to the larger string) are ranked by the ratio of item to query and told apart by that of
    query to item, which is another number. If they are closer than the margin, and one is the other with words before it,
    the longer one is taken if the query has those words and the shorter if not; else the answer is refused. A query is
    compared only with items of a length that can reach the cutoff, by an equi-join on the length (of SALTS parts each, since
    lengths are few: the pool, which is a list of names, is written to all of them), and which share letters enough for it.
    """
    q = queries.where("query is not null").select("query", F.lower("query").alias("q")).distinct()
    p = pool.where("item is not null").groupBy(F.lower("item").alias("i")).agg(F.max("item").alias("item"))
    exact = q.join(p, F.col("q") == F.col("i")).select("query", F.col("item").alias("value"), F.lit("exact").alias("status"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("runner_up"))
    rest = q.join(exact.select("query"), "query", "left_anti")
    least = F.broadcast(p.agg(F.min(F.length("i")).alias("least")))  # one row
    begins = p.join(least).select("item", F.explode(F.when(F.length("i") >= F.col("least"), F.transform(F.sequence("least", F.length("i")), lambda n: F.substr("i", F.lit(1), n)))).alias("begin"))
    only = rest.join(begins, F.col("q") == F.col("begin")).groupBy("query").agg(F.count("*").alias("n"), F.max("item").alias("value")).where("n = 1")
    prefix = only.select("query", "value", F.lit("prefix").alias("status"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("runner_up"))
    found = exact.union(prefix)
    if cutoff <= 1:
        rest = rest.join(prefix.select("query"), "query", "left_anti").where("q <> ''")
        reach = (2 - cutoff) / cutoff  # a ratio is at most twice the shorter length over the sum
        lengths = F.sequence(F.floor(F.length("q") / reach).cast("int"), F.ceil(F.length("q") * reach).cast("int"))
        asked = rest.withColumn("has", letters("q")).withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(SALTS)).cast("int")).withColumn("n", F.explode(lengths))
        listed = p.withColumn("n", F.length("i")).withColumn("letters", letters("i")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # matching blocks are made of letters that both have
        shared = 2 * F.size(F.array_intersect("has", "letters")) / (F.length("q") + F.length("i"))
        near = asked.join(listed, ["n", "salt"]).where(shared >= cutoff).drop("has", "letters")
        scored = near.withColumn("score", ratio("i", "q")).where(F.col("score") >= cutoff)
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("i"))
        two = scored.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("query", "q").agg(F.min(F.struct("rn", "i", "item", "score")).alias("a"), F.max(F.struct("rn", "i", "item", "score")).alias("b"))
        two = two.withColumn("sa", ratio("q", "a.i")).withColumn("sb", ratio("q", "b.i"))
        clear = (F.col("b.rn") == 1) | (F.col("sa") - F.col("sb") >= margin)
        longer, shorter = (F.when(F.length("a.i") >= F.length("b.i"), F.col(f"{x}.i")).otherwise(F.col(f"{y}.i")) for x, y in (("a", "b"), ("b", "a")))
        item = lambda chosen: F.when(chosen == F.col("a.i"), F.col("a.item")).otherwise(F.col("b.item"))
        tie = F.endswith(longer, F.concat(F.lit(" "), shorter))
        extra = F.substr(longer, F.lit(1), F.length(longer) - F.length(shorter) - 1)
        value = F.when(clear, F.col("a.item")).when(tie, F.when(F.contains(F.col("q"), extra), item(longer)).otherwise(item(shorter)))
        status = F.when(clear, "fuzzy").when(tie, "leading words").otherwise("ambiguous")
        found = found.union(two.select("query", value.alias("value"), status.alias("status"), F.col("a.score").alias("score"), F.when(F.col("b.rn") == 2, F.col("b.item")).alias("runner_up")))
    return q.join(found, "query", "left").select("query", "value", F.coalesce("status", F.lit("none")).alias("status"), "score", "runner_up")


def best_reading(rows: DataFrame, key: str, lines: str, pool: DataFrame) -> DataFrame:
    """(key, value, score): the item of the pool that a row's lines spell.

    Each line is looked up, and all of them joined where there are several; of the readings that name an item the one that
    spells it best wins (the ratio of reading to item), the joined one of equals and then the first line. Null if none does."""
    joined = F.when(F.size(lines) > 1, F.array(F.array_join(lines, " "))).otherwise(F.array().cast("array<string>"))
    each = rows.select(key, F.posexplode(F.concat(joined, F.col(lines))).alias("_ord", "query"))
    named = each.join(lookup(each.select("query"), pool).select("query", "value"), "query").where("value is not null")
    scored = named.withColumn("score", ratio(F.lower("query"), F.lower("value")))
    best = scored.groupBy(key).agg(F.max_by(F.struct("value", "score"), F.struct("score", -F.col("_ord"))).alias("x"))
    return rows.select(key).join(best, key, "left").select(key, "x.value", "x.score")


def cull(members: Column, allowed: Column) -> Column:
    """Members that are allowed, or all of them if that leaves none or nothing was ambiguous."""
    left = F.array_intersect(members, allowed)
    return F.when((F.size(members) > 1) & allowed.isNotNull() & (F.size(left) > 0), left).otherwise(members)


def cross_check(matched: Column, expected: Column) -> Column:
    """Corrects a match to the only expected value, never invents one."""
    return F.when(matched.isNotNull() & (F.size(expected) == 1), F.element_at(expected, 1)).otherwise(matched)
