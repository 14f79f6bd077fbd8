"""A corpus pipeline of five stages: quality rules, n-gram join, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that `run` writes as Parquet and rereads for the next one.
All take nulls in any column, texts of any length, repeated rows and empty tables (which give no rows); columns that are
not those of documents do not go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from quarry.llm.common import Stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The first stage has removed low quality: what it let through is neither cut nor repeated.
MIX = {"clean": 0.95, "toxic": 0.05}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned rules keep. A null or empty text has no words and goes; a null doc_id is
    rated like any other; repeated rows are rated each on their own."""
    return quality.rate(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the least by (doc_id, node, hash of the row), null ids last. A row without words is its own
    component, by its doc_id and contents; rows equal in all columns are one."""
    marked = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS))
    rows = jaccard_join.join_groups(marked, n=5, num=80, den=100, keep=("_row",))
    alone = F.col("root").isNull()
    key = ["root", F.when(alone, F.col("doc_id")).alias("_id"), F.when(alone, F.col("_row")).alias("_own")]
    least = rows.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "_row")).alias("x")).select("x.doc_id", "x._row")
    # one key alone for the join, so that equal rows lie together after it and texts are not shuffled again
    same = F.coalesce(marked.doc_id == least.doc_id, marked.doc_id.isNull() & least.doc_id.isNull())
    one = marked.join(least, (marked["_row"] == least["_row"]) & same, "left_semi")
    return one.dropDuplicates(["_row", *COLUMNS]).select(*COLUMNS)


def suffix_arrays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere too; a text of which nothing is left goes. A null or empty text
    stays, as an empty one; repeated rows of a long text are copies of each other and go; n_chars is counted anew."""
    cut = suffix_dedup.remove_repeats(docs, length=200)
    text = F.when(F.col("n_removed") == 0, F.col("kept_bytes").cast("string")).otherwise(F.expr("make_valid_utf8(cast(kept_bytes as string))"))
    left = cut.where("n_removed = 0 or n_bytes > n_removed").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded by a hash of its id and text, says. A null or empty text has no tokens and
    the rate of its posterior; repeated rows are copied alike."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), targets=MIX)
    return mixed.where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens: a null or empty text is its end id alone, a null doc_id is kept,
    repeated rows are packed each on their own."""
    return packing.pack(docs, capacity=4096, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("suffix_arrays", suffix_arrays),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned rules, suffix arrays and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
