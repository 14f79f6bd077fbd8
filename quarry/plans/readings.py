"""Names in two noisy readings of one text; the readings are made from the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.plans.catalog import query
from quarry.sources.tables import read


def readings(spark, sf_dir: str) -> DataFrame:
    """(conv_id, turn, first, second): what users say in capitals with titles; the second reading splits long words, has words
    of its own at line ends and loses others. What others say stands as it is in both."""
    c = read(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    loud = F.regexp_replace(F.regexp_replace(F.initcap(text), r"\. ", ", the "), r"([a-z]{3}) ([A-Z][a-z])", "$1\n$2")
    user = F.col("role") == "user"
    first = F.when(user, loud).otherwise(text)
    split = F.regexp_replace(loud, r"([A-Z][a-z]{3})([a-z]{4})", "$1 $2")
    noise = F.when(F.col("turn") % 3 == 0, F.regexp_replace(loud, r"\n", " Bee\n")).when(F.col("turn") % 3 == 1, split).otherwise(F.regexp_replace(loud, r" [A-Z][a-z]+\n", "\n"))
    return c.select("conv_id", "turn", first.alias("first"), F.when(user, noise).otherwise(text).alias("second"))


@query()
def name_answers(spark, sf_dir):
    """The name that two readings agree on; held against plain Python, since the choice is a walk over words."""
    return names.with_name_answer(readings(spark, sf_dir), "first", "second", "Prime").select("conv_id", "turn", "name", "status")


@query()
def name_shapes(spark, sf_dir):
    """How many spans of a name's shape a reading has, and the longest; held against plain Python."""
    spans = names.name_spans(F.col("first"))
    return readings(spark, sf_dir).select("conv_id", "turn", spans.alias("s")).select("conv_id", "turn", F.size("s").alias("n_spans"), F.get("s", F.lit(0)).alias("longest"))
