"""Names in noisy readings: spans of a known shape, words that a reading has split, and the choice between two readings.

A span is "Word Word", or "Word, the Word ..." or "Word, of Word ..." with one or more title words. Spans may overlap; each word
begins one at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# The words that join a name and its title, and the least length of a title's word.
CONNECTORS = ("the", "of")
LEAST_TITLE_WORD = 3

_STATE = "struct<i:int,after:boolean,last:struct<w:string,comma:boolean,core:string,ok:boolean,joins:boolean>,open:int,title:string,n:int,at:int,out:array<struct<at:int,span:string>>>"
_NO_SPANS = "array<struct<at:int,span:string>>"


def clean_reading(raw: Column) -> Column:
    """One form of apostrophe, and a comma and a space where a comma or full stop has run into a connector."""
    return F.regexp_replace(T.straight_quotes(raw), r"(?iU)([A-Za-z])[.,]\s*(the|of)\b", "$1, $2")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _facts(run: Column) -> Column:
    """The words of a run with all that is asked of one: a comma at its end, what is before it, a name's look, a connector."""
    words = F.concat(F.filter(F.split(run, " +"), lambda w: w != ""), F.array(F.lit(",")))
    cut = F.transform(words, lambda w: F.struct(w.alias("w"), F.endswith(w, F.lit(",")).alias("comma"), F.regexp_replace(w, ",$", "").alias("core")))
    return F.transform(cut, lambda x: F.struct(x["w"].alias("w"), x["comma"].alias("comma"), x["core"].alias("core"), T.looks_like_name(x["core"]).alias("ok"), F.lower(x["w"]).isin(*CONNECTORS).alias("joins")))


def _read_word(s: Column, x: Column) -> Column:
    """The state after a word: a title may be open (1: its first word was read, 2: its connector too), and one span may end."""
    w, plain = x["w"], x["ok"] & ~x["comma"]
    grows = (s["open"] == 2) & plain & (F.length(w) >= LEAST_TITLE_WORD)
    ends = (s["open"] == 2) & ~grows & (s["n"] > 0)
    begins = x["comma"] & x["ok"]
    joins = (s["open"] == 1) & x["joins"]
    pair = s["last"]["ok"] & ~s["last"]["comma"] & plain & ~s["after"]
    none = F.array().cast(_NO_SPANS)
    one = lambda at, span: F.array(F.struct(at.alias("at"), span.alias("span")))
    return F.struct(
        (s["i"] + 1).alias("i"),
        s["last"]["joins"].alias("after"),
        x.alias("last"),
        F.when(grows | joins, 2).when(begins, 1).otherwise(0).alias("open"),
        F.when(grows, F.concat(s["title"], F.lit(" "), w)).when(joins, F.concat(s["title"], F.lit(", "), w)).when(begins, x["core"]).otherwise("").alias("title"),
        F.when(grows, s["n"] + 1).otherwise(0).alias("n"),
        F.when(begins, s["i"]).otherwise(s["at"]).alias("at"),
        F.when(ends | pair, F.concat(s["out"], F.when(ends, one(s["at"], s["title"])).otherwise(none), F.when(pair, one(s["i"] - 1, F.concat(s["last"]["w"], F.lit(" "), w))).otherwise(none))).otherwise(s["out"]).alias("out"),
    ).cast(_STATE)


def _run_spans(run: Column) -> Column:
    nothing = F.struct(F.lit("").alias("w"), F.lit(False).alias("comma"), F.lit("").alias("core"), F.lit(False).alias("ok"), F.lit(False).alias("joins"))
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("after"), nothing.alias("last"), F.lit(0).alias("open"), F.lit("").alias("title"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("out")).cast(_STATE)
    # a comma at the end closes what is open: no title word ends with one
    return F.aggregate(_facts(run), start, _read_word, lambda s: s["out"])


def by_length(spans: Column) -> Column:
    """Most words first, then most characters, then as they stand."""
    key = lambda x, i: F.struct((-F.size(F.split(x, " "))).alias("w"), (-F.length(x)).alias("c"), i.alias("i"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["x"])


def name_spans(raw: Column) -> Column:
    """All spans of a reading, the longest first."""
    found = F.flatten(F.transform(T.word_runs(clean_reading(raw)), lambda run: F.array_sort(_run_spans(run))))
    return by_length(F.transform(found, lambda s: s["span"]))


def rejoin(line: Column, known: Column) -> Column:
    """A line's words, left to right: two neighbours that are not known, but whose concatenation is, become one."""
    kind = "struct<out:array<string>,held:string>"

    def step(s: Column, w: Column) -> Column:
        both = F.concat(s["held"], w)
        merge = s["held"].isNotNull() & F.array_contains(known, both) & ~F.array_contains(known, s["held"]) & ~F.array_contains(known, w)
        kept = F.when(merge, F.array(both)).when(s["held"].isNotNull(), F.array(s["held"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(s["out"], kept).alias("out"), F.when(~F.coalesce(merge, F.lit(False)), w).alias("held")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held")).cast(kind)
    rest = lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))
    return F.array_join(F.aggregate(words(line), start, step, rest), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def repair_split_words(raw: Column, other: Column) -> Column:
    """Words that this reading has split and the other has whole, joined line by line."""
    lines = F.split(raw, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")
    return let(F.array_distinct(words(other)), lambda known: F.array_join(F.transform(lines, lambda x: rejoin(x, known)), "\n"))


def with_name_answer(df: DataFrame, first: str, second: str, stray: str) -> DataFrame:
    """df with `name` and `status`, from two readings of one name.

    `shaped`: the longest span of either reading, the first reading's of equals. `agreed`: a beginning of it that the other
    reading has as a span and this one has not, since words that follow in one reading alone are noise. `unshaped`: no span;
    the longest run of the first reading that has any, without a letter read before the word `stray`. `none`: no run. A null
    reading is an empty one. Columns named `_a`, `_b`, `_sa`, `_sb`, `_best` are replaced.
    """
    trim = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    out = df.withColumn("_a", trim(first)).withColumn("_b", trim(second)).withColumn("_sa", name_spans(F.col("_a"))).withColumn("_sb", name_spans(F.col("_b")))
    for own, other, spans in (("_a", "_b", "_sa"), ("_b", "_a", "_sb")):
        fixed = name_spans(repair_split_words(F.col(own), F.col(other)))
        more = F.filter(fixed, lambda x: ~F.array_contains(F.col(spans), x))  # noqa: B023
        out = out.withColumn(f"{spans}_", F.when(F.col(other) == "", F.col(spans)).otherwise(F.concat(spans, more)))
    out = out.withColumn("_sa", F.col("_sa_")).withColumn("_sb", F.col("_sb_")).withColumn("_best", F.get(by_length(F.concat("_sa", "_sb")), F.lit(0)))

    def shorter(own: str, other: str) -> Column:
        begins = F.filter(other, lambda x: (x != F.col("_best")) & ~F.array_contains(F.col(own), x) & F.startswith(F.col("_best"), F.concat(x, F.lit(" "))))
        return F.when(F.array_contains(F.col(own), F.col("_best")), F.get(begins, F.lit(0)))

    agreed = F.coalesce(shorter("_sa", "_sb"), shorter("_sb", "_sa"))
    run = F.coalesce(T.longest(T.word_runs(F.col("_a"))), T.longest(T.word_runs(F.col("_b"))))
    bare = F.nullif(T.stray_letter(T.straight_quotes(F.trim(run)), stray), F.lit(""))
    status = F.when(F.col("_best").isNull(), F.when(bare.isNull(), "none").otherwise("unshaped")).when(agreed.isNotNull(), "agreed").otherwise("shaped")
    made = out.withColumn("name", F.coalesce(agreed, F.col("_best"), bare)).withColumn("status", status)
    return made.drop("_a", "_b", "_sa", "_sb", "_sa_", "_sb_", "_best")
