"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host + path with a verdict, and literal tokens (maximal runs of letters and digits)
that any URL it fits must hold. Token frequencies are counted over all URLs; each rule is filed under its rarest token.
A URL's tokens fetch the candidate rules and only those run their expressions. Of the rules that fit, explicit host and
path rules come first, the longest winning; then the patterns, where block wins; a URL that nothing fits is allowed.

The index is part of the plan's expressions; its size is that of the rule set, checked against MOST_RULES. Larger sets
go through a join on tokens. Nulls: a null url, or one without "://", has an empty host and path and is allowed; a null
page_id is kept. Repeated rows are judged each on their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """name: reported for explicit rules; rank: larger wins; block breaks ties."""

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def explicit(verdict: str, rule: str) -> Rule:
    """host + path prefix, such as example.com/en/7; it fits the host and all its subdomains."""
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host)
    inner = re.findall(r"(?<=[/])[a-z0-9]+(?=[/])", slash + path)  # whole path segments: ended by a slash in the rule itself
    return Rule(rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole + inner), verdict, 1000 + len(rule))


def pattern(verdict: str, expression: str, *tokens: str) -> Rule:
    return Rule(None, expression, tokens, verdict, 1 if verdict == "block" else 0)


#: The default rule set: the explicit rules, then patterns for hosts and paths that are rarely prose.
EXPLICIT = [explicit("block", "com/en/"), explicit("allow", "example.com/en/7"), explicit("allow", "net/de/"), explicit("block", "example.net/de/8"), explicit("block", "org/es/")]
PATTERNS = [
    *(pattern("block", rf"(?:^|[./_-]){w}(?:$|[./_-])", w) for w in ("casino", "poker", "betting", "porn", "xxx", "torrent", "warez", "viagra", "escort", "phishing")),
    *(pattern("block", rf"/{w}(?:/|\.php|\.html?|$)", w) for w in ("login", "signup", "register", "cart", "checkout")),
    *(pattern("block", rf"^{w}\.", w) for w in ("ads", "adserver", "tracker", "tracking")),
    *(pattern("block", rf"\.{w}$", w) for w in ("exe", "zip", "apk", "iso", "dmg")),
    pattern("block", r"/cgi-bin/", "cgi", "bin"),
]


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host_path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(host_path, F.lit("[A-Za-z0-9]+"), 0))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each token of the rules, over all URLs."""
    seen = urls.select(F.explode(F.array_intersect(tokens(F.concat("host", "path")), F.array(*map(F.lit, wanted)))).alias("t"))
    return dict.fromkeys(wanted, 0) | {r.t: r.n for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row per token of the rules


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rarest token -> rules; rules without a token under ""."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append(r)
    return out


def _entry(r: Rule) -> Column:
    return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).cast("string").alias("rule"), F.lit(r.pattern).alias("pattern"))


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rules = EXPLICIT + PATTERNS if rules is None else rules
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    filed = index(rules, token_counts(urls, wanted) if wanted else {})
    urls = urls.withColumn("_at", F.concat("host", "path"))
    best = F.array_max
    if not filed:
        urls = urls.withColumn("_best", F.lit(None).cast("struct<rank:int,verdict:string,rule:string>"))
    elif len(rules) <= MOST_RULES:
        book = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(_entry, rs)))])
        found = F.flatten(F.filter(F.transform(F.concat(F.array(F.lit("")), tokens(F.col("_at"))), lambda t: book[t]), lambda x: x.isNotNull()))
        fits = F.filter(found, lambda r: F.rlike(F.col("_at"), r["pattern"]))
        urls = urls.withColumn("_best", best(fits))
    else:
        spark = pages.sparkSession
        rows = spark.createDataFrame([(t, r.rank, r.verdict, r.name, r.pattern) for t, rs in filed.items() for r in rs], "t string, rank int, verdict string, rule string, pattern string")
        cand = urls.select("_at").distinct().withColumn("t", F.explode(F.concat(F.array(F.lit("")), tokens(F.col("_at"))))).join(rows, "t").where("_at rlike pattern")
        won = cand.groupBy("_at").agg(F.max(F.struct("rank", "verdict", "rule")).alias("_best"))
        urls = urls.join(won, "_at", "left")
    return urls.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))
