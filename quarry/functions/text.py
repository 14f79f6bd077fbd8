"""Column expressions for noisy text: glyphs, titles, slugs, tiers, keys, word runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = {1: "I", 2: "II", 3: "III"}


def normalize_name(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slugify(c: Column) -> Column:
    """Runs of anything but letters and digits become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def deslugify(c: Column) -> Column:
    """Words of a slug with capitals, except "of"."""
    word = lambda w: F.when(w == "of", w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.split(c, "_"), word), " ")


def title_case(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(c), r"\s+", " "))


def straight_quotes(c: Column) -> Column:
    """Curly quotes and replacement characters to the apostrophe."""
    return F.translate(c, "‘’�", "'''")


def repair_article_comma(c: Column) -> Column:
    """A comma or full stop run into "the" or "of" gets one comma and a space."""
    return F.regexp_replace(c, r"(?i)(\w)\s*[.,]\s*(the|of)\b", "$1, $2")


def word_runs(c: Column) -> Column:
    """All runs of letters with inner punctuation."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z,.\-' ]*[A-Za-z]"), 0)


def longest(runs: Column) -> Column:
    """Longest string of an array, the first of equals."""
    return F.aggregate(runs, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def looks_like_name(c: Column) -> Column:
    """A capital first, not all capitals after it, inner capitals only after a hyphen, letters at both ends."""
    shape = c.rlike(r"^[A-Z](?:[A-Za-z'\-]*[A-Za-z])?$")
    return shape & ~(c.rlike(r"^[A-Z][A-Z'\-]*[A-Z][A-Z'\-]*$")) & ~c.rlike(r"[^\-][A-Z]")


def split_qualifier(c: Column, word: str) -> tuple[Column, Column]:
    """(qualifier or null, base) of "word base", ignoring case."""
    has = c.rlike(rf"(?i)^{word}\s+")
    return F.when(has, F.lit(word)), F.regexp_replace(c, rf"(?i)^{word}\s+", "")


def join_qualifier(q: Column, base: Column) -> Column:
    return F.concat_ws(" ", q, base)


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")


def is_placeholder(c: Column) -> Column:
    """Entries of a pool that stand for nothing."""
    return (c == "Do Nothing") | c.rlike(r"^\[DNT\]")


def bare_name(c: Column) -> Column:
    """Without a leading Lesser or Greater and a trailing I, II or III."""
    return F.regexp_replace(F.regexp_replace(c, r"^(Lesser|Greater) ", ""), r" (I|II|III)$", "")


def stem(c: Column) -> Column:
    """The last part of a path without its extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def stray_letter(c: Column, word: str) -> Column:
    """Without one letter read before the word."""
    return F.regexp_replace(c, rf"^[A-Za-z]\s+(?={word}\b)", "")


def strip_tier(c: Column) -> Column:
    """Without a trailing I, II or III."""
    return F.regexp_replace(c, r" (I|II|III)$", "")


def tier_roman(c: Column) -> Column:
    """1 to 3 as Roman, other numbers as digits, null as empty."""
    return F.coalesce(F.when(c == 1, "I").when(c == 2, "II").when(c == 3, "III").otherwise(c.cast("string")), F.lit(""))


def display_name(name: Column, tier: Column) -> Column:
    return F.trim(F.concat_ws(" ", name, tier_roman(tier)))


def parse_display(c: Column) -> tuple[Column, Column]:
    """(name, tier) of "name (Tier: n)"; nulls if it has another form."""
    form = r"^(.*) \(Tier: (\d+)\)$"
    ok = c.rlike(form)
    return F.when(ok, F.regexp_extract(c, form, 1)), F.when(ok, F.regexp_extract(c, form, 2).cast("int"))


def observed_key(icon: Column, tier: Column) -> Column:
    return F.concat_ws("_", icon, F.lower(tier))


def split_key(c: Column) -> tuple[Column, Column]:
    return F.regexp_extract(c, "^(.*)_([^_]+)$", 1), F.regexp_extract(c, "^(.*)_([^_]+)$", 2)


def override_key(c: Column) -> Column:
    """Without the prefix and suffix of an unlabelled file's name."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^unlabeled_", ""), r"\.png$", "")


def options(c: Column) -> Column:
    return F.split(c, " or ")


def pad(items: Column, n: int) -> Column:
    """Exactly n strings: cut, or filled with empty ones."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(""), n)), 1, n)


def entered_place(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r": You have entered (.+)\.\s*$", 1), F.lit(""))


def merge_pairs(tokens: Column, known: Column) -> Column:
    """Left to right, two neighbours whose concatenation is known become one."""
    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, w)
        can = (F.size(acc) > 0) & F.array_contains(known, joined)
        return F.when(can, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)
