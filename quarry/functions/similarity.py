"""Ratcliff-Obershelp ratio and what is built on it (Arrow batches; no built-in has these semantics), and vector products."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import normalize_name


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of a against b; not symmetric. Null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def options_fit(x: Column, y: Column) -> Column:
    """Whether two readings of "a or b" options share one; an Unknown fits all."""
    parts = lambda c: F.transform(F.split(c, " or "), F.trim)
    return (x == "Unknown") | (y == "Unknown") | F.arrays_overlap(parts(x), parts(y))


def multiset_compatible(a: Column | str, b: Column | str) -> Column:
    """Greedy order-free matching of two lists of options: equal length, and each of the first takes the first of the second
    that is left and fits. Null if either list is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def take(rest: Column, x: Column) -> Column:
        at = F.array_position(F.transform(rest, lambda y: options_fit(x, y)), True).cast("int")
        return F.when(at > 0, F.concat(F.slice(rest, 1, at - 1), F.slice(rest, at + 1, F.size(rest)))).otherwise(rest)

    return F.when(a.isNotNull() & b.isNotNull(), (F.size(a) == F.size(b)) & (F.size(F.aggregate(a, b, take)) == 0))


def name_similarity(a: Column, b: Column) -> Column:
    """Ratio of two names by their letters and digits, 0 if one has none."""
    x, y = normalize_name(a), normalize_name(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(ratio(x, y))


def dot(a: Column, b: Column) -> Column:
    """In doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def masked_ncc(t: Column, i: Column, mask: Column) -> Column:
    """Normalised cross-correlation over the places where mask is true."""
    keep = lambda v: F.zip_with(v, mask, lambda x, m: F.when(m, x.cast("double")).otherwise(0.0))
    a, b = keep(t), keep(i)
    low = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(low > 0, dot(a, b) / low).otherwise(0.0)
