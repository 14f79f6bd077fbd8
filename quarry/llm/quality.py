"""Quality rules: text statistics and a learned decision list over them.

`statistics` counts over whole texts. `learn_rules` is sequential covering on labelled statistics: each rule is a
conjunction of thresholds, grown by information gain on two thirds of the rows, pruned on the rest, and kept only if it
is precise there; the rows it covers are then removed. `rate` turns the ordered rules into one Spark conditional
expression.

The labelled sample has at most `sample` rows (default SAMPLE), chosen by a hash of doc_id; everything else covers all
rows. Nulls: a null text counts as no words (base_failed); null labels are not used; a null doc_id is rated like any
other. Repeated rows are rated each on their own; of a labelled doc_id with several rows the one of the least statistics
is learned from, and of several labels the worse. An empty table gives no rows; without labels no rule is learned. A
text of any length is counted whole, on its own in memory. Columns of the input are passed through; one that has a name
of a result column, in whatever case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import hash_words, joined_bytes, rolled, runs, slices, split_words

SAMPLE = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct"]
#: Learned from: ratios of the counts.
FEATURES = {
    "n_words": F.col,
    "mean_length": lambda _: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda _: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_line_share": lambda _: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda _: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "upper_share": lambda _: F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
    "digit_share": lambda _: F.col("n_digits") / F.greatest("word_chars", F.lit(1)),
    "bangs_per_word": lambda _: F.col("n_bangs") / F.greatest("n_words", F.lit(1)),
    "distinct_share": lambda _: F.col("n_distinct") / F.greatest("n_words", F.lit(1)),
}
Rule = list[tuple[str, str, float]]

_WINDOW = 5


def repeated_words(h: np.ndarray, window: int = _WINDOW) -> int:
    """Words that lie in a window found twice or more, from the hashes of a text's windows in order."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    return int(np.minimum(np.diff(np.append(at, at[-1] + window)), window).sum())


def counts(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text; a null counts as an empty one."""
    index, words, n_words = split_words(column)
    data, bounds = joined_bytes(column)
    raw, n = data.tobytes(), len(column)
    ends = np.cumsum(n_words)
    begins, hashes = ends - n_words, hash_words(words)[index]
    n_windows = np.maximum(n_words - _WINDOW + 1, 0)
    windows, w_ends = rolled(hashes, runs(begins, n_windows), _WINDOW), np.cumsum(n_windows)
    n_lines, n_dup, n_repeat, n_distinct = (np.zeros(n, np.int64) for _ in range(4))
    newlines = np.diff(np.searchsorted(np.flatnonzero(data == 10), bounds))
    for i in np.flatnonzero(n_words).tolist():
        if newlines[i]:
            lines = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip()]
            n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
        else:
            n_lines[i] = 1
        if n_windows[i] > 1:
            n_repeat[i] = repeated_words(windows[w_ends[i] - n_windows[i] : w_ends[i]])
        mine = index[begins[i] : ends[i]].copy()
        mine.sort()
        n_distinct[i] = 1 + np.count_nonzero(mine[1:] != mine[:-1])

    def having(table: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(table[data]), bounds))

    return [n_words, having(_INK), having(_SYMBOL), n_dup, n_repeat, n_lines, having(_UPPER), having(_DIGIT), having(_BANG), n_distinct]


def _bytes(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: First bytes of code points that are not white space, and of the other classes that are counted.
_INK = ~_bytes([9, 10, 11, 12, 13, 32, *range(128, 192)])
_SYMBOL, _UPPER, _DIGIT, _BANG = _bytes(b"#*$%&|<>"), _bytes(range(65, 91)), _bytes(range(48, 58)), _bytes(b"!")


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or those of `keep`) and COUNTS of `text`."""
    results = {c.lower() for c in COUNTS}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    sent = list(dict.fromkeys([*keep, "text"]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, counts(b.column("text")))], names=[*keep, *COUNTS])

    kinds = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, kinds)


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], least_precision: float = 0.95, most_rules: int = 24, most_tests: int = 4) -> list[Rule]:
    """Ordered conjunctions that mark bad rows. x: rows by features."""
    if not len(x) or not bad.any() or bad.all():
        return []
    tests, masks = [], []
    for j, name in enumerate(names):
        cuts = np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, 41)), np.quantile(x[bad, j], np.linspace(0, 1, 21))]))
        for c in cuts:
            tests += [(name, ">=", float(c)), (name, "<=", float(c))]
            masks += [x[:, j] >= c, x[:, j] <= c]
    m = np.array(masks, np.float32)
    grow = np.arange(len(x)) % 3 != 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and (left & bad & grow).any():
        cover, chosen = left & grow, []
        while len(chosen) < most_tests and (cover & ~bad).any():
            p, n = m @ (cover & bad).astype(np.float32), m @ (cover & ~bad).astype(np.float32)
            p0, n0 = float((cover & bad).sum()), float((cover & ~bad).sum())
            gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0)))
            best = int(np.argmax(gain))
            if gain[best] <= 1e-6:
                break
            chosen.append(best)
            cover &= m[best] > 0
        held = left & ~grow

        def worth(k: int, chosen: list[int] = chosen, held: np.ndarray = held) -> float:
            c = held & (m[chosen[:k]] > 0).all(0)
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if not chosen:
            break
        chosen = chosen[: max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))]
        c = (m[chosen] > 0).all(0) & left
        p, n = (c & bad).sum(), (c & ~bad).sum()
        if p < 3 or p / (p + n) < least_precision or worth(len(chosen)) < 2 * least_precision - 1:
            break
        rules.append([tests[i] for i in chosen])
        left &= ~c
    return rules


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """1-based number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for name, sign, cut in rule:
            holds = holds & (features[name] >= F.lit(cut) if sign == ">=" else features[name] <= F.lit(cut))
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def features() -> dict[str, Column]:
    return {k: f(k).cast("double") for k, f in FEATURES.items()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled documents."""
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `sample` rows of two numbers
    each = statistics(known, ["doc_id", "_quality"]).select("doc_id", F.struct(F.col("_quality").cast("double").alias("q"), *[c.alias(f"f_{k}") for k, c in features().items()]).alias("x"))
    rows = [tuple(r.x) for r in each.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()]  # repeated documents: the least row
    if not rows:
        return []
    x = np.array(rows, float)
    return learn_rules(x[:, 1:], x[:, 0] == 0, list(FEATURES))


def rate(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or those of `keep`), COUNTS, base_failed, rule (number of the rule that rejects, 0: none) and kept."""
    rules = fit(docs, labels, sample) if rules is None else rules
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = {"base_failed", "rule", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    out = statistics(docs, keep).withColumn("base_failed", base).withColumn("rule", verdict(rules, features()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
