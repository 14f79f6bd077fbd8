"""Soft-membership mixing, in DataFrame expressions only.

A classifier learned from the labelled table gives each document a posterior over DOMAINS; it is naive Bayes over the
presence of telling word beginnings and over binned shares of symbols, capitals and distinct words, calibrated on every
fifth labelled document, which it is not learned from. Projected-gradient least squares then fits a nonnegative rate for
every document, so that the expected tokens of each domain, the sum of rate * tokens * posterior, meet their targets. Of
the steered domains (those that the targets name) the one of most weighted tokens leads. Where every other has the tokens
that its weight asks for, relative to the lead, rates are at most 1 and only what is too much is cut. Otherwise rates are
at most `most` (default MOST): the lead's total stays and scarce domains are repeated; a domain that MOST repetitions do
not fill is wanted as far as they do. A domain that the targets do not name is neither cut nor repeated for its own sake.
Shares that are missed by more than MISSED are told in a warning. Documents are summed once, by rounded posteriors; each
step is an aggregate over those sums. Only one number per domain reaches the driver, and a document's rate is an
expression of its posterior and those numbers.

Tokens are white-space separated words. The classifier learns from at most `sample` labelled documents (default SAMPLE,
those of lowest hash; of a repeated doc_id the least row, of several labels the worst), with at most TERMS terms, which
bounds its expression; all else covers all rows. Nulls: a null text is empty, with 0 tokens; null labels are not learned from; a null doc_id is kept.
Repeated rows get a rate each; empty texts too, whatever their length. An empty table gives no rows; without labels all
documents are of the first domain, and the others' targets are missed. If the targets leave no documents, it raises.
Other columns are passed through by `mix`, whatever their names, but those named as results.
"""

from __future__ import annotations

import warnings
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Stash

DOMAINS = ("clean", "low", "toxic")
#: Shares that calibrated posteriors can meet: a document without any sign of it is toxic with 3 % on the tables.
TARGETS = {"clean": 0.92, "low": 0.03, "toxic": 0.05}
SAMPLE = 10_000
TERMS = 400
PREFIX = 5
GRID = 256
STEPS = 40
MOST = 100.0
MISSED = 0.001
HELD_OUT = 5
CALIBRATE = 30
LEAN = 3.0  # a term is some twenty times as frequent in its domain as elsewhere
CUTS = {"symbols": (0.02, 0.1, 0.3, 0.6, 0.9), "capitals": (0.05, 0.15, 0.3, 0.6), "distinct": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8), "words": (5, 10, 30, 100, 300, 1000)}


def features(docs: DataFrame) -> DataFrame:
    """The input's columns with tokens, _terms (distinct word beginnings) and a bin for each of CUTS."""
    text = F.coalesce("text", F.lit(""))
    words = F.split(F.lower(text), "[ \\t-\\r]+")
    out = docs.select("*", words.alias("_words"), F.length(text).alias("_chars"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("_symbols"), F.regexp_count(text, F.lit("[A-Z]")).alias("_capitals"))
    terms = F.array_distinct(F.transform("_words", lambda w: F.substring(w, 1, PREFIX)))
    out = out.withColumn("tokens", F.size(F.array_remove("_words", "")).cast("long")).withColumn("_terms", terms)
    n = F.greatest(F.col("tokens"), F.lit(1))
    share = {"symbols": F.col("_symbols") / n, "capitals": F.col("_capitals") / F.greatest("_chars", F.lit(1)), "distinct": F.size("_terms") / n, "words": F.col("tokens")}
    bins = [sum(((share[name] >= c).cast("int") for c in cuts), F.lit(0)).alias(f"_b_{name}") for name, cuts in CUTS.items()]
    return out.select(*docs.columns, "tokens", "_terms", *bins)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Log priors, log odds of terms and of bins for each domain."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    few = labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.max(domain).alias("_y"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers are sent
    each = features(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")).select("doc_id", F.struct("_y", "_terms", *[f"_b_{k}" for k in CUTS]).alias("x"))
    every = Stash(docs.sparkSession)(each.groupBy("doc_id").agg(F.min("x").alias("x")).select("x.*", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)).alias("_part")), "seen")
    seen = every.where("_part <> 0")
    size = {r._y: r.n for r in seen.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    model = {"prior": [log((size.get(k, 0) + (0.01 if total else k == 0)) / (total + 0.03)) if total or k == 0 else -50.0 for k in range(3)], "terms": [], "bins": {}}
    if not total:
        return model
    n = [size.get(k, 0) for k in range(3)]
    has = [F.count_if(F.col("_y") == k).alias(f"c{k}") for k in range(3)]
    other = lambda k: sum((F.col(f"c{j}") for j in range(3) if j != k), F.lit(0))
    lean = {k: F.log((F.col(f"c{k}") + 0.5) / (n[k] + 1.0)) - F.log((other(k) + 0.5) / (total - n[k] + 1.0)) for k in (1, 2)}
    spread = {k: F.sqrt(1 / (F.col(f"c{k}") + 0.5) + 1 / (other(k) + 0.5)) for k in (1, 2)}
    gain = [F.when((F.col(f"c{k}") >= 4) & (lean[k] >= LEAN), lean[k] / spread[k]).otherwise(0.0) for k in (1, 2)]
    counted = seen.select("_y", F.explode("_terms").alias("term")).groupBy("term").agg(*has).withColumn("gain", F.greatest(*gain))
    for r in counted.where("gain > 0").orderBy(F.desc("gain"), "term").limit(TERMS).collect():
        model["terms"].append((r.term, [(r[f"c{k}"] + 0.5) / (n[k] + 1) for k in range(3)]))
    for name, cuts in CUTS.items():
        got = {r[0]: r for r in seen.groupBy(f"_b_{name}").agg(*has).collect()}
        model["bins"][name] = [[log((got[b][f"c{k}"] + 0.5 if b in got else 0.5) / (n[k] + 0.5 * (len(cuts) + 1))) for k in range(3)] for b in range(len(cuts) + 1)]
    odds = [x - posterior(model)[0] for x in posterior(model)[1:]]
    rows = every.where("_part = 0").select("_y", *[x.alias(f"d{i}") for i, x in enumerate(odds)]).collect()  # a fifth of at most `sample` rows of three numbers
    model["tune"] = calibration([tuple(r) for r in rows])
    return model


def posterior(model: dict) -> list[Column]:
    """A column per domain: its log odds, up to a common term."""
    score = [F.lit(x) for x in model["prior"]]
    if model["terms"]:
        # against the first domain, and held in, since terms of one text are not independent
        held = lambda x: max(-6.0, min(6.0, x))
        odds = {t: [held(log(w[k] / (1 - w[k])) - log(w[0] / (1 - w[0]))) for k in range(3)] for t, w in model["terms"]}
        absent = [held(sum(log((1 - w[k]) / (1 - w[0])) for _, w in model["terms"])) for k in range(3)]
        found = F.array_intersect("_terms", F.array(*[F.lit(t) for t in odds]))

        def total(book: Column) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda s, t: s + book[t])

        for k in (1, 2):
            score[k] = score[k] + F.lit(absent[k]) + total(F.create_map(*[x for t, w in odds.items() for x in (F.lit(t), F.lit(w[k]))]))
    for name, rows in model["bins"].items():
        for k in range(3):
            score[k] = score[k] + F.element_at(F.array(*[F.lit(r[k]) for r in rows]), F.col(f"_b_{name}") + 1)
    if "tune" in model:
        a, *b = model["tune"]
        score = [F.lit(0.0), *((score[k] - score[0]) * a + b[k - 1] for k in (1, 2))]
    return score


def solve(rows: list[list[float]], right: list[float]) -> list[float]:
    """A small linear system by elimination; a column without a pivot gets 0."""
    n = len(right)
    m = [[*map(float, r), float(b)] for r, b in zip(rows, right, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[best] = m[best], m[i]
        if abs(m[i][i]) < 1e-300:
            continue
        for r in range(n):
            if r != i and m[r][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] if abs(m[i][i]) >= 1e-300 else 0.0 for i in range(n)]


def calibration(rows: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """(a, b1, b2) of least log loss for rows (domain, log odds of domains 1 and 2 against 0): odds become a * odds + b. Newton
    steps, drawn to (1, 0, 0) a little so that few rows decide little."""
    t = [1.0, 0.0, 0.0]
    for _ in range(30 if len(rows) >= CALIBRATE else 0):
        grad, hess = [0.5 * (t[0] - 1), 0.05 * t[1], 0.05 * t[2]], [[0.5, 0, 0], [0, 0.05, 0], [0, 0, 0.05]]
        for y, d1, d2 in rows:
            x = ((d1, 1.0, 0.0), (d2, 0.0, 1.0))
            l = [0.0, *(sum(u * v for u, v in zip(t, f, strict=True)) for f in x)]
            top = max(l)
            e = [exp(v - top) for v in l]
            pi = [v / sum(e) for v in e][1:]
            mean = [pi[0] * u + pi[1] * v for u, v in zip(*x, strict=True)]
            for i in range(3):
                grad[i] += mean[i] - (x[y - 1][i] if y else 0.0)
                for j in range(3):
                    hess[i][j] += pi[0] * x[0][i] * x[0][j] + pi[1] * x[1][i] * x[1][j] - mean[i] * mean[j]
        step = solve(hess, grad)
        size = max(1.0, max(map(abs, step)) / 2)
        t = [max(v - d / size, 0.02) if i == 0 else v - d / size for i, (v, d) in enumerate(zip(t, step, strict=True))]
        if max(map(abs, step)) < 1e-6:
            break
    return t[0], t[1], t[2]


def fit(soft: DataFrame, targets: dict[str, float], most: float | None = None, steps: int = STEPS, close: float = 1e-7) -> tuple[Column, list[list[float]], dict[str, float]]:
    """The rate of a document as an expression of p0..p2, the misses of each step (shares of the tokens kept), and what the
    shares of the steered domains then differ by from the targets.

    Documents are summed once by posteriors rounded to 1 / GRID: at most GRID^2 / 2 rows of exact sums, on which all steps
    run. Rates are the projection of 1 - (a combination of the domains' posteriors) onto [0, most], with one number per
    domain; a step moves those numbers by the misses over the derivatives of the totals in them (damped, the best of a few).
    """
    steered = [k for k, d in enumerate(DOMAINS) if d in targets]
    w = {k: targets[DOMAINS[k]] for k in steered}
    g = [F.round(F.col(f"p{k}") * GRID) / GRID for k in range(3)]
    bins = soft.groupBy(*[g[k].alias(f"g{k}") for k in range(3)]).agg(*[F.sum(F.col("tokens") * F.col(f"p{k}")).alias(f"m{k}") for k in range(3)])
    bins = Stash(soft.sparkSession)(bins, "bins")
    mass = dict(zip(steered, sums(bins, [F.lit(1.0) * F.col(f"m{k}") for k in steered]), strict=True))
    lead = max(steered, key=lambda k: (w[k] * mass[k], w[k]))
    if sum(mass.values()) > 0 and not w[lead] * mass[lead]:
        raise ValueError("no document is of a domain whose target is above 0")
    whole = {k: w[k] / w[lead] * mass[lead] if w[lead] else 0.0 for k in steered}
    spare = most is None and all(mass[k] >= whole[k] for k in steered)
    found = descend(bins, steered, lead, mass, whole, 1.0 if spare else MOST if most is None else most, spare, steps, close)
    kept = sum(found[3])
    if spare and kept < sum(mass.values()) and (kept < 1e-3 * sum(mass.values()) or max(abs(x / kept - w[k] / sum(w.values())) for k, x in zip(steered, found[3], strict=True)) > MISSED):
        # cutting alone cannot reach the shares, or only by keeping nothing: come as near as totals allow
        found = descend(bins, steered, lead, mass, whole, 1.0, False, steps, close)
    rates, y, history, now = found
    if sum(mass.values()) > 0 and sum(now) < 1e-3 * sum(mass.values()):
        raise ValueError("no document is of a domain whose target is above 0, as far as posteriors tell")
    return rates(g, y), history, {DOMAINS[k]: (x / sum(now) if sum(now) else 0.0) - w[k] / sum(w.values()) for k, x in zip(steered, now, strict=True)}


def descend(bins: DataFrame, steered: list[int], lead: int, mass: dict[int, float], whole: dict[int, float], most: float, spare: bool, steps: int, close: float) -> tuple:
    """(rates as a function of posteriors and numbers, the numbers, misses by step, tokens of the steered domains). spare: only
    shares count, relative to what is kept of the lead; else the totals in `whole`, as far as `most` allows."""
    goal = {k: min(whole[k], most * mass[k]) for k in steered}
    used = [k for k in steered if mass[k] > 0 and not (spare and k == lead)]
    ratio = {k: goal[k] / mass[lead] if spare else 0.0 for k in used}  # of the lead's tokens as they are kept

    def part(at: list[Column], k: int) -> Column:
        return at[k] - ratio[k] * at[lead]

    def rates(at: list[Column], y: list[float]) -> Column:
        free = 1.0 - sum((part(at, k) * v for k, v in zip(used, y, strict=True)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), free))

    held, own = [F.col(f"g{k}") for k in range(3)], [F.col(f"m{k}") for k in range(3)]

    def totals(many: list[list[float]]) -> list[tuple[list[float], list[float]]]:
        """(misses of the used domains, tokens of the steered ones) for each choice of numbers, in one aggregate."""
        asked = [rates(held, y) * part(own, k) for y in many for k in used] + [rates(held, y) * own[k] for y in many for k in steered]
        got, n = sums(bins, asked), len(used)
        missed = [[x - (0.0 if spare else goal[k]) for x, k in zip(got[i * n : i * n + n], used, strict=True)] for i in range(len(many))]
        rest = got[len(many) * n :]
        return [(missed[i], rest[i * len(steered) : (i + 1) * len(steered)]) for i in range(len(many))]

    y, history = [0.0] * len(used), []
    miss, now = totals([y])[0]
    for step in range(steps + 1):
        history.append([m / max(sum(now), 1e-9) for m in miss] or [0.0])
        if step == steps or max(map(abs, history[-1])) < close:
            break
        # a rate at a bound takes part if the step leads it inside
        free, inward = 1.0 - sum((part(held, k) * v for k, v in zip(used, y, strict=True)), F.lit(0.0)), sum((part(held, k) * m for k, m in zip(used, miss, strict=True)), F.lit(0.0))
        moves = ((free > 0) & (free < most)) | ((free >= most) & (free < most + 1e-9) & (inward > 0)) | ((free <= 0) & (free > -1e-9) & (inward < 0))
        n = len(used)
        flat = sums(bins, [F.when(moves, -part(held, j) * part(own, k)).otherwise(0.0) for k in used for j in used])
        jac = [flat[i * n : i * n + n] for i in range(n)]
        square = [[sum(jac[k][i] * jac[k][j] for k in range(n)) for j in range(n)] for i in range(n)]
        slope = [-sum(jac[k][i] * miss[k] for k in range(n)) for i in range(n)]
        size = max((square[i][i] for i in range(n)), default=0.0)
        tried = []
        for damp in (1e-12, 1e-6, 1e-3, 1e-1, 10.0):
            move = solve([[x + (damp * size if i == j else 0.0) for j, x in enumerate(row)] for i, row in enumerate(square)], slope)
            tried += [[v + d * cut for v, d in zip(y, move, strict=True)] for cut in (1.0, 0.25)]
        got = totals(tried)
        best = min(range(len(tried)), key=lambda i: sum(m * m for m in got[i][0]))
        if sum(m * m for m in got[best][0]) >= (1 - 1e-6) * sum(m * m for m in miss):
            break  # no step comes nearer: the targets cannot be met, or are
        y, (miss, now) = tried[best], got[best]
    return rates, y, history, now


def sums(rows: DataFrame, columns: list[Column]) -> list[float]:
    got = rows.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first() if columns else []
    return [float(x or 0.0) for x in got]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """The input's columns, tokens, p_<domain>, rate, and copies: the rate rounded at random by a hash of the document."""
    stash = Stash(docs.sparkSession)
    made = ["tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    keep = [c for c in docs.columns if c.lower() not in made]
    seed = F.xxhash64(*[F.col(c) for c in docs.columns if c.lower() in ("doc_id", "text")])
    # the input's columns travel in one, so that none can clash with a name that is used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"), (F.pmod(seed, F.lit(1 << 20)) / (1 << 20)).alias("u"))
    scored = features(rows).withColumn("_s", F.array(*posterior(learn(docs, labels, sample))))
    top = F.array_max("_s")
    scored = scored.withColumn("_s", F.transform("_s", lambda x: F.exp(x - top)))
    all_ = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x)
    scored = scored.withColumn("_s", F.transform("_s", lambda x: x / all_)).select("row", "u", "tokens", *[F.col("_s")[k].alias(f"p{k}") for k in range(3)])
    soft = stash(scored, "soft")
    rate, _, left = fit(soft, targets or TARGETS, most)
    if max(map(abs, left.values())) > MISSED:
        warnings.warn(f"mixing: shares differ from their targets by {', '.join(f'{d} {x:+.4f}' for d, x in left.items())}", stacklevel=2)
    rate = F.bround(rate, 3)
    return soft.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate.alias("rate"), F.floor(rate + F.col("u")).cast("int").alias("copies"))
