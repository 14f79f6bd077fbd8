"""Empty tables, nulls in any column, long texts, repeated rows and columns that clash with names used inside, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import html_text, jaccard_join, mixing, near_vectors, packing, quality, suffix_dedup, token_files, toxicity

ODD = "_text _t _pieces t u a c d lo hi row pieces data key _key node size shape prefix first root component_id tokens p0 p1 p2 p_clean rate copies _s _u _y _terms _words _chars _b_words n_words kept rule base_failed score held_out n_bytes spans Spans KEPT_bytes cell home x i j".split()
TEXT = "some words of a text that is long enough to be looked at by all rules and goes on for a while "
ROWS = [(1, TEXT), (1, TEXT), (None, TEXT + "x"), (2, None), (3, ""), (4, "one"), (5, " ".join(f"w{i}" for i in range(60_000))), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(f"v{i}").alias(f"`{c}`".strip("`")) for i, c in enumerate(dict.fromkeys(c.lower() for c in ODD))]).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "packing": lambda df, labels: packing.pack(df),
    "toxicity": lambda df, labels: toxicity.score(df, labels),
    "token_files": lambda df, labels: token_files.read_tokens(df.sparkSession, token_files.write_tokens(df), with_ids=False),
    "quality": lambda df, labels: quality.rate(df, labels),
    "suffix_dedup": lambda df, labels: suffix_dedup.remove_repeats(df),
    "jaccard": lambda df, labels: jaccard_join.join_components(df),
    "mixing": lambda df, labels: mixing.mix(df, labels),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_operators(odd, labels, name):
    out = RUNS[name](odd, labels)
    rows = out.collect()
    assert len({r.doc_id for r in rows} & {None, 1, 2, 3, 4, 5}) == 6
    assert len(rows) == len(ROWS) if name != "packing" else sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    if name in ("quality", "suffix_dedup", "mixing"):  # these pass columns through
        made = {"quality": [*quality.COUNTS, "base_failed", "rule", "kept"], "suffix_dedup": ["text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"], "mixing": ["tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"]}[name]
        for i, c in enumerate(dict.fromkeys(c.lower() for c in ODD)):
            if c not in made:
                assert all(r[c] == f"v{i}" for r in rows), c
        assert len(set(map(str.lower, out.columns))) == len(out.columns)
    assert RUNS[name](odd.limit(0), labels).count() == 0
    assert RUNS[name](odd.select("doc_id", "text").limit(3), labels.limit(0)).count() > 0


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>a</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == [("", 0), ("a", 1)] and html_text.extract_pages(pages.limit(0)).count() == 0
    big = 1e200
    rows = [(1, [big, big], 0, 1), (2, [big, big * 1.01], 0, 1), (3, [1e-200, 1e-200], 0, 1), (4, [float("inf"), 1.0], 0, 1), (None, None, None, 1), (5, [1.0, 1.0], None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), None: (0, None, True), 5: (0, 5, True)}


def test_near_vector_recall(spark):
    """Links found of all pairs at or above the threshold, most of them close to it, by brute force."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.975, 0.99, 500)[:, None]
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * other])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    want = (v @ v.T >= 0.98).sum() - len(v)
    got = near_vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert want > 500 and want * 0.99 <= got <= want


def test_machine_scores_are_pairwise_sums():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(-0.3, np.arange(10), rng.standard_normal(10).astype(np.float32), rng.standard_normal((10, toxicity.FACTORS)).astype(np.float32))
    sets = [[], [3], [1, 4, 7], list(range(10))]
    got = m.scores(np.array([x for s in sets for x in s], np.int64), np.array(list(map(len, sets))))
    for s, g in zip(sets, got, strict=True):
        z = -0.3 + sum(float(m.w[x]) for x in s) + sum(float(m.v[x].astype(float) @ m.v[y].astype(float)) for i, x in enumerate(s) for y in s[i + 1 :])
        assert abs(g - 1 / (1 + np.exp(-z))) < 1e-9


def test_mixing_without_the_lead_domain(spark):
    soft = spark.createDataFrame([(i, 10, 1e-4, 0.9999, 0.0) for i in range(49)], "id int, tokens long, p0 double, p1 double, p2 double")
    rate, _, left = mixing.fit(soft, mixing.TARGETS)
    assert soft.where(rate < 0.99).count() == 0 and left["clean"] < -0.9  # nothing is dropped for what is not there, and it is told
    with pytest.raises(ValueError):
        mixing.fit(soft, {"clean": 1.0, "low": 0.0, "toxic": 0.0})


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t, None if d == 4 else "en", "s", None) for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0, name
        assert out.count() > 0, name
        assert name == "pack_sequences" or out.columns == corpus_pipeline.COLUMNS, name


def test_near_vector_recall_over_cells(spark):
    """One label with enough vectors that cells are in use: 3,000 planted pairs at cosines of 0.98 to 0.985 among 8,000 vectors."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((8000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    a, other = v[:3000], rng.standard_normal((3000, 64))
    other -= (other * a).sum(1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.9801, 0.985, 3000)[:, None]
    v[3000:6000] = cos * a + np.sqrt(1 - cos * cos) * other
    assert len(v) > 4 * near_vectors.BLOCK  # so that at least two axes make cells
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    want = sum(int((v[i : i + 1000] @ v.T >= 0.98).sum()) for i in range(0, 8000, 1000)) - 8000
    got = near_vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert want >= 6000 and 0.99 * want <= got <= want


def test_url_rules_on_odd_tables(spark):
    from quarry.llm import url_rules

    rows = [(1, "http://Example.com/en/" + "x" * 300_000, "r"), (1, "http://Example.com/en/", "r"), (None, "http://a.org/es/", "r"), (2, None, "r"), (3, "", "r"), (4, "no scheme", "r"), (5, "://HOST?q", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(("host", "path", "verdict", "token", "_url", "tokens"))])
    got = sorted(((r.page_id is None, r.page_id or 0, len(r.path)), r.host, r.rule, r.verdict) for r in url_rules.judge(df).collect())
    assert [x[1:] for x in got] == [("example.com", "com/en/", "block"), ("example.com", "com/en/", "block"), ("", None, got[2][3]), ("", None, got[3][3]), ("", None, got[4][3]), ("host", None, got[5][3]), ("a.org", "org/es/", "block")]
    assert url_rules.judge(df.limit(0)).count() == 0


def test_labels_and_stages_with_clashing_columns(spark, labels, odd, tmp_path):
    more = labels.select("*", *[F.lit(9).alias(c) for c in ("text", "_y", "n", "kept", "score", "p_clean", "tokens")])
    for run in (quality.rate, toxicity.score, mixing.mix):
        plain = sorted(map(str, run(odd.select("doc_id", "text"), labels).collect()))
        assert sorted(map(str, run(odd.select("doc_id", "text"), more).collect())) == plain
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    wide = docs.select("*", *[F.lit(0).alias(c) for c in ("_row", "_id", "_own", "root", "x", "node", "copies", "rate", "kept", "kept_bytes", "n_bytes", "no", "shard")])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, f"file://{tmp_path}")
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert sorted(map(str, out.collect())) == sorted(map(str, stage(spark, docs, f"file://{tmp_path}").collect())), name
