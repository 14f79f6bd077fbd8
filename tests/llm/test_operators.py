"""Each operator against a brute-force version, with nulls, empty and repeated rows, ties, empty tables and odd columns."""

import collections
import hashlib
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import html_text, jaccard_join, mixing, near_vectors, packing, quality, suffix_dedup, token_files, toxicity, url_rules
from quarry.llm.tokens import default_tokenizer

RNG = np.random.default_rng(5)
WORDS = ["".join(chr(97 + int(x)) for x in RNG.integers(0, 26, int(RNG.integers(2, 8)))) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(80, 1)
DOCS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.rsplit(" ", 1)[0] + " other"),
    (4, BASE + " " + prose(60, 2)),
    (5, ""),
    (6, None),
    (7, "one two"),
    (8, "ONE  two"),
    (9, prose(6000, 3)),
    (9, "the same id again"),
    (None, prose(30, 4)),
    (11, "é" * 150 + " Ünïcödé"),
    (12, "ab" * 400),
    *((20 + i, prose(70 + i, 10 + i)) for i in range(12)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", len(t or ""), 7, True) for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, kept boolean").repartition(3)


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    pieces = packing.pack(docs, capacity=256).collect()
    want = collections.Counter()
    for d, t in DOCS:
        want[(d, len(ids_of(t, 2)))] += 1
    whole = collections.Counter()
    for p in pieces:
        whole[(p.doc_id, p.doc_tokens)] += p.length
        assert any(d == p.doc_id and crc(ids_of(t, 2)[p.start : p.start + p.length]) == p.ids_crc32 for d, t in DOCS)
    assert whole == collections.Counter({k: k[1] * n for k, n in want.items()})
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(docs.limit(0)).count() == 0


def test_crc_of_suffix():
    data = bytes(RNG.integers(0, 256, 500).astype(np.uint8))
    for cut in (0, 1, 77, 499, 500):
        assert packing.crc_of_suffix(zlib.crc32(data[:cut]), zlib.crc32(data), 500 - cut) == zlib.crc32(data[cut:])


def test_token_files_round_trip(spark, docs):
    rows = token_files.read_tokens(spark, token_files.write_tokens(docs)).orderBy("start").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, crc(r.ids)) for r in rows) == sorted((-1 if d is None else d, crc(ids_of(t, 1))) for d, t in DOCS)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert token_files.read_tokens(spark, token_files.write_tokens(docs.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [9, 16])
def test_huffman(limit):
    counts = np.array([int(1.6**i) for i in range(40)] + [0] * 5 + [1] * 200)
    lens = token_files.code_lengths(counts, limit)
    used = lens[lens > 0].astype(int)
    assert (lens > 0).tolist() == (counts > 0).tolist() and used.max() <= limit and sum(2.0**-n for n in used) <= 1
    ids = RNG.choice(np.flatnonzero(counts), 5000)
    if limit == token_files.LIMIT:
        bits, _, marks = token_files.pack_bits(ids, lens, token_files.canonical(lens))
        assert token_files.unpack_bits(bits, len(ids), marks, *token_files.decode_table(lens)).tolist() == ids.tolist()


def test_html():
    page = "<html><head><title>x</title></head><body><nav><a href=/>Menu</a></nav><header>Site</header><article><h1>T &amp; U</h1><p>First\n  line<br>more<p>Second <b>bold</b></p><aside>side</aside><div class='comments'><p>no</p></div></article><footer>f</footer><script>var a='<p>';</script></body></html>"
    assert html_text.extract(page) == "T & U\n\nFirst line more\n\nSecond bold"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>a</nav>") == ""
    assert html_text.extract("no markup at  all") == "no markup at all"
    assert html_text.extract("<div class='has-sidebar'><div class=content><h2>Head</h2><p>" + "long text here " * 20 + "</p></div><div class='sidebar'>links</div></div>").startswith("Head\n\nlong text")
    assert html_text.extract("<p>cut off <b") == "cut off"


ARTICLE = "<article><h1>Title here</h1><p>" + "Long article text with words. " * 30 + "</p><p>" + "More of it. " * 20 + "</p></article>"
READERS = "<div class='comments'><p>" + "A reader says so. " * 100 + "</p></div>"
WRAPPERS = ["<div class='layout sidebar-right'>%s</div>", "<div class='page-nav-open'>%s</div>", "<div id='print-area'>%s</div>", "<div class='popular'>%s</div>", "<form id='aspnetForm'>%s</form>", "<fieldset>%s</fieldset>", "<form><fieldset class=popular>%s</fieldset></form>", "<div class='comments-open'>%s</div>", "<div role=search>%s</div>", "<header>%s</header>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_with_noisy_names(wrapper):
    want = html_text.extract(f"<body>{ARTICLE}</body>")
    assert want.startswith("Title here\n\nLong article") and want.endswith("More of it.")
    for page in (wrapper % ARTICLE + READERS, wrapper % (ARTICLE + READERS), "<nav><a href=/>x</a></nav>" + wrapper % ARTICLE + "<footer>f</footer>"):
        assert html_text.extract(f"<html><body>{page}</body></html>") == want
    plain = "<div class=content><h2>Head</h2><p>" + "Long text with words. " * 30 + "</p></div>"
    got = html_text.extract("<body><div class=menu><a href=/>m</a></div>" + wrapper % plain + "<div class='related'><a href=/>" + "Other page. " * 9 + "</a></div></body>")
    assert got == "Head\n\n" + ("Long text with words. " * 30).strip()


def test_html_long_and_odd_pages():
    assert len(html_text.extract("<p>" + "word " * 400_000 + "</p>")) == 5 * 400_000 - 1
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.extract("<div class='ad'>buy</div>" + "<p>text</p>" * 3) == "text\n\ntext\n\ntext"
    assert html_text.extract("<form><input value=x><button>go</button></form>") == ""


def test_html_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("a", 1), ("a", 1)]


def test_toxicity_learns_pairs(spark, docs):
    rng, rows = np.random.default_rng(0), []
    for i in range(1200):
        insult, group = bool(rng.integers(2)), bool(rng.integers(2))
        rows.append((i, prose(12, 5000 + i) + " vileword" * insult + " groupname" * group, int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == 1200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    none = toxicity.score(docs, df.select("doc_id", "toxic").limit(0)).collect()
    assert len(none) == len(DOCS) and all(r.predicted == 0 for r in none)


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    rows = [(100 + i, (base[i % 6] + 0.03 * rng.standard_normal(16)).tolist(), i % 2) for i in range(150)]
    rows += [(1, rows[0][1], 0), (2, rows[0][1], 0), (3, None, 0), (4, [0.0] * 16, 0), (5, [float("nan")] * 16, 0), (6, [1.0] * 16, None), (7, [1.0, None], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    df = vectors(spark)
    rows, good = df.collect(), {}
    for r in rows:
        if r.label is not None and r.embedding and None not in r.embedding:
            v = np.array(r.embedding, float)
            if np.isfinite(v).all() and v.any():
                good[r.vec_id] = (r.label, len(v), v / np.sqrt(v @ v))
    links = {i: {j for j in good if j != i and good[i][:2] == good[j][:2] and good[i][2] @ good[j][2] >= 0.98 - 1e-12} for i in good}
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        g = got[r.vec_id]
        assert (g.n_links, g.component_id, g.kept) == (len(links.get(r.vec_id, ())), min(seen), min(seen) == r.vec_id)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def counted(*texts):
    return list(zip(*(x.tolist() for x in quality.counts(pa.array(texts, pa.string()))), strict=True))


def test_quality_counts():
    assert counted("a b c d e a b c d e x")[0][:5] == (11, 11, 0, 0, 10)
    assert counted("x #y\nx #y\n\n \nx #y")[0][:4] == (6, 9, 3, 2)
    assert counted(None)[0][:5] == (0, 0, 0, 0, 0)
    text = " ".join(np.random.default_rng(1).choice(list("abcd"), 200))
    w, hit = text.split(), set()
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(196))
    for i in range(196):
        if times[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    assert counted(text)[0][4] == len(hit)


def count_by_hand(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    hit = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    some = lambda kinds: sum(c in kinds for c in text)
    return (len(words), sum(map(len, words)), some("#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines), some(string.ascii_uppercase), some(string.digits), some("!"), len(set(words)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab A#!9\n\t\x0b\xa0é日 "), max_size=60)), max_size=6))
def test_quality_counts_by_hand(texts):
    assert counted(*texts) == [count_by_hand(t) for t in texts]


def test_quality_rules(spark, docs):
    rows = [(i, prose(40, 900 + i) if i % 4 else " ".join(x + "%%%" for x in prose(40, 900 + i).split()), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.rate(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)
    few = quality.rate(docs, df.select("doc_id", "quality").limit(0)).collect()
    assert len(few) == len(DOCS) and all(r.kept == (not r.base_failed) for r in few)


@pytest.mark.parametrize("slice_,shard,small", [(1 << 17, 1 << 22, 1 << 17), (500, 600, 100)])
def test_suffix_dedup(spark, docs, monkeypatch, slice_, shard, small):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    texts = [(t or "").encode() for _, t in DOCS]
    times = collections.Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    want = []
    for (d, _), b in zip(DOCS, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edges = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((-1 if d is None else d, len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def repeats_by_hand(texts, length):
    times = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("shard,small", [(1 << 22, 1 << 17), (9000, 3000)])
def test_suffix_arrays_of_near_copies(spark, monkeypatch, shard, small):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    rng = np.random.default_rng(8)
    page, form = prose(200, 41).encode(), prose(60, 42).encode()
    texts = []
    for i in range(60):  # copies with bytes changed here and there, and a passage that unlike texts share, cut anywhere
        x = bytearray(page)
        for j in rng.integers(0, len(x), 4).tolist():
            x[j] = 35 + i % 7
        texts.append(bytes(x))
        a, b = sorted(rng.integers(0, len(form), 2).tolist())
        texts.append(prose(20, 300 + i).encode() + b" " + form[a:b] + b" " + prose(20, 400 + i).encode())
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_by_hand(texts, 200)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for k in (2, 3, 200):
        data = rng.integers(0, k, 300).astype(np.uint8)
        data = np.concatenate([data, data[50:180], data[:90]])
        b = data.tobytes()
        sa, rank = suffix_dedup.suffix_array(data)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:]) and (rank[sa] == np.arange(len(b))).all()
        want = [0] + [next((d for d in range(60) if b[i + d : i + d + 1] != b[j + d : j + d + 1] or i + d >= len(b) or j + d >= len(b)), 60) for i, j in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True)]
        assert suffix_dedup.common_prefixes(data, sa, rank, 60, lanes=7).tolist() == want


def test_url_rules(spark, monkeypatch):
    rows = [(1, None), (2, "http://A.COM/en/x"), (3, "nohost"), (None, "https://x.casino.fun/a"), (5, "ftp://sub.example.com/en/77?x"), (6, "http://xexample.com/en/7#t"), (7, "http://example.net/de/81"), (7, "http://example.net/de/9")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = [("", "", None, "allow")] * 2 + [("a.com", "/en/x", "com/en/", "block"), ("x.casino.fun", "/a", None, "block"), ("sub.example.com", "/en/77", "example.com/en/7", "allow"), ("xexample.com", "/en/7", "com/en/", "block"), ("example.net", "/de/81", "example.net/de/8", "block"), ("example.net", "/de/9", "net/de/", "allow")]
    for most in (2000, 1):
        monkeypatch.setattr(url_rules, "MOST_RULES", most)
        assert sorted(map(repr, ((r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).collect()))) == sorted(map(repr, want))
    assert url_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [128, 1])
def test_jaccard(spark, docs, monkeypatch, wide):
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in DOCS]
    got = jaccard_join.join_components(docs).collect()
    want = []
    for i, s in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            a = sets[todo.pop()]
            for j, b in enumerate(sets):
                if j not in seen and a and b and 100 * len(a & b) >= 90 * len(a | b):
                    seen.add(j)
                    todo.append(j)
        names = [DOCS[j][0] for j in seen if DOCS[j][0] is not None]
        want.append((DOCS[i][0], len(s), min(names, default=None)))
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, want))


def test_mixing(spark, docs):
    rows = []
    for i in range(300):
        kind = i % 3
        text = prose(30 + i % 7, 300 + i)
        text = text if kind == 0 else " ".join(x + "%%%" for x in text.split()) if kind == 1 else text + " vileword " * 3
        rows.append((i, text, int(kind != 1), int(kind == 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = mixing.mix(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {"clean": 0.8, "low": 0.15, "toxic": 0.05}).collect()
    low = sum(r.rate * r.tokens * r.p_low for r in got)
    assert abs(low / sum(r.tokens * r.p_clean for r in got) - 0.15 / 0.8) < 0.01  # targets are relative to the largest domain's tokens
    assert all(r.copies == 1 for r in got if r.doc_id % 3 == 0) and all(0 <= r.rate <= 1 for r in got)
    soft = spark.createDataFrame([(1, 10, 0.9, 0.1, 0.0), (2, 20, 0.2, 0.7, 0.1), (3, 5, 0.0, 0.1, 0.9)], "id int, tokens long, p0 double, p1 double, p2 double")
    rng = np.random.default_rng(8)
    p = rng.dirichlet((0.3, 0.2, 0.1), 400)
    t = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p, strict=True))], "id int, tokens long, p0 double, p1 double, p2 double")
    for targets, top in (({"clean": 0.7, "low": 0.2, "toxic": 0.1}, 1.0), ({"clean": 0.3, "low": 0.4, "toxic": 0.3}, 100.0), ({"clean": 0.95, "toxic": 0.05}, 1.0)):
        rate, history, left = mixing.fit(soft, targets)
        r = np.array([x[0] for x in soft.orderBy("id").select(rate).collect()])
        kept = {d: (r * t * p[:, k]).sum() for k, d in enumerate(mixing.DOMAINS) if d in targets}
        assert r.min() >= 0 and r.max() <= top and len(history) <= 20 and max(map(abs, left.values())) < 1e-5
        assert all(abs(x / sum(kept.values()) - targets[d]) < 1e-5 for d, x in kept.items())
    assert mixing.mix(docs, df.select("doc_id", "quality", "toxic").limit(0)).where(F.col("rate") == 1).count() == len(DOCS)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(60, 700 + i), "en", "s", 10) for i in range(40)] + [(100, prose(60, 700), "en", "s", 10), (101, "% % %", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in out} == set(range(40))


def test_pipeline_join_threshold(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")

    def jaccard(a, b, n):
        x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    words = prose(200, 900).split()
    copy = " ".join("changed" if i in (40, 90, 140, 190) else w for i, w in enumerate(words))
    assert 0.8 <= jaccard(" ".join(words), copy, 5) < 0.85 and jaccard(" ".join(words), copy, 3) < 0.9
    rows = [(1, " ".join(words), "en", "s", 1), (2, copy, "en", "s", 1), (3, prose(200, 901), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_join(spark, df, "").collect()) == [1, 3]


def test_mixing_scarce_domain(spark):
    rows = [(i, 10, 0.0, 0.01, 0.99) if i < 4 else (i, 10, 0.99, 0.01, 0.0) for i in range(100)]
    soft = spark.createDataFrame(rows, "id int, tokens long, p0 double, p1 double, p2 double")
    targets = {"clean": 0.5, "low": 0.01, "toxic": 0.5}
    rate, _, left = mixing.fit(soft, targets)
    sums = soft.select(rate.alias("r"), "tokens", "p0", "p2").agg(F.sum(F.expr("r * tokens * p0")), F.sum(F.expr("r * tokens * p2")), F.min("r")).first()
    assert abs(sums[1] / sums[0] - 1) < 0.01 and sums[2] >= 0.9
    assert max(map(abs, left.values())) < 0.01
    # with a bound, or without documents of a domain, what is missed is told against the targets themselves
    assert mixing.fit(soft, targets, most=1.0)[2]["toxic"] < -0.4
    rate, _, left = mixing.fit(soft.where("id >= 4"), targets)
    assert abs(left["toxic"] + 0.5 / 1.01) < 1e-6 and soft.where("id >= 4").where(rate < 0.9).count() == 0


def test_pipeline_join_rows(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    cols = corpus_pipeline.COLUMNS
    more = [(None, prose(30, 950)), (None, prose(30, 950) + " "), (9, BASE), (40, prose(6000, 3))]
    df = docs.select(*cols).union(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in more], docs.select(*cols).schema))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, df, "").collect()]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    rows = [*DOCS, *more]
    sets = [shingles(t) for _, t in rows]
    left, groups = set(range(len(rows))), []
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [j for j in left if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            left -= set(todo)
        groups.append([rows[i] for i in seen])
    assert len(got) == len(groups)
    for g in groups:
        least = min((d for d, _ in g if d is not None), default=None)
        assert sum(x in g for x in got) == 1 and any(x in g and x[0] == least for x in got)


def test_components_settle(spark):
    from quarry.llm.common import Stash, components
    from quarry.operators.graph import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.root for r in components(Stash(spark), edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(Stash(spark), edges, rounds=1)
    nodes = spark.createDataFrame([(i,) for i in range(21)], "id long")
    assert {r.root for r in connected_components(nodes, edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(nodes, edges, rounds=1)


LONG = "the article goes on with a sentence that is long enough to weigh " * 6


@pytest.mark.parametrize(
    "fragment",
    [
        '<a href="/hidden-valley/">Hidden Valley</a>',
        '<span title="a hidden gem">gem</span>',
        '<span data-id="comments">marked</span>',
        '<span data-style="display:none">styled</span>',
        "<a href=/hidden/>unquoted</a>",
        '<span data-hidden="false">not so</span>',
        "<span class=plain id=nothing-hid>named</span>",
        '<span title=\'class="comments"\'>inside a value</span>',
    ],
)
def test_html_attributes_are_whole_names(fragment):
    got = html_text.extract(f"<html><body><div><p>{LONG}{fragment}</p><p>{LONG}</p></div></body></html>")
    assert re.sub("<.*?>", "", fragment) in got


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "aria-hidden = true", 'style="color:red; display : none"', "class='x comments'", "id=sidebar", "role=banner", 'title="a" hidden data-x=1'])
def test_html_attributes_that_hide(attrs):
    got = html_text.extract(f"<html><body><div><p>{LONG}</p><p>{LONG}</p></div><div {attrs}><p>away with it</p></div></body></html>")
    assert LONG.strip() in got and "away" not in got


def test_html_threshold_beyond_the_parent():
    """Without article or main: what stands beside the body path is taken if it is as dense as the path's least element."""
    core = "".join(f"<p>{LONG}</p>" for _ in range(4))
    page = f"<html><body><div><p>{'opening words ' * 60}</p></div><div><div>{core}</div></div><div><a href=x>one</a> <a href=y>two</a> end</div></body></html>"
    got = html_text.extract(page)
    assert got.startswith("opening words") and got.count("long enough") == 24 and "one" not in got


def test_packing_deals_equal_rows(spark):
    """Equal rows without an id are no hot group: the shards' bound holds for them too."""
    from quarry.llm.common import Stash

    n = 3 * packing.SHARD
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words").alias("text"))
    sized = Stash(spark)(packing.measure_documents(same, default_tokenizer(), 2), "sizes")
    per = sized.groupBy(F.pmod(F.xxhash64("doc_id", "n", "crcs", "no"), F.lit(3)).alias("s")).count().collect()
    assert len(per) == 3 and max(r["count"] for r in per) < 1.2 * packing.SHARD
    out = packing.pack(same)
    assert out.count() == n and out.select("sequence_id", "offset").distinct().count() == n


def test_mixing_calibration():
    """Odds that are too sure, and shifted, are set right on rows that they were not learned from."""
    rng = np.random.default_rng(4)
    d = rng.normal(0, 2, (3000, 2))
    p = np.exp(np.column_stack([np.zeros(3000), d]))
    p /= p.sum(1)[:, None]
    y = (p.cumsum(1) < rng.random(3000)[:, None]).sum(1)
    a, b1, b2 = mixing.calibration([(int(k), float(3 * u + 1), float(3 * v - 2)) for k, (u, v) in zip(y, d, strict=True)])
    assert abs(a - 1 / 3) < 0.03 and abs(b1 + 1 / 3) < 0.15 and abs(b2 - 2 / 3) < 0.15
    assert mixing.calibration([(0, 1.0, 1.0)] * 5) == (1.0, 0.0, 0.0)


def test_mixing_targets_out_of_reach(spark):
    """Where cutting cannot reach the shares, the totals come as near as they can and nothing collapses."""
    rows = [(i, 10, 0.9, 0.05, 0.05) for i in range(50)] + [(i, 10, 0.5, 0.0, 0.5) for i in range(50, 60)]
    soft = spark.createDataFrame(rows, "id int, tokens long, p0 double, p1 double, p2 double")
    rate, _, left = mixing.fit(soft, {"clean": 0.98, "low": 0.01, "toxic": 0.01})
    kept = soft.select(F.sum(rate * F.col("tokens"))).first()[0]
    assert left["toxic"] > 0.03 and kept > 300
