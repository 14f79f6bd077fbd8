"""Secret ledger, vector codes and prefix tries against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import prefix_trie, secret_ledger, vector_codes

TABLES = "/root/testdata/sf0.01"


# --- secrets -------------------------------------------------------------------------------------------------------------

# The contract's patterns, in the order of listing.
KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def base_row(text):
    got = base_spans(text)
    n = Counter(x.split(":")[0] for x in got)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(got).encode()).hexdigest()


KEY = "-----BEGIN RSA PRIVATE KEY-----\nabc+/=\n-----END RSA PRIVATE KEY-----"
TEXTS = [
    (1, "é token=token:abcdefgh and Token = 'abcde' and TOKEN: \"abcdef\""),
    (2, None),
    (3, ""),
    (4, "AKIA" + "A" * 16 + " AKIAAKIA1 " + "AKIA" + "Z9" * 8 + "x"),
    (5, "ab12" * 6 + " " + "ab12" * 5 + "abc " + "f" * 200),
    (6, "ſecret=abcdefgh K api_Key=abcdefgh api_key==abcdef apikey:=x"),
    (7, KEY + " ghp_" + "Ab1Z" * 9 + " postgres://user:hunter22@host/db eyJabcdefghijk.eyJabcdefghijk.abcdefghijk"),
    (7, KEY),
    (7, KEY),
    (None, "secret: aaaaaa"),
    (8, "x " * 100_000 + "password=longlong"),
]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame([(d, t, "b", 1, "s") for d, t in TEXTS], "doc_id long, text string, blob string, row int, spans string").repartition(3)


def test_secrets_equal_brute_force(spark, versions):
    got = secret_ledger.digests(secret_ledger.Ledger(spark).scan(versions)).collect()
    want = Counter((d, *base_row(t)) for d, t in TEXTS)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    spans = {(r.doc_id, r.spans) for r in got}
    assert {s for d, s in spans if d == 1} == {",".join(base_spans(TEXTS[0][1]))}
    more = next(s for d, s in spans if d == 7 and "vendor" in s)
    assert [x.split(":")[0] for x in more.split(",")] == ["private_key", "vendor", "login", "web_token"]
    start, end = next(x.split(":")[1:] for x in more.split(",") if x.startswith("private_key"))
    assert TEXTS[6][1][int(start) : int(end)] == KEY


@pytest.mark.skipif(not __import__("os").path.isdir(TABLES), reason="tables absent")
def test_secrets_of_all_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_ledger.digests(secret_ledger.Ledger(spark).scan(docs)).collect()}
    assert got == {r.doc_id: base_row(r.text) for r in docs.collect()}


def test_ledger_scans_only_unseen_pairs(spark, versions, monkeypatch, tmp_path):
    ledger = secret_ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(versions, rules=secret_ledger.BASE).count()
    assert len(ledger.runs()) == 1
    blobs = len({t or "" for _, t in TEXTS})
    assert ledger.known().count() == blobs
    ledger.scan(versions, rules=secret_ledger.BASE).count()
    assert len(ledger.runs()) == 1  # nothing new, nothing scanned
    new = versions.limit(0).unionByName(spark.createDataFrame([(9, "token=abcdefg"), (10, KEY)], "doc_id long, text string"), allowMissingColumns=True).unionByName(versions)
    out = ledger.scan(new, rules=secret_ledger.BASE)
    assert ledger.known().count() == blobs + 1 and out.count() == len(TEXTS) + 2  # the key block is an old blob under a new path
    changed = (*secret_ledger.BASE[:2], secret_ledger.Rule("hex", r"[0-9a-f]{150,}", version=2))
    spans = {r.doc_id: [s.rule for s in r.spans] for r in ledger.scan(new, rules=changed).collect()}
    last = [r for r in ledger.known().collect() if r.rules == ["hex@2"]]
    assert len(last) == blobs + 1 and spans[5] == ["hex@2"] and spans[4] == ["access@1", "access@1"]  # old findings of other rules stay
    (tmp_path / "ledger" / "run=broken").mkdir()  # a run without its mark does not count
    assert len(ledger.runs()) == 3
    monkeypatch.setattr(secret_ledger, "FEW", 0)  # the table of bits alone
    monkeypatch.setattr(secret_ledger, "size", lambda n: 6)  # which says yes for nearly all rows
    again = secret_ledger.Ledger(spark, f"file://{tmp_path}/other")
    again.scan(new, rules=secret_ledger.BASE).count()
    assert {r.doc_id: [s.rule for s in r.spans] for r in again.scan(new, rules=changed).collect()} == spans
    assert {tuple(r.rules) for r in again.known().collect()} == {("assign@1", "access@1", "hex@1"), ("hex@2",)}


def test_ledger_of_nothing_and_of_copies(spark, versions):
    ledger = secret_ledger.Ledger(spark)
    assert ledger.scan(versions.limit(0)).count() == 0 and ledger.runs() == []
    many = spark.range(5000).select((F.col("id") % 3).alias("a"), F.lit("token=abcdefg").alias("b"))
    assert ledger.scan(many, keys=["a"], text="b").where(F.size("spans") == 1).count() == 5000 and ledger.known().count() == 1


# --- vector codes --------------------------------------------------------------------------------------------------------


def coded(rows, entries=16, rounds=6, parts=8):
    """Plain loops over (vec_id, list or None, label)."""
    kept = [(v, [min(max(int(np.floor(float(c) * 4096)), -vector_codes.limit(len(x))), vector_codes.limit(len(x))) for c in x], l) for v, x, l in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda x, m: x[m * w : (m + 1) * w]
    books = [[cut(x, m) for _, x, _ in kept[:entries]] for m in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for m in range(parts):
            of = defaultdict(list)
            for _, x, _ in kept:
                of[near(cut(x, m), books[m])[1]].append(cut(x, m))
            books[m] = [[sum(c) // len(of[i]) for c in zip(*of[i], strict=True)] if i in of else e for i, e in enumerate(books[m])]
    out, by_label = [], defaultdict(int)
    for v, x, l in kept:
        found = [near(cut(x, m), books[m]) for m in range(parts)]
        out.append((v, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), l))
        by_label[l] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((v, c, e, by_label[l], sha) for v, c, e, l in out)


def answer(df):
    return Counter(tuple(r) for r in vector_codes.compress(df)[0].select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in np.float32(rng.standard_normal(16))], int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(400)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[5][1], 9), (1000, None, 1), (1001, [], 1), (1002, [1.0] * 15 + [None], 2), (1003, [float("nan")] * 16, 2), (1004, [float("-inf")] * 16, 2), (1005, [1e30, -1e30] * 8, 2), (None, None, None)]
    df = spark.createDataFrame([(v, x, l, "c", 1) for v, x, l in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    assert answer(df) == coded(rows)
    assert answer(df.where("vec_id < 5")) == coded([r for r in rows if r[0] is not None and r[0] < 5])  # fewer vectors than entries
    other = df.unionByName(spark.createDataFrame([(2000, [1.0] * 8, 1), (2001, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int"), allowMissingColumns=True)
    assert answer(other) == answer(df)
    for none in (df.limit(0), df.where("embedding is null")):
        out, books = vector_codes.compress(none)
        assert out.count() == 0 and books is None


def test_vector_codes_ties_and_decoding(spark):
    df = spark.createDataFrame([(i, [float(i % 4)] * 8, 0) for i in range(100)], "vec_id long, embedding array<double>, label int")
    out, books = vector_codes.compress(df)
    assert out.agg(F.sum("error")).first()[0] == 0 and {r.code for r in out.select("code").distinct().collect()} == {f"{i:02x}" * 8 for i in range(4)}  # equal entries: the lowest index
    near = vector_codes.decode(out, books).join(df, "vec_id")
    assert near.where("approximate <> embedding").count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(TABLES), reason="tables absent")
def test_vector_codes_of_all_embeddings(spark):
    df = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    assert answer(df) == coded([(r.vec_id, r.embedding, r.label) for r in df.collect()])


# --- prefix trie ---------------------------------------------------------------------------------------------------------


def trie(rows):
    """Nodes by plain dictionaries, of rows (conv_id, turn, role, text) without ties in turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return Counter((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha(p)) for p in members)


def nodes(df):
    return Counter(tuple(r) for r in prefix_trie.build(df)[0].collect())


def chats(n=900, seed=4):
    """Conversations that share openings, with nulls, one long one, copies, and groups without their base."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        if c % 100 == 0 and c % 300:
            continue  # this group has no base
        kind = int(rng.integers(4))
        turns = [("user", "hello"), ("assistant", "é" * 3)] if kind else []
        turns += [("user", "same")] * int(rng.integers(0, 3)) if kind == 2 else []
        turns += [("user", f"t{rng.integers(3)}") for _ in range(int(rng.integers(0, 5)))]
        turns = turns or [(None, None)]
        rows += [(c, t if t else None, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(5000, t, "user", "again") for t in range(700)] + [(5001, t, "user", "again") for t in range(650)] + [(5002, t, "user", f"x{t}") for t in range(40)]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, n1 string").repartition(3)
    want = trie(rows)
    assert nodes(df) == want
    for shard, size in ((4, 64), (1 << 20, 1 << 20)):  # nearly all nodes heavy, and none but the root
        monkeypatch.setattr(prefix_trie, "SHARD", shard)
        monkeypatch.setattr(prefix_trie, "FOREST", size)
        monkeypatch.setattr(prefix_trie, "CHUNK", 16)
        assert nodes(df) == want


def test_trie_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes(spark.createDataFrame([], schema)) == Counter()
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], schema)) == Counter()
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 1][:3]  # one turn of its own, and no base
    assert nodes(spark.createDataFrame([(c, 0, "user", "x") for c in turnless], schema)) == trie([(c, 0, "user", "x") for c in turnless])
    same = [(100, 0, "user", "a"), (100, 0, "user", "a"), (100, None, "user", "b")]
    got = nodes(spark.createDataFrame(same, schema))
    assert len(got) == 4 and max(r[1] for r in got) == 3  # repeated rows are turns of their own


def test_louds_bits(spark):
    rows = chats(120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in prefix_trie.build(df)[1].collect():
        n = len(r.conv_id) // 8
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=2 * n + 1)
        assert bits.sum() == n and bits[-1] == 0
        up = prefix_trie.parents(bits)
        assert (np.diff(up) >= 0).all() and (up <= np.arange(n)).all()


@pytest.mark.skipif(not __import__("os").path.isdir(TABLES), reason="tables absent")
def test_trie_of_all_conversations(spark):
    df = spark.read.parquet(f"{TABLES}/conversations.parquet")
    assert nodes(df) == trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
