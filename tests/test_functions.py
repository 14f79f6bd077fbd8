from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import similarity, text
from quarry.operators.graph import connected_components
from quarry.operators.lookup import cross_check, cull, lookup
from quarry.operators.sequences import longest_run, sections
from quarry.sources import tables


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], kinds).select(column).first()[0]


def test_text(spark):
    s = lambda x: {"x": (x, "string")}
    assert one(spark, text.slugify(F.col("x")), **s(" The Eye, of  Storms! ")) == "the_eye_of_storms"
    assert one(spark, text.deslugify(F.col("x")), **s("eye_of_storms")) == "Eye of Storms"
    assert one(spark, text.title_case(F.col("x")), **s("  grand   bolt-maker ")) == "Grand Bolt-maker"
    assert one(spark, text.first_int(F.col("x")), **s("Level 42 of 50")) == 42
    assert one(spark, text.first_int(F.col("x")), **s("none")) is None
    assert one(spark, text.strip_tier(F.col("x")), **s("Quick Draw III")) == "Quick Draw"
    assert one(spark, text.override_key(F.col("x")), **s(" unlabeled_ab12.png")) == "ab12"
    assert one(spark, text.entered_place(F.col("x")), **s("12:00 : You have entered The Vale.")) == "The Vale"
    assert one(spark, text.repair_article_comma(F.col("x")), **s("Ilka.the Tall")) == "Ilka, the Tall"
    assert one(spark, text.longest(text.word_runs(F.col("x"))), **s("a 12 Ilka the Tall 7 abc")) == "Ilka the Tall"
    assert [one(spark, text.looks_like_name(F.col("x")), **s(x)) for x in ("Ilka", "Al-Rik", "ILKA", "IlkA", "ilka", "Ilka-", "Å")] == [True, True, False, False, False, False, False]
    merged = text.merge_pairs(F.col("x"), F.col("k"))
    assert one(spark, merged, x=(["Gr", "and", "Bolt"], "array<string>"), k=(["Grand"], "array<string>")) == ["Grand", "Bolt"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abcde ", max_size=8), st.text("abcde ", max_size=8)), min_size=1, max_size=20))
def test_ratio_is_the_standard_one(spark, pairs):
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_ratio_is_not_symmetric(spark):
    r = spark.createDataFrame([("tide", "diet")], "a string, b string").select(similarity.ratio("a", "b"), similarity.ratio("b", "a")).first()
    assert r[0] == 0.25 and r[1] == 0.5


def test_multiset_is_greedy(spark):
    rows = [(["a or b", "a"], ["a", "b"], False), (["a", "a or b"], ["a", "b"], True), (["a"], ["a", "a"], False), ([], [], True)]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, want boolean").select("want", similarity.multiset_compatible("x", "y").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_lookup_refuses(spark):
    pool = spark.createDataFrame([("Ember",), ("Ember Wave of Dusk",), ("Bolt",), ("Grand Bolt",), ("Fox",)], "item string")
    q = spark.createDataFrame([(x,) for x in ("ember", "Ember W", "Gran", "Embr", "Fo", "zzz", None, "Grnd Bolt")], "query string")
    got = {r.query: (r.value, r.status) for r in lookup(q, pool).collect()}
    assert got["ember"] == ("Ember", "exact") and got["Ember W"] == ("Ember Wave of Dusk", "prefix") and got["Gran"] == ("Grand Bolt", "prefix")
    assert got["Embr"] == ("Ember", "fuzzy") and got["zzz"] == (None, "none") and None not in got and got["Grnd Bolt"][0] == "Grand Bolt"


def test_cull_and_cross_check(spark):
    c = lambda m, a: one(spark, cull(F.col("m"), F.col("a")), m=(m, "array<string>"), a=(a, "array<string>"))
    assert c(["a", "b"], ["b"]) == ["b"] and c(["a", "b"], ["z"]) == ["a", "b"] and c(["a"], ["z"]) == ["a"] and c(["a", "b"], None) == ["a", "b"]
    x = lambda m, e: one(spark, cross_check(F.col("m"), F.col("e")), m=(m, "string"), e=(e, "array<string>"))
    assert x("a", ["b"]) == "b" and x(None, ["b"]) is None and x("a", ["b", "c"]) == "a"


def test_components_are_wider_than_pairs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (6, 5), (5, 5)], "a long, b long")
    got = dict(map(tuple, connected_components(nodes, edges).collect()))
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert dict(map(tuple, connected_components(nodes, edges.limit(0)).collect())) == {i: i for i in range(8)}


def test_runs(spark):
    rows = [("none", i, False) for i in range(3)] + [("all", i, True) for i in range(3)] + [("two", i, v) for i, v in enumerate([True, True, False, True, True])]
    got = {r.k: (r.start, r.length) for r in longest_run(spark.createDataFrame(rows, "k string, p int, v boolean"), ["k"], ["p"], "v").collect()}
    assert got == {"none": (0, 0), "all": (0, 3), "two": (0, 2)}
    lines = spark.createDataFrame([(1, ["t", "--------", "a", "b", "--------", "c"])], "id int, lines array<string>")
    assert sorted((r.section, r.line) for r in sections(lines, "id", "lines").collect()) == [(0, "t"), (1, "a"), (1, "b"), (2, "c")]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b": 1, "a": 2}')
    (tmp_path / "l.json").write_text('["x", "y"]')
    m = tables.json_map(spark, f"file://{tmp_path}/m.json", "int").orderBy("ord").collect()
    assert [(r.key, r.value) for r in m] == [("b", 1), ("a", 2)]
    assert [r.value for r in tables.json_list(spark, f"file://{tmp_path}/l.json").orderBy("ord").collect()] == ["x", "y"]
    assert tables.json_list(spark, f"file://{tmp_path}/absent.json").count() == 0
    assert one(spark, tables.string_or_list(F.col("x")), x=('["a", "b"]', "string")) == ["a", "b"] and one(spark, tables.string_or_list(F.col("x")), x=("a", "string")) == ["a"]
    path = f"file://{tmp_path}/log"
    tables.append_tsv(spark.createDataFrame([("1", "2")], "a string, b string"), path, "s1")
    tables.append_tsv(spark.createDataFrame([("3", "4")], "a string, b string"), path, "s2")
    tables.append_tsv(spark.createDataFrame([("5",)], "c string"), path, "s3")
    read = lambda p: spark.read.option("sep", "\t").option("header", True).csv(p)
    assert read(path).columns == ["c"] and read(path + ".s3").count() == 2
    docs = spark.createDataFrame([("d1", "generated", "ok"), ("d1", "real", None), ("d2", "real", "r"), ("d2", "generated", "g")], "d string, source string, t string")
    assert {r.d: r.t for r in tables.prefer(docs, "d", "source", "real", F.col("t").isNotNull()).collect()} == {"d1": "ok", "d2": "r"}


def test_streams(spark, tmp_path):
    from quarry.streaming.latest import latest_qualifying, merge_answers

    rows = [(1, "a", 1, 5), (2, "error", 2, 5), (3, "b", 2, 6)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts long, user_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, event_type string, ts long, user_id long").parquet(f"{tmp_path}/in")
    q = latest_qualifying(stream).writeStream.outputMode("complete").format("memory").queryName("latest_q").start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: r.latest for r in spark.table("latest_q").collect()} == {5: "a", 6: "b"}
    answers = spark.createDataFrame([("h", "x"), ("h", "y"), ("k", "z")], "hash string, name string")
    for _ in range(2):
        merge_answers(answers, f"file://{tmp_path}/truth")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/truth").collect())) == [("h", "x"), ("k", "z")]
