"""The lookup against a plain version on difflib."""

import difflib

from pyspark.sql import functions as F

from quarry.functions.similarity import multiset_compatible
from quarry.functions.text import bare_name, is_placeholder, stem, stray_letter
from quarry.operators.lookup import best_reading, lookup

POOL = ["Ember", "Ember Wave of Dusk", "Bolt", "Grand Bolt", "Fox", "Burning Arrow", "Vast Burning Arrow", "Tide", "Diet", "Storm Call", "Storm Calm", "xab", "aby", "abx", "Long Form Name", "A Long Form Name"]
ASKED = ["ember", "EMBRE", "Ember W", "Gran", "Embr", "Fo", "zzz", "Grnd Bolt", "Burnin Arow", "vast Burnin Arow", "Vas Burnig Arrow", "tied", "Storm Cal", "storm ca", "ab", "abz", "", "Burning Arrow", "Bol", "x Long Form Nme", "a Lng Form Nme"]


def plain(query, pool, cutoff=0.6, margin=0.05):
    low, by = query.lower(), {x.lower(): x for x in sorted(pool)}
    if low in by:
        return by[low], "exact"
    begun = [x for x in by if x.startswith(low)] if len(low) >= min(map(len, by)) else []
    if len(begun) == 1:
        return by[begun[0]], "prefix"
    near = difflib.get_close_matches(low, list(by), n=2, cutoff=cutoff)
    if not near:
        return None, "none"
    score = [difflib.SequenceMatcher(None, low, x).ratio() for x in near]
    if len(near) == 1 or score[0] - score[1] >= margin:
        return by[near[0]], "fuzzy"
    short, long = sorted(near, key=len)
    if long.split()[-len(short.split()) :] == short.split() and long != short:
        extra = " ".join(long.split()[: -len(short.split())])
        return by[long if extra in low else short], "leading words"
    return None, "ambiguous"


def test_lookup_against_difflib(spark):
    asked = ASKED + [p[:i] + p[i + 1 :] for p in POOL for i in range(0, len(p), 2)] + [p[:i] + "q" + p[i:] for p in POOL for i in range(1, len(p), 3)]
    got = {r.query: (r.value, r.status) for r in lookup(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in POOL], "item string")).collect()}
    assert got == {x: plain(x, POOL) for x in asked}
    assert {"exact", "prefix", "fuzzy", "none", "leading words", "ambiguous"} <= {s for _, s in got.values()}
    none = spark.createDataFrame([], "item string")
    assert [r.status for r in lookup(spark.createDataFrame([("a",)], "query string"), none).collect()] == ["none"]


def test_best_reading_against_difflib(spark):
    rows = [["Vast Burning", "Arrow"], ["a2 er", "Storm Call"], ["zzz"], [], ["Ember", "Wave of Dusk"], ["Embr Wave", "of Dsk", "Fox"], ["Bolt", "Bolt"], ["Grand", "Bolt x"], None, ["Tied", "Dite"]]

    def spelled(lines):
        best = (None, None)
        for text in ([" ".join(lines)] if len(lines) > 1 else []) + lines:
            name = plain(text, POOL)[0]
            score = name and difflib.SequenceMatcher(None, text.lower(), name.lower()).ratio()
            if name and (best[1] is None or score > best[1]):
                best = (name, score)
        return best

    df = spark.createDataFrame(list(enumerate(rows)), "id long, lines array<string>")
    got = {r.id: (r.value, r.score) for r in best_reading(df, "id", "lines", spark.createDataFrame([(x,) for x in POOL], "item string")).collect()}
    assert got == {i: spelled(x or []) for i, x in enumerate(rows)} and got[0][0] == "Vast Burning Arrow" and got[1][0] == "Storm Call"


def test_unknown_options_fit_all(spark):
    rows = [(["Unknown", "b"], ["a", "b"], True), (["a or b", "a"], ["a", "b"], False), ([], [], True), (["a"], [], False), (None, ["a"], None), (["b", "b"], ["b", "a"], False), (["a", "b"], ["b or c", "a"], True)]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, want boolean").select("want", multiset_compatible("x", "y").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_text_forms(spark):
    def one(c, x):
        return spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]

    assert [one(bare_name, x) for x in ("Lesser Aim II", "Greater Aim", "Gilded Aim", "Aim III")] == ["Aim", "Aim", "Gilded Aim", "Aim"]
    assert [one(is_placeholder, x) for x in ("Do Nothing", "[DNT] x", "Aim")] == [True, True, False]
    assert [one(stem, x) for x in ("a/b/Icon.PNG", "c\\d\\E.f.dds", "plain")] == ["icon", "e.f", "plain"]
    assert one(lambda c: stray_letter(c, "Prime"), "J  Prime Elm") == "Prime Elm" and one(lambda c: stray_letter(c, "Prime"), "J Elm") == "J Elm"
