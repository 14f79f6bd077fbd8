"""Name spans and the choice between two readings, against plain Python over texts and over all conversations."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import names

DATA = "/root/testdata/sf0.01"
RUN = re.compile(r"[A-Za-z][A-Za-z,.\-' ]*[A-Za-z]")
WORD = r"[A-Z](?:(?:[a-z']|-[A-Za-z])*(?:[a-z]|-[A-Za-z]))?"


def shaped(w):
    """A word: a capital, then lower case, apostrophes and hyphens (a capital may follow a hyphen), and not capitals alone."""
    return re.fullmatch(r"[A-Z](?:[A-Za-z'\-]*[A-Za-z])?", w) and not re.search(r"[^-][A-Z]", w) and not (len(w) > 1 and w[1:].upper() == w[1:])


def brute(text):
    """Every stretch of words of every run that is a pair, or a title that cannot be made longer."""
    text = re.sub(r"([A-Za-z])[.,]\s*(the|of)\b", r"\1, \2", re.sub("[‘’�]", "'", text), flags=re.I)
    found = []
    for run in RUN.findall(text):
        w = run.split()
        title = [bool(shaped(x)) and len(x) > 2 for x in w]
        for i in range(len(w)):
            if w[i].endswith(",") and shaped(w[i][:-1]) and i + 2 < len(w) and w[i + 1].lower() in ("the", "of") and title[i + 2]:
                j = i + 2
                while j < len(w) and title[j]:
                    j += 1
                found.append(" ".join(w[i:j]))
            elif i + 1 < len(w) and shaped(w[i]) and shaped(w[i + 1]) and (i == 0 or w[i - 1].lower() not in ("the", "of")):
                found.append(" ".join(w[i : i + 2]))
    return sorted(found, key=lambda s: (-len(s.split()), -len(s)))


def joined(text, other):
    known, lines = set(other.split()), []
    for line in text.splitlines():
        w, at, out = line.split(), 0, []
        while at < len(w):
            two = at + 1 < len(w) and w[at] + w[at + 1] in known and not known & {w[at], w[at + 1]}
            out.append("".join(w[at : at + 1 + two]))
            at += 1 + two
        lines.append(" ".join(out))
    return "\n".join(lines)


def answer(a, b):
    a, b = (a or "").strip(), (b or "").strip()
    lists = []
    for own, other in ((a, b), (b, a)):
        have = brute(own)
        lists.append(have + [s for s in brute(joined(own, other)) if s not in have] if other else have)
    every = sorted(lists[0] + lists[1], key=lambda s: (-len(s.split()), -len(s)))
    if every:
        for own, other in (lists, lists[::-1]):
            if every[0] in own:
                for s in other:
                    if s != every[0] and s not in own and every[0].startswith(s + " "):
                        return s, "agreed"
        return every[0], "shaped"
    for text in (a, b):
        if RUN.findall(text):
            best = max(RUN.findall(text), key=len)
            return re.sub(r"^[A-Za-z]\s+(?=Prime\b)", "", best), "unshaped"
    return None, "none"


CASES = [
    ("Ilka, the Tall", "Ilka, the Tall Bee"),  # noise in one reading
    ("xx Tavi a, the Diligent", "Tavia, the Dili gent"),  # each has split another word
    ("Pahuto. the Quick-hand", "Zari,the Bardiyan-Born"),
    ("Dramia Falkyn", "WTc DramiaFalkyn"),
    ("Vor rik, the Azadin Cutthroat", ""),
    ("the Azadin Cutthroat of Old Salt", None),
    ("ORB OT Mara Vel", "mara vel"),
    ("a Prime thing", "x"),
    ("", ""),
    (None, "A, the Bo Cee"),
    ("Ann, the Great Old One, of Many Words Ben Dan", "Ann, the Great Old One"),
    ("Cal, the Woe,\nthe Dim Sun", "O’Neil the Grand Élan, the Éa"),
    ("X Y. of Zed Alpha", "The Word, The Other Word"),
]


def test_names_equal_plain_python(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "i int, a string, b string")
    got = names.with_name_answer(df, "a", "b", "Prime")
    assert got.columns == ["i", "a", "b", "name", "status"]
    assert [(r.name, r.status) for r in got.orderBy("i").collect()] == [answer(a, b) for a, b in CASES]
    spans = df.select("i", names.name_spans(F.coalesce("a", F.lit(""))).alias("s")).orderBy("i").collect()
    assert [r.s for r in spans] == [brute(a or "") for a, _ in CASES]
    assert {answer(a, b)[1] for a, b in CASES} == {"shaped", "agreed", "unshaped", "none"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_names_of_all_conversations(spark):
    from quarry.plans import QUERIES
    from quarry.plans.readings import readings

    rows = readings(spark, DATA).collect()
    want = {(r.conv_id, r.turn): answer(r.first, r.second) for r in rows}
    got = {(r.conv_id, r.turn): (r.name, r.status) for r in QUERIES["name_answers"](spark, DATA).collect()}
    assert got == want and {s for _, s in want.values()} >= {"shaped", "agreed", "unshaped"}
    counts = {(r.conv_id, r.turn): (r.n_spans, r.longest) for r in QUERIES["name_shapes"](spark, DATA).collect()}
    assert counts == {(r.conv_id, r.turn): (len(brute(r.first)), (brute(r.first) or [None])[0]) for r in rows}
