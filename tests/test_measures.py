"""Shares, spreads and sections on values that lie on a rule's border."""

import itertools
import statistics

from quarry.operators.sequences import sections
from quarry.plans.dimensions import same_item_collision_assign
from quarry.plans.measures import occupancy_filter, sections_roundtrip


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_on_its_floor(spark, tmp_path):
    """A spread of exactly 5 passes a floor of 5, in any order of the rows; other values agree with the standard library."""
    orders = [p for q in ([25, 17, 19, 11], [38, 38, 28, 28], [27, 35, 29, 21]) for p in itertools.permutations(q)]
    other = [[1.5, 20.25, 3.1], [4, 4, 4], [7], [3e9, 3e9 + 14], [1e100, 2e100], [1, 10, 50], [None, 3, 20]]
    rows = [(i, None if v is None else float(v)) for i, q in enumerate([*orders, *other]) for v in q]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.std for r in occupancy_filter(spark, f"file://{tmp_path}").collect()}
    assert {i: got.get(i) for i in range(len(orders)) if got.get(i) != 5.0} == {}
    want = {i + len(orders): statistics.pstdev([v for v in q if v is not None]) for i, q in enumerate(other)}
    assert {i for i in got if i >= len(orders)} == {i for i, v in want.items() if v >= 5}
    assert all(abs(got[i] - v) <= 1e-6 * max(1, v) for i, v in want.items() if v >= 5)


def test_names_stay_out_of_the_window(spark):
    """A slot is numbered before its names are joined: no sorted row holds an array."""
    rows = plan(same_item_collision_assign(spark, "/root/testdata/sf0.001")).splitlines()
    at = next(i for i, x in enumerate(rows) if "Window [" in x)
    deep = rows[at].index("Window [")
    end = next((i for i in range(at + 1, len(rows)) if len(rows[i]) - len(rows[i].lstrip(" :+-")) <= deep), len(rows))
    assert end > at + 1 and not any("names" in x for x in rows[at:end])


def test_sections_need_no_shuffle(spark):
    """Sections are cut within the row: marks at both ends, beside each other, null lines, empty and null documents."""
    rows = [(1, ["--------", "a", "--------", "--------", None, "b", "c", "--------"]), (2, []), (3, None), (4, ["x"]), (5, ["--------"])]
    got = sections(spark.createDataFrame(rows, "id int, lines array<string>"), "id", "lines")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, "a"), (1, 3, 5, "b"), (1, 3, 6, "c"), (4, 0, 0, "x")]
    assert "Window" not in plan(got)


def test_roundtrip_groups_once(spark, tmp_path):
    """Repeated line numbers give the least row; a line number that is no row's place stays; the lines are grouped only once."""
    rows = [(1, 9, 3, 1.0, "A", "F"), (1, 2, 3, 1.0, "R", "O"), (1, 5, 7, 1.0, "N", "O"), (2, 1, 1, 1.0, "N", "F")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    df.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = sections_roundtrip(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, out.collect())) == [(1, 3, "R", "O (Tier: 1)"), (1, 7, "N", "O (Tier: 2)"), (2, 1, "N", "F (Tier: 2)")]
    assert "Window" not in plan(out) and plan(out).count("Aggregate [") == 1 and "Join" not in plan(out)
