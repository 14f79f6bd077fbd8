"""The live loop over a crash with a poison record, and state that late rows and restarts do not undo."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.sources.records import parse_document
from quarry.streaming import live
from tests.test_records import TITLE, document, put


def test_live_loop_over_a_crash(spark, tmp_path):
    url = f"file://{tmp_path}"
    for i in range(3):
        put(tmp_path / f"in/a{i}/record.txt", document(f"Name {i}", [("Ember", ["Quick"])]))
    put(tmp_path / "in/poison/record.txt", b"\xff\xfe\x00 nothing")
    put(tmp_path / "in/blank/record.txt", " ")
    parse = lambda c: parse_document(c, TITLE)

    def dies(batch, number):
        raise RuntimeError("executor lost")

    def go(after=None):
        q = live.live_records(spark, f"{url}/in", f"{url}/out", f"{url}/check", parse, {"campaign": "c1"}, after)
        q.awaitTermination()

    with pytest.raises(Exception, match="executor lost"):
        go(dies)  # written, but not committed
    assert spark.read.parquet(f"{url}/out/good").count() == 3
    go()
    good, dead = spark.read.parquet(f"{url}/out/good"), spark.read.parquet(f"{url}/out/dead")
    assert sorted(r.name for r in good.collect()) == ["Name 0", "Name 1", "Name 2"] and {r.campaign for r in good.collect()} == {"c1"}
    assert sorted(r.error for r in dead.collect()) == ["empty", "not a document"]
    put(tmp_path / "in/a3/record.txt", document("Name 3", [("Ember", [])]))
    go()
    go()
    assert sorted(r.name for r in spark.read.parquet(f"{url}/out/good").collect()) == [f"Name {i}" for i in range(4)]
    assert spark.read.parquet(f"{url}/out/dead").count() == 2


def test_isolate(spark):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, None)], "id int, text string")
    got = {r.id: (r.parsed, r.error) for r in live.isolate(df, "text", lambda x: str(1 / (int(x) - 3) if x != "3" else 0)).collect()}
    assert got[1] == ("0", None) and got[2][0] is None and got[2][1].startswith("ValueError") and got[3][1].startswith("TypeError")


def test_latest_place_keeps_state(spark, tmp_path):
    url = f"file://{tmp_path}"
    day = dt.datetime(2026, 1, 1)
    row = lambda u, h, o, text: (u, day + dt.timedelta(hours=h), o, text)
    into = "x : You have entered {}.".format
    batches = [
        [row("a", 5, 1, into("Old Mill")), row("a", 7, 2, into("Cosmic Hideout")), row("b", 1, 3, "nothing"), row("c", 1, 4, into("Fen")), row("c", 1, 5, into("Moor"))],
        [row("a", 4, 9, into("Too Late")), row("c", 1, 3, into("Late Too")), row("b", 2, 6, into("Bog "))],
        [row("a", 6, 1, into("New Mill")), row("b", 1, 9, into("Past"))],
    ]
    schema = "user string, ts timestamp, ord long, text string"
    got = []
    for rows in batches:  # a stream of its own each time: what it knows is in its state store
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{url}/in")
        events = spark.readStream.schema(schema).parquet(f"{url}/in")
        out = live.latest_places(events, "user")
        seen = []
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((r.key, r.place) for r in b.collect())).option("checkpointLocation", f"{url}/state").trigger(availableNow=True).start()  # noqa: B023
        q.awaitTermination()
        got.append(sorted(seen))
    assert got == [[("a", "Old Mill"), ("c", "Moor")], [("b", "Bog")], [("a", "New Mill")]]
    every = spark.read.parquet(f"{url}/in").withColumn("place", F.trim(F.regexp_extract("text", r": You have entered (.+)\.\s*$", 1)))
    plain = every.where("place <> '' and not endswith(place, 'Hideout')").groupBy("user").agg(F.max_by("place", F.struct("ts", "ord")).alias("p"))
    assert {r.user: r.p for r in plain.collect()} == {"a": "New Mill", "b": "Bog", "c": "Moor"}
