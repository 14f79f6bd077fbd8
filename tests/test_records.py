"""Discovery against a plain walk over folders, images by category, raw tables, tails, rebuilt outputs."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import records, sinks, tail

TITLE = "Sample Title"


def document(name, blocks, build="Oak", level="7", title=TITLE):
    rows = ["Item Class: Sample", "Rarity: Normal", title, "--------", name, "--------", f"Build: {build}", *([f"Mercenary Level: {level}"] if level else []), "--------"]
    for item, attached in blocks:
        rows += [item, *attached, "--------"]
    return "\n".join([*rows, "Right click this item to view."])


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def archive(tmp_path):
    good = document("Ilka, the Tall", [("Ember", ["Quick Draw (Tier: 2)", "Long Reach (Tier: 3) or Far Reach (Tier: 3)"]), ("Bolt", [])])
    put(tmp_path / "captures/endgame/20260101_000000/record.txt", good)
    put(tmp_path / "captures/endgame/20260101_000000/record_generated.txt", document("Wrong", [("X", [])]))
    put(tmp_path / "captures/endgame/20260102 a+b%/record_generated.txt", document("Made Up", [("Ember", [])], level=None) + "\n")
    put(tmp_path / "captures/campaign/20260103_000000/record.txt", "too short")
    put(tmp_path / "captures/campaign/20260103_000000/record_generated.txt", good.replace("\n", "\r\n"))
    put(tmp_path / "captures/legacy/20260104_000000/record.txt", good.replace(TITLE, "Other"))
    put(tmp_path / "captures/legacy/20260105_000000/record.txt", good.encode().replace(b"Ilka", b"Il\xffka"))
    put(tmp_path / "captures/legacy/20260105_000000/notes.txt", good)
    put(tmp_path / "captures/pending/20260106_000000/record.txt", good)
    put(tmp_path / "captures/legacy/deep/er/record.txt", good)
    put(tmp_path / "captures/legacy/20260107_000000/record.txt", "")
    return tmp_path


def walked(root, globs, sources):
    """The same by a walk: {dir: (source, name, build, level, blocks)}."""
    out = {}
    for folder in sorted({d for g in globs for d in glob.glob(os.path.join(root, g)) if os.path.isdir(d)}):
        for file, source in sources.items():
            path = os.path.join(folder, file)
            if not os.path.isfile(path):
                continue
            with open(path, encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
            if len(lines) < 9 or TITLE not in lines:
                continue
            sections = [[]]
            for line in lines:
                if line.strip() == "--------":
                    sections.append([])
                elif line.strip():
                    sections[-1].append(line.strip())
            field = lambda mark: next((x.split(":", 1)[1].strip() for x in lines if x.startswith(mark)), "")  # noqa: B023, E731
            out[os.path.relpath(folder, root)] = (source, lines[lines.index(TITLE) + 2].strip(), field("Build:"), field("Mercenary Level"), [(s[0], s[1:]) for s in sections[3:-1] if s])
            break
    return out


SOURCES = {"record.txt": "real", "record_generated.txt": "generated"}


@pytest.mark.parametrize("globs", [["captures/*/*"], ["captures/endgame/*", "captures/campaign/*", "captures/legacy/*"], ["captures/legacy/*", "captures/*/*"], ["captures/campaign/*"], ["captures/none/*"]])
def test_records_equal_a_walk(spark, archive, globs):
    got = {r.dir: (r.source, r.name, r.build, r.level, [(b["item"], b.attachments) for b in r.blocks]) for r in records.records(spark, f"file://{archive}", globs, SOURCES, TITLE).collect()}
    want = walked(str(archive), globs, SOURCES)
    assert got == want
    if globs == ["captures/*/*"]:
        assert len(want) == 5 and {x[0] for x in want.values()} == {"real", "generated"} and "captures/endgame/20260102 a+b%" in want


def test_absent_root(spark, tmp_path):
    assert records.records(spark, f"file://{tmp_path}/no", ["*"], SOURCES, TITLE).count() == 0
    assert records.reference_images(spark, f"file://{tmp_path}", ["gems"]).count() == 0


def test_reference_images(spark, tmp_path):
    for p in ("gems/ruby.png", "gems/amber.JPG", "gems/unlabeled_12.png", "gems/readme.md", "maps/amber.jpeg", "maps/deep/x.png", "pending/ruby.png"):
        put(tmp_path / p, p)
    got = records.reference_images(spark, f"file://{tmp_path}", ["maps", "gems", "absent"], content=True)
    assert [(r.category, r.name, bytes(r.content).decode()) for r in got.collect()] == [("maps", "amber", "maps/amber.jpeg"), ("gems", "amber", "gems/amber.JPG"), ("gems", "ruby", "gems/ruby.png"), ("gems", "unlabeled_12", "gems/unlabeled_12.png")]
    assert records.labelled_references(got).count() == 3
    names = spark.createDataFrame([("amber",), ("ruby",), ("pearl",)], "n string")
    assert {r.n: r.category for r in records.category_of(names, "n", got).collect()} == {"amber": "maps", "ruby": "gems", "pearl": None}


def test_raw_tables(spark, tmp_path):
    put(tmp_path / "builds.json", json.dumps([{"_rid": 1, "Skills1": [3, 4]}, {"_rid": 2, "Skills1": []}]))
    with pytest.raises(FileNotFoundError, match=r"skills.json, counts.json"):
        records.raw_tables(spark, f"file://{tmp_path}", ["builds", "skills", "counts"])
    put(tmp_path / "skills.json", "[]")
    got = records.raw_tables(spark, f"file://{tmp_path}", ["builds"])
    assert {r._rid: r.Skills1 for r in got["builds"].collect()} == {1: [3, 4], 2: []}


def test_tail_reads_only_the_end(spark, tmp_path):
    lines = [f"{i}: You have entered Place {i}é." for i in range(60_000)]
    put(tmp_path / "log.txt", "\n".join(lines))
    put(tmp_path / "small.txt", b"\xffone\ntwo")
    got = tail.read_tail(spark, f"file://{tmp_path}/log.txt", f"{tmp_path}/small.txt", last=200_000).collect()
    data = (tmp_path / "log.txt").read_bytes()[-200_000:]
    assert [r.line for r in sorted((r for r in got if r.path.endswith("log.txt")), key=lambda r: r.line_no)] == data.decode(errors="ignore").splitlines()
    assert [r.line for r in got if r.path.endswith("small.txt")] == ["one", "two"]
    part = tail.TailReader({"path": f"{tmp_path}/log.txt", "bytes": "7"})
    read = []

    class Spy:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    real = tail.opened
    try:
        tail.opened = lambda p: (Spy(real(p)[0]), real(p)[1])
        assert [x[2] for x in part.read(part.partitions()[0])] == [" 59999é."[-6:]] and read == [7]
    finally:
        tail.opened = real


def test_rebuild_survives_a_crash(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    assert sinks.bootstrap(spark, f"{folder}/notes.json") and not sinks.bootstrap(spark, f"{folder}/notes.json", "other")
    (tmp_path / "out" / "notes.json").write_text('{"mine": 1}')
    df = spark.createDataFrame([("b", None, 2), ("a", "x", 1), (None, "y", 3)], "key string, label string, n int")
    order = [F.col("key").asc_nulls_last(), F.desc("n")]
    write = lambda d: {"manifest": lambda p: sinks.write_json_lines(d, p, *order)}
    assert sinks.current(spark, folder) is None
    first = sinks.rebuild(spark, folder, write(df))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{first.removeprefix('file://')}/manifest/part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"key": "a", "label": "x", "n": 1}, {"key": "b", "label": None, "n": 2}, {"key": None, "label": "y", "n": 3}] and "\r" not in text

    def dies(path):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sinks.rebuild(spark, folder, write(df.limit(1)) | {"second": dies})
    assert sinks.current(spark, folder) == first and spark.read.json(f"{first}/manifest").count() == 3
    second = sinks.rebuild(spark, folder, write(df.limit(1)))
    assert sinks.current(spark, folder) == second and spark.read.json(f"{second}/manifest").count() == 1
    assert len(glob.glob(f"{tmp_path}/out/generation=*")) == 2  # the broken one is gone, the last one still there for its readers
    assert (tmp_path / "out" / "notes.json").read_text() == '{"mine": 1}'


def test_json_map_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b"', ["x"], None), (0, "z", [], 1), (1, "é\n", None, 2)], "ord int, name string, pool array<string>, n int")
    sinks.write_json_map(df, f"file://{tmp_path}/map", "name", "ord", note="made")
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/map/part-*"))).replace(b"\0", b"")
    got = json.loads(raw)
    assert list(got) == ["note", "z", "é\n", 'a "b"'] and got["z"] == {"pool": [], "n": 1} and got["é\n"] == {"pool": None, "n": 2} and b"\r" not in raw
    docs = spark.createDataFrame([("r1", ["a", "b"]), ("r2", [])], "id string, lines array<string>")
    sinks.write_documents(docs, f"file://{tmp_path}/docs", "id", "lines")
    assert open(glob.glob(f"{tmp_path}/docs/id=r1/part-*")[0], "rb").read() == b"a\r\nb\r\n"


def test_export_vectors(spark, tmp_path):
    df = spark.createDataFrame([("b", [3.0, 4.0]), ("a", [0.0, 2.0]), ("unlabeled_x", [1.0, 1.0]), ("zero", [0.0, 0.0])], "key string, vec array<float>")
    sinks.export_vectors(df, f"file://{tmp_path}/vec", "key", "vec")
    assert [(r.key, r.vec) for r in spark.read.parquet(f"file://{tmp_path}/vec").orderBy("key").collect()] == [("a", [0.0, 1.0]), ("b", [0.6, 0.8])]


def test_packed_archive(spark, archive):
    """A table of paths and texts gives the records that the folders give."""
    texts = [(os.path.relpath(p, archive), open(p, encoding="utf-8", errors="replace", newline="").read()) for p in glob.glob(f"{archive}/**/*.txt", recursive=True)]
    table = spark.createDataFrame(texts, "path string, text string")
    for globs in (["captures/*/*"], ["captures/campaign/*"], ["captures/none/*"]):
        found = records.preferred(records.packed(table, globs, list(SOURCES)), SOURCES, TITLE)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, records.records(spark, f"file://{archive}", globs, SOURCES, TITLE).collect()))


def test_archive_has_few_files(spark, monkeypatch, tmp_path):
    """The files of an archive do not grow with its records."""
    from quarry.plans import archive as made

    monkeypatch.setattr(made, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert made.record_discovery(spark, "/root/testdata/sf0.01").count() == 65
    assert len(glob.glob(f"{tmp_path}/**/part-*", recursive=True)) < 10
