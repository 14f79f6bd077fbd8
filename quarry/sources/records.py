"""Records in folders: discovery by patterns, the preferred document of each record, reference images, raw tables.

Files are listed once per root by Spark's own parallel listing, and patterns are filters on the path, so overlapping patterns
bring no file twice and patterns without a match bring none. Paths are relative to the root, with `/`. A folder that Spark
has written stands for the file of its name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import exists

BLOCK = "struct<item:string,attachments:array<string>>"
# The marks of a sectioned document.
SEPARATOR = "--------"
BUILD = "Build:"
LEVEL = "Mercenary Level"
#: Endings of image files.
IMAGES = ("png", "jpg", "jpeg")


def pattern(glob: str) -> str:
    """A glob as a regular expression; `*` and `?` stay within a folder's name."""
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)


def relative(root: str) -> Column:
    """The path of the row's file below the root, unescaped."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = root.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/").lstrip("/")
    return F.regexp_replace(F.regexp_extract(plain, rf"^[a-z0-9]+:/*(?:[^/]+/)*?{re.escape(below)}/(.*)$", 1), r"\\", "/")


def files(spark: SparkSession, root: str, globs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(dir, file, text): whole texts of the named files in folders that fit one of the globs; bytes that are not UTF-8 become
    replacement characters. No rows if the root is absent."""
    if not exists(spark, root):
        return spark.createDataFrame([], "dir string, file string, text string")
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    form = rf"^({'|'.join(map(pattern, globs))})/({'|'.join(map(re.escape, names))})(?:/part-[^/]*)?$"
    path = relative(root)
    return raw.where(path.rlike(form)).select(F.regexp_extract(path, form, 1).alias("dir"), F.regexp_extract(path, form, 2).alias("file"), F.make_valid_utf8("value").alias("text"))


def packed(archive: DataFrame, globs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The same of an archive that is kept as a table (path, text), many records to a file."""
    form = rf"^({'|'.join(map(pattern, globs))})/({'|'.join(map(re.escape, names))})$"
    return archive.where(F.col("path").rlike(form)).select(F.regexp_extract("path", form, 1).alias("dir"), F.regexp_extract("path", form, 2).alias("file"), F.make_valid_utf8("text").alias("text"))


def parse_document(text: Column, title: str, build: str = BUILD, level: str = LEVEL) -> Column:
    """struct(name, build, level, blocks) of a sectioned document; null unless it has nine lines and the title's line.

    The name is two lines below the title. Blocks are the sections between the third separator and the last one: an item and
    its attachments; empty lines count for nothing."""
    lines = F.split(F.regexp_replace(text, "(\r\n|\n|\r)$", ""), "\r\n|\n|\r")
    at = F.array_position(lines, title).cast("int")
    first = lambda mark: F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))), F.lit(0))
    cut = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")), rf"\n\s*?{SEPARATOR}[^\S\n]*(?=\n)")
    inner = F.when(F.size(cut) > 4, F.slice(cut, F.lit(4), F.size(cut) - 4)).otherwise(F.array().cast("array<string>"))
    rows = F.transform(inner, lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    blocks = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.struct(r[0].alias("item"), F.slice(r, 2, F.greatest(F.size(r), F.lit(1))).alias("attachments")).cast(BLOCK))
    name = F.trim(F.coalesce(F.get(lines, at + 1), F.lit("")))
    after = lambda line, rule: F.trim(F.coalesce(F.regexp_replace(line, rule, ""), F.lit("")))
    made = F.struct(name.alias("name"), after(first(build), f"^{build}").alias("build"), after(first(level), "^[^:]*:").alias("level"), blocks.alias("blocks"))
    return F.when((F.size(lines) >= 9) & (at > 0), made)


def records(spark: SparkSession, root: str, globs: Sequence[str], sources: dict[str, str], title: str) -> DataFrame:
    """(dir, source, name, build, level, blocks): one row per folder that has a document which parses, of the first of the
    sources (file name to source, best first) whose document does."""
    return preferred(files(spark, root, globs, list(sources)), sources, title)


def preferred(found: DataFrame, sources: dict[str, str], title: str) -> DataFrame:
    """The records among (dir, file, text)."""
    order = F.create_map(*[F.lit(x) for i, f in enumerate(sources) for x in (f, i)])
    kind = F.create_map(*[F.lit(x) for f, s in sources.items() for x in (f, s)])
    read = found.select("dir", "file", parse_document(F.col("text"), title).alias("p")).where("p is not null")
    best = read.groupBy("dir").agg(F.min_by(F.struct(kind[F.col("file")].alias("source"), "p"), order[F.col("file")]).alias("x"))
    return best.select("dir", "x.source", "x.p.*")


def reference_images(spark: SparkSession, root: str, categories: Sequence[str], content: bool = False) -> DataFrame:
    """(ord, category, name, path[, content]) of the images right in the folders of the allowed categories, by the order of the
    categories and then of file names. Other folders are not opened, absent ones are no error."""
    there = [c for c in categories if exists(spark, f"{root}/{c}")]
    kind = "ord int, category string, name string, path string" + (", content binary" if content else "")
    if not there:
        return spark.createDataFrame([], kind)
    path = relative(root)
    raw = spark.read.format("binaryFile").load([f"{root}/{c}" for c in there])
    form = rf"(?i)^([^/]+)/([^/]+)\.({'|'.join(IMAGES)})$"
    category = F.regexp_extract(path, form, 1)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    out = raw.where(path.rlike(form)).select(place[category].alias("ord"), category.alias("category"), F.regexp_extract(path, form, 2).alias("name"), path.alias("path"), *(["content"] if content else []))
    return out.orderBy("ord", "path")


def category_of(df: DataFrame, name: str, references: DataFrame) -> DataFrame:
    """df with `category`: that of the first reference of the name, in the references' order; null if there is none."""
    first = references.groupBy(F.col("name").alias("_name")).agg(F.min_by("category", F.struct("ord", "path")).alias("category"))
    return df.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


def labelled_references(references: DataFrame) -> DataFrame:
    """Without the images that nobody has named yet."""
    return references.where(~F.startswith("name", F.lit("unlabeled_")))


def raw_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """JSON tables (a file holds an array of objects) by name, all or none: one error names every file that is missing."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}.json")]
    if missing:
        raise FileNotFoundError(f"{folder}: missing {', '.join(n + '.json' for n in missing)}")
    return {n: spark.read.option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/{n}.json") for n in names}
