"""Secret scans with an incremental ledger of blobs.

Every version of every text is addressed by its content: its blob is the SHA-256 of its UTF-8 bytes. A ledger is a folder
of runs; a run is a Parquet table with one row per scanned blob: the rule versions that it was scanned with, and the spans
found. A scan reads which (blob, rule version) pairs are known, scans one row of each blob that misses some, by these rules
alone, appends a run, and joins the findings of all runs back to every row. A run counts from the moment its writer has put
its _SUCCESS mark there, so a job that dies leaves nothing half known, and its repetition scans the same pairs.

Texts are never shuffled. Which row of a blob is scanned is settled on hashes of rows. The scan itself is one pass over the
texts in place: where at most FEW blobs are wanted their rows come by a broadcast semi-join, and a table of bits of fixed
size (at most 2^MOST_BITS) tells the rows of more. Bits may say yes for a copy that is not wanted, which costs its scan and
changes nothing, since findings are joined with the wanted blobs; at sizes that fill the table this is a plain scan.

A null text is an empty one. Null keys are keys like others; rows equal in keys and text are scanned once per slice of a
batch and each returned. An empty table gives no rows and writes no run. Very long texts are scanned whole. Columns other
than keys and text are ignored, whatever their names. Spans are in code points, end exclusive, in order of start, then of
the rules as listed, then of end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Bits, Stash, slices
from quarry.runtime import shared_folder, ship

FEW = 100_000
MOST_BITS = 27
SPANS = "array<struct<start:int,end:int,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern, dropped if the group is shorter than `least`. If `needles` are given, a
    text with none of them cannot match. A changed rule takes a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needles: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),  # whole runs of 24 or more: the same as runs of any length, the short ones dropped
)
#: Further public formats: key blocks, signed web tokens, tokens with a vendor's prefix, passwords in addresses, upper-case digests.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=:,\s-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", needles=("PRIVATE KEY-----",)),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needles=("eyJ",)),
    Rule("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", needles=("gh", "glpat-", "xox", "k_live_", "AIza")),
    Rule("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:([^\s/@]+)@", 1, 3, ("://",)),
    Rule("upper_hex", r"\b(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}\b"),
)
RULES = BASE + MORE


def spans(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), r.name) for r, p in rules if not r.needles or any(x in text for x in r.needles) for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]


class Ledger:
    """The runs in a folder that the driver and the executors share; by default a new one in the session's shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = ship(spark)
        self.folder = (folder or f"{shared_folder(spark)}/quarry-ledger-{uuid.uuid4().hex}").rstrip("/")

    def runs(self) -> list[str]:
        """Folders of complete runs; one name per past scan."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(str(x.getPath().getParent()) for x in found)

    def known(self) -> DataFrame:
        """blob, rules, spans: a row for every blob of every run."""
        schema = f"blob binary, rules array<string>, spans {SPANS}"
        return self.spark.read.schema(schema).parquet(*paths) if (paths := self.runs()) else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/run={uuid.uuid4().hex}")

    def wanted(self, ids: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """blob, row (the least row hash of it), missing (the rules that it was never scanned with), of blobs that miss some."""
        every = F.array(*[F.lit(r.name) for r in rules])
        seen = self.known().groupBy(F.col("blob").alias("b")).agg(F.flatten(F.collect_list("rules")).alias("seen"))
        least = ids.groupBy("blob").agg(F.min("row").alias("row")).join(seen, F.col("blob") == F.col("b"), "left")
        missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        return least.select("blob", "row", missing.alias("missing")).where(F.size("missing") > 0)

    def scan(self, versions: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
        """The keys, blob and spans of every row of versions, after scanning what the ledger does not know."""
        stash = Stash(self.spark)
        body = F.coalesce(F.col(text), F.lit(""))
        made = F.unhex(F.sha2(body, 256))
        rows = versions.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], body.alias("body"), made.alias("blob"))
        names = [f"k{i}" for i in range(len(keys))]
        rows = rows.withColumn("row", F.xxhash64("blob", *names))
        ids = stash(rows.select(*names, "blob", "row"), "ids")
        wanted = stash(self.wanted(ids, rules), "wanted")
        sets = wanted.groupBy("missing").agg(F.count("*").alias("n")).collect()  # at most one for each list of rules that past runs had, and one more
        if sets:
            few = sum(x.n for x in sets) <= FEW
            rows = rows.select("body", "blob", "row")
            rows = rows.join(F.broadcast(wanted.select("row").distinct()), "row", "left_semi") if few else rows
            tables = [(x.missing, Bits(wanted.where(F.col("missing") == F.array(*map(F.lit, x.missing))).select("row"), "row", size(x.n))) for x in sets]
            found = scanned(rows, tables, rules).join(wanted.select(F.col("blob").alias("b"), "missing"), (F.col("blob") == F.col("b")) & (F.col("rules") == F.col("missing")))
            self.append(found.select("blob", "rules", "spans").dropDuplicates(["blob"]))
        out = ids.join(self.findings(rules), F.col("blob") == F.col("b"), "left")
        return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """b (blob) and its spans by these rules, in order, of blobs that have any."""
        every = F.array(*[F.lit(r.name) for r in rules])
        each = self.known().select("blob", F.explode("spans").alias("s")).where(F.array_contains(every, F.col("s.rule")))
        key = F.struct(F.col("s.start"), F.array_position(every, F.col("s.rule")).alias("at"), F.col("s.end"), F.col("s.rule"))
        listed = each.groupBy(F.col("blob").alias("b")).agg(F.array_sort(F.collect_set(key)).alias("l"))
        return listed.select("b", F.transform("l", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule"].alias("rule"))).alias("spans"))


def size(n: int) -> int:
    """Bits of a table with 16 places a row, within bounds."""
    return min(max(ceil(log2(16 * n)), 12), MOST_BITS)


def scanned(rows: DataFrame, tables: list[tuple[list[str], Bits]], rules: Sequence[Rule]) -> DataFrame:
    """blob, rules, spans of the rows that a table of bits may hold, each blob of a slice once."""
    schema = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: (r, re.compile(r.pattern, re.ASCII)) for r in rules}
        for whole in it:
            for batch in slices(whole, "body"):
                row, blob = batch.column("row").to_numpy(), batch.column("blob").to_pylist()
                out: list[list] = [[], [], []]
                for names, bits in tables:
                    at = {blob[i]: i for i in np.flatnonzero(bits.has(row)).tolist()}
                    used = [compiled[n] for n in names]
                    for b, i in at.items():
                        out[0].append(b)
                        out[1].append(names)
                        out[2].append([{"start": s, "end": e, "rule": r} for s, e, r in spans(batch.column("body")[i].as_py(), used)])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.select("body", "blob", "row").mapInArrow(run, f"blob binary, rules array<string>, spans {SPANS}")


def digests(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """found with n_<kind> of the base kinds, base_sha256 (of their spans as kind:start:end, comma-joined) and all spans so."""
    kind = lambda s: F.element_at(F.split(s["rule"], "@"), 1)
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.array(*[F.lit(r.kind) for r in base])
    of = lambda r: F.size(F.filter("spans", lambda s: kind(s) == r.kind)).cast("long")
    counts = [of(r).alias(f"n_{r.kind}") for r in base]
    held = F.sha2(shown(F.filter("spans", lambda s: F.array_contains(kinds, kind(s)))), 256)
    return found.select(*[c for c in found.columns if c not in ("blob", "spans")], *counts, held.alias("base_sha256"), shown(F.col("spans")).alias("spans"))
