"""Secret scans with an incremental blob ledger, DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its bytes). The ledger holds one
row for each (blob, rule version) that was ever scanned, with the spans found in it. A scan
takes the blobs of the given rows, drops those whose pair is in the ledger, scans the rest once
each however many paths and versions share them, appends them to the ledger, and joins findings
back to all paths.

Spans. ``regexp_replace`` wraps each match in marks, ``split`` at the marks gives outside and
inside pieces in turn, and running sums of ``length``, which counts code points, give offsets.
Marks that occur in a text are first changed to another control character of the same length,
which no rule can match.

Defined results: a null text counts as the empty one; null paths and ids pass through; equal
texts share one blob; texts are scanned whole whatever their length; an empty table gives an
empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, text_of

# Fixed values: (kind, pattern as scanned, group whose length counts, least length). The scanned
# form of access and hex has the least length in it, which gives the same leftmost matches
# because their runs are maximal; assign must first match and then be dropped.
BASE_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]
RULE_VERSION = "1"
MARK, OTHER = "\u0001", "\u0002"
STRETCH = 128
LEDGER = "blob string, rule_version string, spans array<struct<start:bigint,rank:int,kind:string,stop:bigint>>, scan string"


def spans_of(text, rule: tuple[str, str, int, int], rank: int) -> F.Column:
    """array<struct<start, rank, kind, stop>> of one rule's matches, in order."""
    kind, pattern, group, least = rule
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,stop:bigint>>)")
    zero = F.lit(0).cast("long")
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  so that value is computed once

    def step(acc, piece):
        length = F.length(piece).cast("long")
        value = F.length(F.regexp_extract(piece, pattern, group)) if group else F.length(piece)
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + length).alias("stop")))
        found = F.when(acc["inside"] & (value >= least), F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct((acc["at"] + length).alias("at"), (~acc["inside"]).alias("inside"), found.alias("found"))

    # stretches of STRETCH pieces, which begin outside: arrays that grow by appending stay short
    def spans(pieces):
        stretch = lambda k: F.slice(pieces, k * STRETCH + 1, F.lit(STRETCH))
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int"))
        sizes = F.transform(numbers, lambda k: F.aggregate(stretch(k), zero, lambda n, piece: n + F.length(piece)))
        starts = F.aggregate(sizes, F.array(zero), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        first = lambda at: F.struct(at.alias("at"), F.lit(False).alias("inside"), empty.alias("found"))
        return bound(starts, lambda at: F.flatten(F.transform(numbers, lambda k: F.aggregate(stretch(k), first(F.get(at, k)), step, lambda acc: acc["found"]))))

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(F.split(marked, MARK), spans)).otherwise(empty)


def blobs_of(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text): every distinct version once. Copies meet map-side first, so a hot version
    sends one row per task."""
    text = text_of(F.col(text_col))
    rows = rows.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    return rows.groupBy("blob").agg(F.first("text").alias("text"))


def scan_blobs(blobs: DataFrame, rules=(*BASE_RULES, *MORE_RULES), version: str = RULE_VERSION) -> DataFrame:
    """(blob, rule_version, spans) with spans in order of start, then of the rules."""
    found = F.concat(*[spans_of(F.col("text"), rule, k) for k, rule in enumerate(rules)])
    return blobs.select("blob", F.lit(version).alias("rule_version"), F.sort_array(found).alias("spans"))


def ledger_at(spark, path: str) -> DataFrame:
    """The ledger that scans have stored under path; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(rows: DataFrame, ledger_dir: str | None = None, text_col: str = "text", rules=(*BASE_RULES, *MORE_RULES), version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, fresh): findings are ``rows`` of any paths and versions with ``_blob`` and
    ``_spans`` added; fresh has the pairs that this scan has added to the ledger.

    The ledger is a Parquet folder to which each scan appends, in the shared folder if ledger_dir
    is None. A scan that a lost executor repeats, or that fails, appends nothing twice: Spark
    commits its files when all are written."""
    spark = rows.sparkSession
    ledger_dir = ledger_dir or f"{shared_dir(spark)}/ledger"
    blobs, known = blobs_of(rows, text_col), ledger_at(spark, ledger_dir).where(F.col("rule_version") == version)
    blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    this = uuid.uuid4().hex
    scan_blobs(blobs, rules, version).withColumn("scan", F.lit(this)).write.mode("append").parquet(ledger_dir)
    ledger = ledger_at(spark, ledger_dir)
    fresh = ledger.where(F.col("scan") == this)
    # only blobs with findings move; paths without one keep an empty list
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0))
    hits = hits.select(F.col("blob").alias("_hit"), F.col("spans").alias("_spans"))
    keyed = rows.withColumn("_blob", F.sha2(text_of(F.col(text_col)), 256))
    found = keyed.join(hits, F.col("_blob") == F.col("_hit"), "left").drop("_hit")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,stop:bigint>>)")
    return found.withColumn("_spans", F.coalesce("_spans", none)), fresh


def digest(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op3_secrets(spark, sf_dir: str, ledger_dir: str | None = None) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger_dir)
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("_spans")).alias("spans"))
