"""WARC archives: write, read back, and merge their indexes into capture histories.

Write. A payload's SHA-256 groups equal ones; of equal payloads of at least ``min_revisit``
bytes the capture with the smallest id is a response, the others are revisits that refer to it.
Each task cuts its records into archives of at most ``archive_bytes`` (or one longer record),
each sorted by URL key, timestamp and id: a capture run. Spark's text writer puts records down as
they are, with the blank lines that end a record as its separator, so archives land on any store
that Spark writes to. They are compressed as wholes, and the index gives offsets in what they
hold; with ``compression`` "none" a record can be read at its offset.

Read. Records are found by their Content-Length, never by searching for text that a payload
might contain, and each payload is checked against its digest.

Index merge. Archives are parsed once; the sorted runs of their index lines are written to the
shared folder. Runs are cut at common key ranges of about ``range_lines`` lines, and each range
merges its slices of all runs by a loser tree (k-way, one comparison a level for each line): the
ranges in order are the global capture history. What a task holds is bounded by the range, not by
the data. Ranges are cut by (URL key, timestamp, id, place), so one hot URL spans as many ranges
as it needs.

Defined results: a null html is the empty payload; null URLs have the empty key and sort first;
pages without an id are responses or refer to one like any other, ids that are null sort last;
captures that share both the smallest id and the payload are all responses; payloads of any
length are kept whole; an empty table writes no record and reads none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, text_of

MIN_REVISIT, ARCHIVE_BYTES, RANGE_LINES = 100, 32 << 20, 50_000
CRLF = "\r\n"
VERSION = "WARC/1.1"
INDEX = "url_key string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def url_key(url) -> F.Column:
    """Host labels from the last to the first, then path and query, in lower case without
    scheme, user, port, leading www and fragment: com,example,m)/en/25?a=b"""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text_of(url)), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^[^@]*@|:\d+$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT, stamp_col: str | None = None) -> DataFrame:
    """pages as (page_id, url, stamp, payload, digest, bytes, refers_to). Captures without a
    time of their own are of 1970."""
    payload = text_of(F.col("html"))
    at = F.coalesce(F.col(stamp_col).try_cast("timestamp"), F.timestamp_seconds(F.lit(0))) if stamp_col else F.timestamp_seconds(F.lit(0))
    stamp = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of(F.col("url")).alias("url"), stamp.alias("stamp"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    # only digests that repeat are joined; a hot one is pre-aggregated, and split by AQE in the join
    same = rows.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = same.where("_n > 1 and _first is not null").select(F.col("digest").alias("_digest"), "_first")
    rows = rows.join(same, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def record() -> F.Column:
    """One record's text, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    uri = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    clean = F.regexp_replace("url", r"[\r\n]", "")
    length = F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(VERSION + CRLF), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), field("WARC-Record-ID", uri(F.col("page_id"))),
        field("WARC-Date", F.col("stamp")), field("WARC-Target-URI", clean), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", length.cast("string")), F.lit(CRLF), F.when(revisit, "").otherwise(F.col("payload")),
    )


def _numbered(archive_bytes: int):
    """mapInArrow: a task's records with the number of the archive that each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            ends = at + np.cumsum(pc.binary_length(b.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 4)
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([pa.array(ends // archive_bytes), *b.columns], names=["archive", *b.schema.names])

    return run


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, stamp_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Archives under path, each of bounded size and sorted by URL key, stamp and id. Rows stay in
    the tasks to which the join by digest has dealt them."""
    rows = captures(pages, min_revisit, stamp_col).select(url_key(F.col("url")).alias("key"), "stamp", "page_id", record().alias("value"))
    rows = rows.mapInArrow(_numbered(archive_bytes), "archive long, key string, stamp string, page_id long, value string")
    rows = rows.sortWithinPartitions("archive", "key", "stamp", F.col("page_id").asc_nulls_last()).select("archive", "value")
    rows.write.partitionBy("archive").option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, payload) of each record; ValueError where the archive is not well-formed."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        lines = content[at:head].decode("utf-8").split(CRLF)
        if head < 0 or lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        end = head + 4 + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at its length")
        yield at, fields, content[head + 4 : end]
        at = end + 4


def _number(uri: str | None) -> int | None:
    value = (uri or "")[len("<urn:page:") : -1]
    return int(value) if value else None


def read_index(spark, path: str) -> DataFrame:
    """The index lines of all archives under path, those of an archive in its order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out = []
                for at, f, payload in parse(zlib.decompress(content, 31) if name.endswith(".gz") else content):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(f["X-Payload-Length"])):
                        raise ValueError(f"{name}: the payload at byte {at} differs from its digest")
                    out.append((f["WARC-Date"], _number(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, kind, _number(f.get("WARC-Refers-To")), name, at))
                frame = pd.DataFrame(out, columns=["stamp", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "at"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "at": "int64"})

    schema = "stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"
    return files.mapInPandas(lines, schema).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge of sorted lists of (key, value); inner nodes keep the losers of their match."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.tree = [-1] * self.size
        winners = [-1] * self.size + list(range(len(runs))) + [-1] * (self.size - len(runs))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.size > 1 else (0 if runs else -1)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]][0], self.runs[b][self.at[b]][0]
        return x < y or x == y and a < b

    def __iter__(self):
        while (w := self.tree[0]) >= 0 and self.at[w] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.size) // 2
            while node >= 1:
                if self._before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def _runs(batches: Iterator[pd.DataFrame]) -> list[list]:
    """(key, row) of each slice of a run: rows of one archive, as long as they ascend."""
    last: dict[str, list] = {}
    runs = []
    for b in batches:
        for row in b.itertuples(index=False):
            none = pd.isna(row.page_id)
            key = (row.url_key, row.stamp, none, 0 if none else row.page_id, row.archive, row.at)
            run = last.get(row.archive)
            if run is None or run[-1][0] > key:  # a slice begins, or a block of it that came out of turn
                run = last[row.archive] = []
                runs.append(run)
            run.append((key, row))
    return runs


def merge(index: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """The index in global order of URL key, stamp and id: partition by partition, row by row."""
    columns = [c.split()[0] for c in INDEX.split(", ")]
    runs = materialize(index.select(*columns), "runs")
    order = ("url_key", "stamp", F.col("page_id").asc_nulls_last(), "archive", "at")
    dealt = runs.repartitionByRange(runs.count() // range_lines + 1, *order)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = []
        for _, row in LoserTree(_runs(batches)):
            some.append(row)
            if len(some) == 10_000:
                yield _frame(some, columns)
                some = []
        if some:
            yield _frame(some, columns)

    return dealt.mapInPandas(merged, INDEX)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive(pages: DataFrame, min_revisit: int = MIN_REVISIT, stamp_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES, range_lines: int = RANGE_LINES, compression: str = "gzip") -> DataFrame:
    """Write pages to new archives in the shared folder, read them back, merge their indexes."""
    path = f"{shared_dir(pages.sparkSession)}/warc"
    write(pages, path, min_revisit, stamp_col, archive_bytes, compression)
    return merge(read_index(pages.sparkSession, path), range_lines)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp")
