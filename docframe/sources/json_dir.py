"""Directories of JSON files, one record per file.

Files are read whole and parsed to one VARIANT each, so that a member that is a number in one
file and a string in another keeps both types, and an array at the top stays one value. The
manifest (name, modification time, size) comes from a listing on the driver: Spark's own listing
hides names that begin with _ or . and yields no row for empty files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc variant, _file string, _mtime timestamp"
#: Files per scan beyond which the directory itself is listed by Spark.
FEW = 1000


def list_manifest(directory: str | None) -> dict[str, tuple[int, int]]:
    """{file name: (mtime in ns, size)} of the *.json files; none for a missing directory."""
    found: dict[str, tuple[int, int]] = {}
    if directory and os.path.isdir(directory):
        with os.scandir(directory) as entries:
            for e in entries:
                try:
                    if e.name.endswith(".json") and e.is_file():
                        s = e.stat()
                        found[e.name] = (s.st_mtime_ns, s.st_size)
                except FileNotFoundError:  # it went meanwhile
                    continue
    return found


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select(F.try_parse_json("value").alias("doc"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_modification_time").alias("_mtime"))


def _hidden(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    rows = []
    for n in names:
        try:
            with open(os.path.join(directory, n), encoding="utf-8", errors="replace") as f:
                rows.append((f.read(), n, os.stat(os.path.join(directory, n)).st_mtime))
        except FileNotFoundError:
            continue
    frame = spark.createDataFrame(rows, "value string, _file string, at double")
    return frame.select(F.try_parse_json("value").alias("doc"), "_file", F.timestamp_seconds("at").alias("_mtime"))


def read_files(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """(doc, _file, _mtime) of the named files; doc is null where the text is no JSON."""
    from urllib.parse import quote

    plain = [n for n in names if n[0] not in "_."]
    hidden = [n for n in names if n[0] in "_."]
    out = None
    if len(plain) > FEW:
        wanted = spark.createDataFrame([(quote(n),) for n in plain], "_n string")
        every = _parsed(spark.read.option("ignoreMissingFiles", "true").text(directory, wholetext=True, pathGlobFilter="*.json"))
        out = every.join(wanted, F.col("_file") == F.col("_n"), "left_semi")
    elif plain:
        escape = lambda n: "".join("\\" + c if c in "*?[]{}\\" else c for c in n)
        paths = [os.path.join(directory, escape(n)) for n in plain if os.path.exists(os.path.join(directory, n))]
        out = _parsed(spark.read.option("ignoreMissingFiles", "true").text(paths, wholetext=True)) if paths else None
    if hidden:
        extra = _hidden(spark, directory, hidden)
        out = extra if out is None else out.unionByName(extra)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def read_documents(spark: SparkSession, directory: str, manifest: dict[str, tuple[int, int]]) -> DataFrame:
    """All files of a manifest that are not empty."""
    names = [n for n, (_, size) in manifest.items() if size > 0]
    plain = [n for n in names if n[0] not in "_."]
    if len(plain) <= FEW:
        return read_files(spark, directory, names)
    out = _parsed(spark.read.option("ignoreMissingFiles", "true").text(directory, wholetext=True, pathGlobFilter="*.json"))
    hidden = [n for n in names if n[0] in "_."]
    return out.unionByName(_hidden(spark, directory, hidden)) if hidden else out
