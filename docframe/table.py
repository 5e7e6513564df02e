"""A table: a description, an immutable snapshot of rows, and a small buffer of writes.

Rows come from a directory of JSON files (schemaless, one VARIANT each), from single writes, or
from any DataFrame (typed). A snapshot is never changed: refreshes and flushed writes swap in a
new one, so that a query keeps the rows that it began with. Single writes go to a buffer of at
most BUFFER records, which every query sees, and then into a new snapshot; many records at once
(``bulk_load``) become a snapshot in batches. Writes of several threads take turns; a reader gets
the snapshot and the buffer of one moment.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import threading
import time
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import islice
from operator import or_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.conditions import Condition
from .functions.text import query_tokens
from .functions.values import text_of
from .operators.refresh import Changes, ChangeSummary, diff_manifests
from .operators.search import matching, postings, search_all
from .operators.upsert import last_write
from .operators.write import JsonWriter, check_key, write_atomic
from .plans.query import resolve
from .plans.view import DOC, SEPARATOR, View
from .sources.json_dir import list_manifest, read_documents, read_files
from .spec import AssociationSpec, GsiSpec, SchemaError, TableSpec

BUFFER = 1000
#: Records that bulk_load turns into one snapshot.
BATCH = 50_000
#: Every so many refreshes a cached table is read anew, and every so many flushes written, which
#: ends the chain of snapshots.
LINEAGE = 20
ROW = "_pk string, doc variant, _file string"


def unpack(record: Any, includes: dict[str, dict] | None = None) -> Any:
    """Plain JSON of a ``record`` struct: a schemaless document is spread into its object."""
    if not isinstance(record, dict):
        return record
    out: dict[str, Any] = {}
    for k, v in record.items():
        if k == DOC:
            out = (v if isinstance(v, dict) else {"value": v}) | out
        elif includes and k in includes:
            inner = (includes[k] or {}).get("include")
            out[k] = [unpack(x, inner) for x in v] if isinstance(v, list) else unpack(v, inner)
        else:
            out[k] = v
    return out


def collect_records(rows: DataFrame, order: list[Column], includes: dict[str, dict] | None = None) -> list[dict[str, Any]]:
    text = F.to_json("record", {"ignoreNullFields": "false"})
    return [unpack(json.loads(r["t"]), includes) for r in rows.orderBy(*order).select(text.alias("t")).collect()]


def predicate_udf(predicate: Callable[[Any], bool]):
    """A predicate over plain JSON values as a vectorised function of {"v": value} texts."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(predicate(json.loads(t).get("v"))))

    return holds


class Table:
    def __init__(
        self, name: str, primary_key: str | None = None, partition_key: str | None = None, sort_key: str | None = None, directory: str | None = None,
        validation: str = "silent", check_interval: float = 0, auto_refresh: bool = True, storage: str | None = None, search_fields: list[str] | None = None,
        *, spec: TableSpec | None = None, frame: DataFrame | None = None, spark: SparkSession | None = None,
    ):
        self.spec = spec or TableSpec(name, primary_key, partition_key, sort_key, directory, validation, check_interval, auto_refresh, storage, list(search_fields or []))
        if self.spec.storage == "index_only" and not self.spec.directory:
            raise SchemaError(f"table {name!r}: index_only needs a directory")
        self._spark = spark or (frame.sparkSession if frame is not None else None)
        self._typed = frame
        self._base: DataFrame | None = None
        self._hot: DataFrame | None = None
        self._refreshes = self._flushes = 0
        self._lock = threading.RLock()
        self._buffer: dict[str, str | None] = {}
        self._manifest: dict[str, tuple[int, int]] = {}
        self._checked = 0.0
        self._stale = False
        self._postings: DataFrame | None = None
        self.on_put: list[Callable] = []
        self.on_delete: list[Callable] = []
        self.on_refresh: list[Callable] = []
        self.warnings: list[str] = []
        self.hook_errors: list[str] = []
        self.load_errors: list[str] = []
        self.refresh_errors: list[str] = []
        self.last_change_summary: ChangeSummary | None = None
        self.last_write_used_atomic = False

    name = property(lambda self: self.spec.name)
    primary_key = property(lambda self: self.spec.primary_key)
    partition_key = property(lambda self: self.spec.partition_key)
    sort_key = property(lambda self: self.spec.sort_key)
    directory = property(lambda self: self.spec.directory)
    storage = property(lambda self: self.spec.storage)
    validation = property(lambda self: self.spec.validation)
    search_fields = property(lambda self: self.spec.search_fields)
    gsis = property(lambda self: self.spec.gsis)
    associations = property(lambda self: self.spec.associations)

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return self._spark

    # -- rows ---------------------------------------------------------------------------------

    def view(self) -> View:
        """The rows as of now: the snapshot under the buffered writes."""
        with self._lock:
            base, buffer = self._base, dict(self._buffer)
        if self._typed is not None and base is None and not buffer:
            return View(self.spec, self._typed)
        return View(self.spec, self._schemaless(base, buffer), "doc")

    def _schemaless(self, base: DataFrame | None, buffer: dict[str, str | None]) -> DataFrame:
        """The snapshot base under the writes of buffer."""
        if base is None and self._typed is not None:
            typed = View(self.spec, self._typed)
            base = self._typed.select(typed.pk.alias("_pk"), F.to_variant_object(F.struct("*")).alias("doc"), F.lit(None).cast("string").alias("_file"))
        if base is None:
            base = self.spark.createDataFrame([], ROW)
        if not buffer:
            return base
        new = self.spark.createDataFrame(list(buffer.items()), "_pk string, text string")
        kept = base.join(F.broadcast(new.select("_pk")), "_pk", "left_anti")  # at most BATCH keys
        written = new.where("text is not null").select("_pk", F.parse_json("text").alias("doc"), F.lit(None).cast("string").alias("_file"))
        # few writes are one partition: else partitions would add up by the number of cores
        return kept.unionByName(written.coalesce(1) if len(buffer) <= BUFFER else written)

    def _keyed(self, files: DataFrame) -> DataFrame:
        """(_pk, doc, _file): of files of one key the last by time, then name; files without a
        key and files that hold no object go."""
        rows = View(self.spec, files, "doc")
        parts = [rows.value(f) for f in self.spec.key_fields]
        pk = F.concat_ws(SEPARATOR, *[p.text for p in parts])
        for p in parts:
            pk = F.when(~F.coalesce(p.is_null, F.lit(True)), pk)
        rows = files.withColumn("_pk", pk).where("_pk is not null")
        return last_write(rows, ["_pk"], [F.col("_mtime"), F.col("_file")]).select("_pk", "doc", "_file")

    def _swap(self, base: DataFrame) -> None:
        """Make base the snapshot. In memory mode its documents are cached; in index_only mode
        its keys are, as of now, and documents are read from their files when asked for."""
        old, self._hot = self._hot, base.persist() if self.spec.storage == "memory" else base.select("_pk").persist()
        self._hot.count()
        if old is not None:
            old.unpersist()
        self._base = self._hot if self.spec.storage == "memory" else base
        self._postings = None

    @property
    def records(self) -> dict[str, dict[str, Any]]:
        view = self.view()
        rows = view.frame.select(view.pk.alias("k"), F.to_json(view.payload(), {"ignoreNullFields": "false"}).alias("t")).collect()
        return {r["k"]: unpack(json.loads(r["t"])) for r in rows}

    # -- description --------------------------------------------------------------------------

    def add_gsi(self, name: str, partition_key: str, sort_key: str | None = None) -> None:
        self.spec.gsis[name] = GsiSpec(name, partition_key, sort_key)

    def remove_gsi(self, name: str) -> None:
        self.spec.gsis.pop(name, None)

    def add_belongs_to(self, name: str, target_table: str, foreign_key: str) -> None:
        self.spec.associations[name] = AssociationSpec(name, "belongs_to", target_table, foreign_key=foreign_key)

    def add_has_many(self, name: str, target_table: str, index: str) -> None:
        self.spec.associations[name] = AssociationSpec(name, "has_many", target_table, index=index)

    def add_has_many_through(self, name: str, through_table: str, through_index: str, target_table: str, target_foreign_key: str) -> None:
        self.spec.associations[name] = AssociationSpec(name, "has_many_through", target_table, through_index, target_foreign_key, through_table)

    def describe(self) -> dict[str, Any]:
        s = self.spec
        key = {"primary_key": s.primary_key} if s.primary_key else {"partition_key": s.partition_key, "sort_key": s.sort_key}
        gsis = {g.name: {"partition_key": g.partition_key, "sort_key": g.sort_key} for g in s.gsis.values()}
        return {"name": s.name, **key, "record_count": self.count(), "gsis": gsis, "associations": list(s.associations), "storage": s.storage, "search_fields": list(s.search_fields)}

    # -- writes -------------------------------------------------------------------------------

    def _key_of(self, record: dict[str, Any]) -> str | None:
        parts = [record.get(f) for f in self.spec.key_fields]
        return None if any(p is None for p in parts) else SEPARATOR.join(map(text_of, parts))

    def _accept(self, record: dict[str, Any]) -> str | None:
        """The record's key, or None if it is dropped for want of one."""
        problems, key = [], self._key_of(record)
        if key is None:
            missing = [f for f in self.spec.key_fields if record.get(f) is None]
            problems.append(f"table {self.name!r}: record without primary key field {', '.join(map(repr, missing))}")
        else:
            problems += [f"table {self.name!r}: record {key!r} without GSI field {f!r}" for f in self.spec.indexed_fields() if record.get(f) is None]
        if problems and self.spec.validation == "error":
            raise ValueError("; ".join(problems))
        if self.spec.validation == "warn":
            self.warnings += problems
        return key

    def put(self, record: dict[str, Any]) -> None:
        with self._lock:
            key = self._accept(record)
            if key is None:
                return
            text = json.dumps(record, ensure_ascii=False)
            if self.spec.directory:
                file = write_atomic(self.spec.directory, key, text)
                self.last_write_used_atomic = True
                s = os.stat(os.path.join(self.spec.directory, file))
                self._manifest[file] = (s.st_mtime_ns, s.st_size)
            self._buffer[key] = text
            self._postings = None
            self._flush(BUFFER)
        self._fire(self.on_put, record)

    def put_rows(self, rows: DataFrame) -> DataFrame:
        """Put the rows of a DataFrame, checked where they are, as one snapshot; a null is an
        absent field, and of rows of one key any one stays. Gives the problems, (problem), one row
        for each warning that single puts would add; they are not kept on the driver."""
        if self.spec.directory or self.on_put:
            raise ValueError(f"table {self.name!r}: put_rows is for tables in memory without put hooks; use bulk_load")
        view = View(self.spec, rows)
        missing = lambda f: view.value(f).is_null if f in rows.columns else F.lit(True)
        start, keyless = f"table {self.name!r}: record ", reduce(or_, map(missing, self.spec.key_fields))
        # a key that is a null literal has no text
        key = view.pk if all(f in rows.columns for f in self.spec.key_fields) else F.lit(None).cast("string")
        lost = F.concat_ws(", ", *[F.when(missing(f), F.lit(repr(f))) for f in self.spec.key_fields])
        gaps = [F.when(missing(f), F.concat(F.lit(f"{start}'"), key, F.lit(f"' without GSI field {f!r}"))) for f in self.spec.indexed_fields()]
        found = F.when(keyless, F.array(F.concat(F.lit(f"{start}without primary key field "), lost))).otherwise(F.array_compact(F.array(F.lit(None).cast("string"), *gaps)))
        problems = rows.select(F.explode(found).alias("problem"))
        if self.spec.validation == "error" and (first := problems.first()):
            raise ValueError(first["problem"])
        with self._lock:
            held = rows.where(~keyless).select(key.alias("_pk"), F.struct("*").alias("_row")).dropDuplicates(["_pk"])
            new = held.select("_pk", F.parse_json(F.to_json("_row")).alias("doc"), F.lit(None).cast("string").alias("_file"))
            old = self._schemaless(self._base, self._buffer)
            self._swap(old.join(new.select("_pk"), "_pk", "left_anti").unionByName(new))
            self._buffer = {}
        return problems if self.spec.validation == "warn" else problems.limit(0)

    def bulk_load(self, records: Iterable[dict[str, Any]]) -> None:
        """Put many records: of one key the last stays. Files are written in tasks, and each BATCH
        of records is one snapshot."""
        records = iter(records)
        while batch := list(islice(records, BATCH)):
            with self._lock:
                texts, taken = {}, []
                for record in batch:
                    if (key := self._accept(record)) is not None:
                        texts[key] = json.dumps(record, ensure_ascii=False)
                        taken.append(record)
                if texts and self.spec.directory:
                    for key in texts:
                        check_key(key)
                    JsonWriter(self.spec.directory).write(self.spark.createDataFrame(list(texts.items()), "key string, text string"))
                    self.last_write_used_atomic = True
                    self._manifest = list_manifest(self.spec.directory)
                self._buffer |= texts
                self._postings = None
                self._flush(1)
            for record in taken if self.on_put else ():
                self._fire(self.on_put, record)

    def delete(self, pk: Any, sort: Any = None) -> None:
        key = text_of(pk) if sort is None else SEPARATOR.join((text_of(pk), text_of(sort)))
        with self._lock:
            old = self.get(pk, sort)
            if old is None:
                return
            self._buffer[key] = None
            self._postings = None
            if self.spec.directory:
                file = f"{check_key(key)}.json"
                path = os.path.join(self.spec.directory, file)
                if os.path.exists(path):
                    os.unlink(path)
                self._manifest.pop(file, None)
            self._flush(BUFFER)
        self._fire(self.on_delete, old)

    def _flush(self, least: int) -> None:
        """Make the buffer a snapshot if it has so many writes."""
        if len(self._buffer) < least:
            return
        if self.spec.directory and self.spec.storage == "index_only":  # all of it is in the files
            self._swap(self._keyed(read_documents(self.spark, self.spec.directory, self._manifest)))
        else:
            self._flushes += 1
            new = self._schemaless(self._base, self._buffer)
            self._swap(self._cut(new) if self._flushes % LINEAGE == 0 else new)
        self._buffer = {}

    def _cut(self, base: DataFrame) -> DataFrame:
        """base, written, without the plans of the snapshots that it came from. Only on one
        machine a temporary folder stands in for spark.checkpoint.dir where that is unset."""
        context = self.spark.sparkContext
        if not context.getCheckpointDir():
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="docframe-"))
        return base.checkpoint()

    def export(self, directory: str) -> int:
        """Write every record as a JSON file; the directory is made even for no records."""
        view = self.view()
        bad = view.frame.select(view.pk.alias("k")).where(F.contains("k", F.lit("/")) | F.contains("k", F.lit("\\"))).first()
        if bad:
            check_key(bad["k"])
        payload = F.col("doc") if view.doc else view.payload()
        return JsonWriter(directory).write(view.frame.select(view.pk.alias("key"), F.to_json(payload).alias("text")))

    def _fire(self, hooks: list[Callable], what: Any) -> None:
        for hook in hooks:
            try:
                hook(what)
            except Exception as e:  # noqa: BLE001  a hook's failure is recorded, the operation stands
                self.hook_errors.append(f"{getattr(hook, '__name__', hook)}: {e}")

    # -- loading and freshness ----------------------------------------------------------------

    def load_from_dir(self, directory: str | None = None) -> None:
        with self._lock:
            self._load(directory)

    def _load(self, directory: str | None) -> None:
        if directory is not None:
            self.spec.directory = directory
        if not self.spec.directory:
            raise ValueError(f"table {self.name!r} has no directory")
        self._manifest = list_manifest(self.spec.directory)
        self._buffer = {}
        if not self._manifest:
            self._swap(self.spark.createDataFrame([], ROW))
            return
        files = read_documents(self.spark, self.spec.directory, self._manifest)
        self._swap(self._keyed(files))
        self.load_errors = self._unreadable(files, self._manifest)
        self._validate_load(files)
        if self.on_put:
            for record in self.scan_snapshot():
                self._fire(self.on_put, record)
        self._checked, self._stale = time.monotonic(), False
        if self.spec.search_fields:
            self.persist_search_index()

    @staticmethod
    def _unreadable(files: DataFrame, manifest: dict[str, tuple[int, int]]) -> list[str]:
        bad = [r["_file"] for r in files.where("doc is null").select("_file").collect()]
        return sorted(bad + [n for n, (_, size) in manifest.items() if size == 0])

    def _validate_load(self, files: DataFrame) -> None:
        if self.spec.validation == "silent":
            return
        view = View(self.spec, files.where("doc is not null"), "doc")
        absent = lambda f: F.coalesce(F.sum(view.value(f).is_null.cast("long")), F.lit(0))
        fields = list(dict.fromkeys(self.spec.key_fields + self.spec.indexed_fields()))
        counts = view.frame.select(*[absent(f).alias(f"n{i}") for i, f in enumerate(fields)]).first()
        problems = [f"table {self.name!r}: {counts[i]} records without field {f!r}" for i, f in enumerate(fields) if counts[i]]
        if problems and self.spec.validation == "error":
            raise ValueError("; ".join(problems))
        self.warnings += problems

    def _changes(self) -> tuple[Changes, dict[str, tuple[int, int]]]:
        new = list_manifest(self.spec.directory)
        return diff_manifests(self._manifest, new), new

    def is_stale(self, force_scan: bool = False) -> bool:
        if not self.spec.directory:
            return False
        if not force_scan and self.spec.check_interval and time.monotonic() - self._checked < self.spec.check_interval:
            return self._stale
        self._stale, self._checked = bool(self._changes()[0]), time.monotonic()
        return self._stale

    def check(self) -> ChangeSummary:
        if not self.spec.directory:
            return ChangeSummary()
        changes, _ = self._changes()
        return changes.summary(len(changes.added) + len(changes.modified))

    def refresh(self) -> ChangeSummary:
        """Read added and modified files, drop deleted ones, swap the snapshot."""
        with self._lock:
            return self._refresh()

    def _refresh(self) -> ChangeSummary:
        if not self.spec.directory:
            self.last_change_summary = ChangeSummary()
            return self.last_change_summary
        changes, manifest = self._changes()
        reread = changes.added + changes.modified
        summary = changes.summary(len(reread))
        if changes:
            files = read_files(self.spark, self.spec.directory, [n for n in reread if manifest[n][1] > 0])
            gone = [json.loads(r) for r in self._rows_of(changes.deleted)] if self.on_delete and changes.deleted else []
            self.refresh_errors = self._unreadable(files, {n: manifest[n] for n in reread})
            fresh = self._keyed(files)
            self._refreshes += 1
            if self.spec.storage == "memory" and self._base is not None and self._refreshes % LINEAGE:
                # the snapshot is cached: only what changed is read
                touched = self.spark.createDataFrame([(n,) for n in reread + changes.deleted], "_f string")
                current = self._schemaless(self._base, self._buffer)
                kept = current.join(touched, F.col("_file") == F.col("_f"), "left_anti")
                named = F.concat(F.col("_pk"), F.lit(".json"))
                kept = kept.join(touched.withColumnRenamed("_f", "_g"), F.col("_file").isNull() & (named == F.col("_g")), "left_anti")
                self._swap(kept.join(fresh.select("_pk"), "_pk", "left_anti").unionByName(fresh))
            else:
                self._swap(self._keyed(read_documents(self.spark, self.spec.directory, manifest)))
            self._manifest, self._buffer = manifest, {}
            if self.on_put and reread:
                for r in fresh.select(F.to_json("doc").alias("t")).collect():
                    self._fire(self.on_put, json.loads(r["t"]))
            for record in gone:
                self._fire(self.on_delete, record)
            if self.spec.search_fields:
                self.persist_search_index()
        self._stale, self._checked, self.last_change_summary = False, time.monotonic(), summary
        self._fire(self.on_refresh, summary.to_dict())
        return summary

    def _rows_of(self, files: list[str]) -> list[str]:
        if self._base is None or self.spec.storage != "memory":
            return []  # their text went with the file
        return [r["t"] for r in self._base.where(F.col("_file").isin(files)).select(F.to_json("doc").alias("t")).collect()]

    def warm(self) -> ChangeSummary:
        return self.refresh()

    def fresh(self) -> None:
        """Refresh before a query if the directory has changed."""
        if self.spec.directory and self.spec.auto_refresh and self.is_stale():
            self.refresh()

    # -- reads --------------------------------------------------------------------------------

    def _list(self, view: View, order: list[Column]) -> list[dict[str, Any]]:
        return collect_records(view.frame.withColumn("record", view.payload()), order)

    def get(self, pk: Any, sort: Any = None) -> dict[str, Any] | None:
        view = self.view().by_key(pk, sort)
        found = self._list(view, view.order())
        return found[0] if found else None

    def get_many(self, keys: Iterable[Any]) -> list[dict[str, Any]]:
        """The records of those keys that there are, in order of key; composite keys are tuples."""
        view = self.view().by_keys(list(keys))
        return self._list(view, view.order())

    def scan_snapshot(self) -> list[dict[str, Any]]:
        view = self.view()
        return self._list(view, view.order())

    def scan(self) -> list[dict[str, Any]]:
        self.fresh()
        return self.scan_snapshot()

    def count(self, index: str | None = None, value: Any = None) -> int:
        if index is None and self._hot is not None and self.spec.storage == "index_only":
            keys = self.spark.createDataFrame([(k,) for k in self._buffer], "_pk string")
            return self._hot.join(F.broadcast(keys), "_pk", "left_anti").count() + sum(v is not None for v in self._buffer.values())
        view = self.view()
        if index is None:
            return view.frame.count()
        return view.partition(self.spec.gsis[index], value).frame.count() if index in self.spec.gsis else 0

    def query_gsi(self, name: str, partition_value: Any, sort_condition: Condition | Callable | None = None, descending: bool = False) -> list[dict[str, Any]]:
        """Records of one partition in index order. Any Python predicate over the sort value is
        taken too; it runs where the rows are, in batches."""
        if name not in self.spec.gsis:
            raise KeyError(f"table {self.name!r} has no index {name!r}")
        self.fresh()
        gsi = self.spec.gsis[name]
        own = sort_condition if isinstance(sort_condition, Condition) else None
        found = self.view().partition(gsi, partition_value, own)
        if sort_condition is not None and own is None:
            value = F.to_json(F.struct(found.value(gsi.sort_key).column.alias("v"))) if gsi.sort_key else None
            found = found.on(found.frame.where(predicate_udf(sort_condition)(value) if gsi.sort_key else F.lit(False)))
        return self._list(found, found.order(gsi, descending))

    def resolve_association(self, name: str, pk: Any, tables: dict[str, Table]) -> Any:
        if name not in self.spec.associations:
            raise KeyError(f"table {self.name!r} has no association {name!r}")
        view = self.view().by_key(pk)
        rows = resolve(view.on(view.frame, True), self.spec.associations[name], {}, lambda t: tables[t].view()).select(F.struct(F.col(f"_inc_{name}").alias("v")).alias("record"))
        found = [json.loads(r["t"]) for r in rows.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("t")).collect()]
        many = self.spec.associations[name].kind != "belongs_to"
        if not found or found[0].get("v") is None:
            return [] if many else None
        v = found[0]["v"]
        return [unpack(x) for x in v] if many else unpack(v)

    # -- search -------------------------------------------------------------------------------

    @property
    def index_path(self) -> str:
        parent = os.path.dirname(os.path.abspath(self.spec.directory))
        return os.path.join(parent, ".docframe", "index", self.name)

    def _fingerprint(self) -> dict[str, Any]:
        return {"fields": list(self.spec.search_fields), "files": {k: list(v) for k, v in sorted(self._manifest.items())}}

    def persist_search_index(self) -> bool:
        """Write postings beside the data unless those there are of the same files and fields;
        whether they were reused."""
        note = os.path.join(self.index_path, "manifest.json")
        data = os.path.join(self.index_path, "postings")
        try:
            with open(note) as f:
                same = json.load(f) == self._fingerprint() and os.path.isdir(data)
        except (OSError, ValueError):
            same = False
        if not same:
            new = f"{data}.new"
            postings(self.view(), self.spec.search_fields).repartitionByRange("token").write.mode("overwrite").parquet(new)
            shutil.rmtree(data, ignore_errors=True)
            os.replace(new, data)
            with open(f"{note}.new", "w") as f:
                json.dump(self._fingerprint(), f)
            os.replace(f"{note}.new", note)
        self._postings = self.spark.read.schema("token string, _key string").parquet(data)
        return same

    def search_view(self, view: View, wanted: list[str]) -> View:
        if not self.spec.search_fields:
            raise ValueError(f"table {self.name!r} has no search fields")
        if self._postings is not None:
            return search_all(view, self._postings, wanted)
        return matching(view, self.spec.search_fields, wanted)

    def search(self, query: str) -> list[dict[str, Any]]:
        self.fresh()
        found = self.search_view(self.view(), query_tokens(query))
        return self._list(found, found.order())

