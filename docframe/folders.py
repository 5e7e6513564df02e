"""The operators of file-backed tables as named queries: each writes a table's records to a new
folder of JSON files, works on it through ``Table``, and gives what is served afterwards."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TOKENS, query, spec
from .database import Database
from .operators.search import postings, search_all
from .operators.write import InvalidKey, JsonWriter
from .plans.view import View
from .spec import GsiSpec, TableSpec
from .table import Table

SUPPLIER = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}
ALL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def folder(spark: SparkSession) -> str:
    """A new folder that all tasks see: below spark.checkpoint.dir where that is a file system's
    folder, else, on one machine, a temporary one."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if base.startswith("/"):
        os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="docframe-json-", dir=base if base.startswith("/") else None)


def written(rows: DataFrame, key: str, path: str) -> str:
    names = [c for c in rows.columns if c != "_key"]
    JsonWriter(path).write(rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*names)).alias("text")))
    return path


def suppliers(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(*SUPPLIER)


def loaded(spark, path: str, **more) -> Table:
    gsis = more.pop("gsis", {})
    table = Table("supplier", primary_key="s_suppkey", directory=path, spark=spark, **more)
    for name, keys in gsis.items():
        table.add_gsi(name, *keys)
    table.load_from_dir()
    return table


def served(table: Table, view: View | None = None, **types: str) -> DataFrame:
    view = view or table.view()
    return view.frame.select(*[view.value(n).column.cast(t).alias(n) for n, t in (types or SUPPLIER).items()])


@query(ALL)
def folder_load(spark, sf_dir):
    return served(loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'again' ELSE s_name END AS s_name FROM supplier")
def folder_later_file_wins(spark, sf_dir):
    rows, path = suppliers(spark, sf_dir), folder(spark)
    written(rows, "s_suppkey", path)
    again = rows.where("s_suppkey % 5 = 0").withColumn("s_name", F.lit("again")).withColumn("_key", F.concat(F.lit("zz-"), "s_suppkey"))
    written(again, "_key", path)
    return served(loaded(spark, path), s_suppkey="bigint", s_name="string")


@query(ALL)
def folder_in_memory(spark, sf_dir):
    return served(loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark)), storage="memory"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey = 7")
def folder_index_only(spark, sf_dir):
    path = written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))
    table = loaded(spark, path, storage="index_only", gsis={"by_nation": ("s_nationkey",)})
    found = table.view().partition(table.gsis["by_nation"], 7)
    return served(table, found, s_suppkey="bigint", s_name="string", s_acctbal="double")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal >= 0")
def schema_database(spark, sf_dir):
    root = folder(spark)
    written(suppliers(spark, sf_dir), "s_suppkey", os.path.join(root, "suppliers"))
    schema = {"tables": {"suppliers": {"primary_key": "s_suppkey", "directory": "suppliers", "gsis": {"by_nation": {"partition_key": "s_nationkey", "sort_key": "s_acctbal"}}}}}
    db = Database.from_schema_dict(schema, root, spark)
    rows = db.query({"suppliers": {"index": "by_nation", "where": {"s_nationkey": 3}, "sort": {"gte": 0}, "fields": ["s_suppkey", "s_name"]}})
    return rows.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), F.col("s_name").cast("string").alias("s_name"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'last' ELSE s_name END AS s_name FROM supplier")
def bulk_loaded(spark, sf_dir):
    rows = suppliers(spark, sf_dir)
    again = rows.where("s_suppkey % 7 = 0").withColumn("s_name", F.lit("last"))
    table = Table("supplier", primary_key="s_suppkey", spark=spark)
    table.bulk_load(r.asDict() for part in (rows, again) for r in part.toLocalIterator())
    return served(table, s_suppkey="bigint", s_name="string")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 6 <> 0")
def folder_bad_files(spark, sf_dir):
    rows, path = suppliers(spark, sf_dir), folder(spark)
    text = F.to_json(F.struct(*SUPPLIER))
    bad = F.when(F.col("s_suppkey") % 12 == 0, F.lit("")).when(F.col("s_suppkey") % 6 == 0, F.substring(text, 1, 12)).otherwise(text)
    JsonWriter(path).write(rows.select(F.col("s_suppkey").cast("string").alias("key"), bad.alias("text")))
    return served(loaded(spark, path), s_suppkey="bigint", s_name="string")


@query("SELECT count(*) FILTER (s_suppkey % 6 = 0) AS errors FROM supplier")
def folder_load_errors(spark, sf_dir):
    rows, path = suppliers(spark, sf_dir), folder(spark)
    text = F.when(F.col("s_suppkey") % 6 == 0, F.lit("{")).otherwise(F.to_json(F.struct(*SUPPLIER)))
    JsonWriter(path).write(rows.select(F.col("s_suppkey").cast("string").alias("key"), text.alias("text")))
    return spark.createDataFrame([(len(loaded(spark, path).load_errors),)], "errors long")


@query("SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 1 AND 3 THEN 'put' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT 1000000, 'new'")
def put_is_written_to_its_file(spark, sf_dir):
    path = written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))
    table = loaded(spark, path)
    for k in (1, 2, 3):
        table.put(table.get(k) | {"s_name": "put"})
    table.put({"s_suppkey": 1000000, "s_name": "new"})
    return served(loaded(spark, path), s_suppkey="bigint", s_name="string")  # as another process reads it


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (1, 4)")
def delete_removes_the_file(spark, sf_dir):
    path = written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))
    table = loaded(spark, path)
    for k in (1, 4, -1):
        table.delete(k)
    return served(loaded(spark, path), s_suppkey="bigint", s_name="string")


@query(ALL)
def exported_and_read_back(spark, sf_dir):
    path = folder(spark)
    Table("supplier", primary_key="s_suppkey", frame=suppliers(spark, sf_dir)).export(path)
    return served(loaded(spark, path))


@query("SELECT true AS refused, count(*) AS n FROM supplier")
def key_guard(spark, sf_dir):
    path = written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))
    table, refused = loaded(spark, path), True
    for key in ("a/b", "a\\b"):
        try:
            table.put({"s_suppkey": key})
            refused = False
        except InvalidKey:
            pass
    return table.view().frame.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey")
def resolved_associations(spark, sf_dir):
    tables = {t: Table(t, spec=spec(t), frame=spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("region", "nation")}
    tables["nation"].add_gsi("by_region", "n_regionkey")
    tables["region"].add_has_many("nations", "nation", "by_region")
    regions = [r["r_regionkey"] for r in tables["region"].scan()]
    found = [(int(r), int(n["n_nationkey"])) for r in regions for n in tables["region"].resolve_association("nations", r, tables)]
    return spark.createDataFrame(found, "r_regionkey int, n_nationkey int")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'erth'])")
def search_lists_of_strings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", " ").alias("words"))
    view = View(TableSpec("documents", "doc_id", search_fields=["words"]), rows)
    return search_all(view, postings(view, ["words"]), ["the", "erth"]).frame.select("doc_id")


def _benchmark(spark, sf_dir, path: str) -> Table:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    written(rows, "item_id", path)
    table = Table("benchmark", primary_key="item_id", directory=path, search_fields=["text"], spark=spark)
    table.load_from_dir()
    return table


@query(f"SELECT item_id, true AS reused FROM benchmark WHERE list_has_all({TOKENS}, ['the', 'of'])")
def persisted_search_index(spark, sf_dir):
    path = os.path.join(folder(spark), "benchmark")
    _benchmark(spark, sf_dir, path)
    table = Table("benchmark", primary_key="item_id", directory=path, search_fields=["text"], spark=spark)
    table.load_from_dir()
    reused = table.persist_search_index()
    found = table.search_view(table.view(), ["the", "of"])
    return served(table, found, item_id="bigint").withColumn("reused", F.lit(reused))


@query(f"SELECT item_id FROM benchmark WHERE list_contains({TOKENS}, 'the') UNION ALL SELECT 1000000")
def rebuilt_search_index(spark, sf_dir):
    table = _benchmark(spark, sf_dir, os.path.join(folder(spark), "benchmark"))
    table.put({"item_id": 1000000, "text": "The last one"})
    table.persist_search_index()
    return served(table, table.search_view(table.view(), ["the"]), item_id="bigint")


def _changed(spark, sf_dir, table: Table) -> None:
    """A tenth of the files is new, a tenth gone, a tenth other than before."""
    rows = suppliers(spark, sf_dir)
    written(rows.where("s_suppkey % 10 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1000000), "s_suppkey", table.directory)
    written(rows.where("s_suppkey % 10 = 3").withColumn("s_name", F.lit("a name of another length")), "s_suppkey", table.directory)
    for r in rows.where("s_suppkey % 10 = 2").select("s_suppkey").collect():
        os.unlink(os.path.join(table.directory, f"{r['s_suppkey']}.json"))


REFRESHED = """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'a name of another length' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 10 <> 2
UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey % 10 = 1"""
CHANGES = "count(*) FILTER (s_suppkey % 10 = 1) AS added, count(*) FILTER (s_suppkey % 10 = 3) AS modified, count(*) FILTER (s_suppkey % 10 = 2) AS deleted, count(*) FILTER (s_suppkey % 10 IN (1, 3)) AS reread"


def _summary(spark, s, **more) -> DataFrame:
    found = {"added": s.added, "modified": s.modified, "deleted": s.deleted, "reread": s.reread}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found)).withColumns({k: F.lit(v) for k, v in more.items()})


@query(REFRESHED)
def refreshed_folder(spark, sf_dir):
    table = loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark)))
    _changed(spark, sf_dir, table)
    table.refresh()
    return served(table, s_suppkey="bigint", s_name="string")


@query(f"SELECT {CHANGES}, true AS stale, false AS after FROM supplier")
def checked_and_warmed(spark, sf_dir):
    table = loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark)))
    _changed(spark, sf_dir, table)
    stale, seen = table.is_stale(), table.check()
    warmed = table.warm()
    assert seen.to_dict() == warmed.to_dict()
    return _summary(spark, warmed, stale=stale, after=table.is_stale())


@query(REFRESHED)
def refreshed_when_asked(spark, sf_dir):
    db = Database(spark)
    table = loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark)))
    db.add_table("supplier", table)
    _changed(spark, sf_dir, table)
    rows = db.query({"supplier": {"fields": ["s_suppkey", "s_name"]}})
    return rows.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), F.col("s_name").cast("string").alias("s_name"))


@query("SELECT count(*) FILTER (s_suppkey % 3 <> 0) AS stored, 2 * count(*) FILTER (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) - count(*) FILTER (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) AS warnings FROM supplier")
def put_validation(spark, sf_dir):
    table = Table("supplier", primary_key="s_suppkey", validation="warn", spark=spark)
    table.add_gsi("by_nation", "s_nationkey")
    without = lambda name, n: F.when(F.col("s_suppkey") % n != 0, F.col(name)).alias(name)
    problems = table.put_rows(suppliers(spark, sf_dir).select(without("s_suppkey", 3), "s_name", without("s_nationkey", 5), "s_acctbal"))
    stored = table.view().frame.agg(F.count(F.lit(1)).alias("stored"))
    return stored.crossJoin(problems.agg(F.count(F.lit(1)).alias("warnings")))


@query("SELECT 'supplier' AS name, count(*) AS record_count, 'by_nation' AS gsis, 's_suppkey' AS primary_key, false AS stale FROM supplier")
def described(spark, sf_dir):
    db, path = Database(spark), written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))
    db.add_table("supplier", loaded(spark, path, gsis={"by_nation": ("s_nationkey",)}))
    d = db.describe()["supplier"]
    row = (d["name"], d["record_count"], ",".join(d["gsis"]), d["primary_key"], d["stale"])
    return spark.createDataFrame([row], "name string, record_count long, gsis string, primary_key string, stale boolean")


@query("SELECT 3 AS puts, 1 AS deletes, 1 AS refreshes, 3 AS errors FROM region LIMIT 1")
def hooks(spark, sf_dir):
    table, seen = loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark))), {"puts": 0, "deletes": 0, "refreshes": 0}

    def counted(name):
        return lambda _: seen.update({name: seen[name] + 1})

    def failing(_):
        raise RuntimeError("a hook's failure is kept apart")

    table.on_put += [counted("puts"), failing]
    table.on_delete.append(counted("deletes"))
    table.on_refresh.append(counted("refreshes"))
    for k in (1, 2, 3):
        table.put({"s_suppkey": k, "s_name": "x"})
    table.delete(2)
    table.refresh()
    return spark.createDataFrame([(*seen.values(), len(table.hook_errors))], "puts int, deletes int, refreshes int, errors int")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 1")
def keys_looked_up(spark, sf_dir):
    rows = suppliers(spark, sf_dir)
    wanted = [r["s_suppkey"] for r in rows.where("s_suppkey % 3 = 1").select("s_suppkey").collect()]
    view = Table("supplier", primary_key="s_suppkey", frame=rows).view().by_keys([*wanted, "no such key", -5])
    return view.frame.select("s_suppkey", "s_name")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 5")
def index_added_later(spark, sf_dir):
    table = loaded(spark, written(suppliers(spark, sf_dir), "s_suppkey", folder(spark)))
    table.add_gsi("by_nation", "s_nationkey")
    table.add_gsi("unused", "s_name")
    table.remove_gsi("unused")
    assert list(table.gsis) == ["by_nation"] and isinstance(table.gsis["by_nation"], GsiSpec)
    return served(table, table.view().partition(table.gsis["by_nation"], 5), s_suppkey="bigint")
