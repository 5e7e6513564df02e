"""The engine's operators as named queries over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .database import Database
from .functions.conditions import Sort
from .functions.values import value_of
from .operators.integrity import violations
from .operators.refresh import diff_frames
from .operators.search import postings, search_all
from .operators.upsert import delete_keys, last_write, upsert
from .plans.query import parse_query, resolve, select_rows
from .plans.view import View
from .spec import AssociationSpec, GsiSpec, TableSpec

SPECS = {
    "customer": dict(primary_key="c_custkey", gsis={"by_segment": ("c_mktsegment", "c_acctbal"), "by_nation": ("c_nationkey", None)}),
    "orders": dict(primary_key="o_orderkey", gsis={"by_customer": ("o_custkey", "o_orderdate"), "by_status": ("o_orderstatus", None), "by_status_price": ("o_orderstatus", "o_totalprice"), "by_status_priority": ("o_orderstatus", "o_orderpriority")}),
    "lineitem": dict(partition_key="l_orderkey", sort_key="l_linenumber", gsis={"by_order": ("l_orderkey", "l_linenumber")}),
    "part": dict(primary_key="p_partkey", gsis={"by_brand": ("p_brand", None)}),
    "supplier": dict(primary_key="s_suppkey"),
    "nation": dict(primary_key="n_nationkey"),
    "region": dict(primary_key="r_regionkey"),
    "documents": dict(primary_key="doc_id", search_fields=["text"]),
    "labels": dict(primary_key="doc_id"),
    "benchmark": dict(primary_key="item_id", search_fields=["text"]),
    "conversations": dict(partition_key="conv_id", sort_key="turn", gsis={"by_role": ("role", "turn")}),
}
EDGES = {
    "customer": {"orders": ("has_many", "orders", dict(index="by_customer")), "nation": ("belongs_to", "nation", dict(foreign_key="c_nationkey"))},
    "orders": {"customer": ("belongs_to", "customer", dict(foreign_key="o_custkey")), "lines": ("has_many", "lineitem", dict(index="by_order")), "parts": ("has_many_through", "part", dict(index="by_order", through="lineitem", foreign_key="l_partkey"))},
    "nation": {"region": ("belongs_to", "region", dict(foreign_key="n_regionkey"))},
    "documents": {"label": ("belongs_to", "labels", dict(foreign_key="doc_id"))},
}


def spec(name: str, **more) -> TableSpec:
    d = SPECS.get(name, {}) | more
    gsis = {g: GsiSpec(g, *keys) for g, keys in d.get("gsis", {}).items()}
    edges = {a: AssociationSpec(a, kind, table, **x) for a, (kind, table, x) in EDGES.get(name, {}).items()}
    return TableSpec(name, d.get("primary_key"), d.get("partition_key"), d.get("sort_key"), search_fields=d.get("search_fields", []), gsis=gsis, associations=edges)


def database(spark: SparkSession, sf_dir: str) -> Database:
    """All tables; each is opened when a query first names it."""
    from .table import Table

    def opened(name: str) -> Table | None:
        return Table(name, spec=spec(name), frame=spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in SPECS else None

    return Database(spark, opened)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def directive(name: str, sql: str, d: dict, columns: list[str] | None = None) -> None:
    """A query that is one directive."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = database(spark, sf_dir).query(d)
        return out.select(*columns) if columns else out

    QUERIES[name], SQL[name] = run, sql


def ordered(name: str, sql: str, d: dict, columns: list[str]) -> None:
    """A query that is one indexed directive, with each row's place in its order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ((table, inner),) = d.items()
        db = database(spark, sf_dir)
        found, order = select_rows(db.table(table).view(), parse_query(inner), db.table(table).search_view)
        return found.frame.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("place", *columns)

    QUERIES[name], SQL[name] = run, sql


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
COLUMNS = ", ".join(ORDER_COLUMNS)
directive("scan_orders", f"SELECT {COLUMNS} FROM orders", {"orders": {"fields": ORDER_COLUMNS}})
directive("pk_get_order", f"SELECT {COLUMNS} FROM orders WHERE o_orderkey = 7", {"orders": {"pk": 7, "fields": ORDER_COLUMNS}})
directive("pk_text_order", f"SELECT {COLUMNS} FROM orders WHERE o_orderkey = 7", {"orders": {"pk": "7", "fields": ORDER_COLUMNS}})
directive("pk_composite_turn", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1", {"conversations": {"pk": 3, "sort": 1, "fields": ["conv_id", "turn", "role", "text"]}})
directive("pk_missing", f"SELECT {COLUMNS} FROM orders WHERE o_orderkey = -1", {"orders": {"pk": "no such key", "fields": ORDER_COLUMNS}})
directive("where_conj", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7", {"customer": {"where": {"c_mktsegment": "BUILDING", "c_nationkey": 7}, "fields": ["c_custkey", "c_name"]}})
directive("where_bool_is_no_number", "SELECT c_custkey FROM customer WHERE false", {"customer": {"where": {"c_nationkey": True}, "fields": ["c_custkey"]}})
directive("where_text_is_no_number", "SELECT c_custkey FROM customer WHERE false", {"customer": {"where": {"c_nationkey": "7"}, "fields": ["c_custkey"]}})
directive("where_double_equals_int", "SELECT c_custkey FROM customer WHERE c_nationkey = 7", {"customer": {"where": {"c_nationkey": 7.0}, "fields": ["c_custkey"]}})
directive("project_missing_field", "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS nickname FROM supplier", {"supplier": {"fields": ["s_suppkey", "nickname"]}})
directive("gsi_hash", f"SELECT {COLUMNS} FROM orders WHERE o_orderstatus = 'F'", {"orders": {"index": "by_status", "where": {"o_orderstatus": "F"}, "fields": ORDER_COLUMNS}})
directive("gsi_hash_extra_where_ignored", f"SELECT {COLUMNS} FROM orders WHERE o_orderstatus = 'O'", {"orders": {"index": "by_status", "where": {"o_orderstatus": "O", "o_custkey": 1}, "fields": ORDER_COLUMNS}})
directive("gsi_missing_partition", "SELECT o_orderkey FROM orders WHERE false", {"orders": {"index": "by_status", "where": {"o_custkey": 1}, "fields": ["o_orderkey"]}})
directive("sort_cond_hash_only", "SELECT o_orderkey FROM orders WHERE false", {"orders": {"index": "by_status", "where": {"o_orderstatus": "F"}, "sort": {"gt": 1}, "fields": ["o_orderkey"]}})
directive("sort_unknown_operator", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", {"orders": {"index": "by_status_price", "where": {"o_orderstatus": "F"}, "sort": {"like": 1}, "fields": ["o_orderkey"]}})
by_customer = {"index": "by_customer", "where": {"o_custkey": 19}}
ordered("gsi_range_asc", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey FROM orders WHERE o_custkey = 19", {"orders": by_customer}, ["o_orderkey"])
ordered("gsi_range_desc", "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey FROM orders WHERE o_custkey = 19", {"orders": by_customer | {"sort_direction": "desc"}}, ["o_orderkey"])
ordered("gsi_hash_desc", "SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS place, o_orderkey FROM orders WHERE o_orderstatus = 'P'", {"orders": {"index": "by_status", "where": {"o_orderstatus": "P"}, "sort_direction": "desc"}}, ["o_orderkey"])
ordered("flagship_customer_orders", "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 19 AND o_orderdate >= TIMESTAMP '1996-01-01'", {"orders": by_customer | {"sort": {"gte": "1996-01-01"}, "sort_direction": "desc"}}, ["o_orderkey", "o_totalprice"])
for op, sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    directive(f"sort_{op}", f"SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal {sign} 1000", {"customer": {"index": "by_segment", "where": {"c_mktsegment": "BUILDING"}, "sort": {op: 1000}, "fields": ["c_custkey"]}})
    directive(f"sort_text_{op}", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority {sign} '3-MEDIUM'", {"orders": {"index": "by_status_priority", "where": {"o_orderstatus": "F"}, "sort": {op: "3-MEDIUM"}, "fields": ["o_orderkey"]}})
directive("sort_between", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 5000", {"customer": {"index": "by_segment", "where": {"c_mktsegment": "BUILDING"}, "sort": {"between": ["1000", 5000]}, "fields": ["c_custkey"]}})
directive("sort_begins_with", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND starts_with(o_orderpriority, '1')", {"orders": {"index": "by_status_priority", "where": {"o_orderstatus": "F"}, "sort": {"begins_with": "1"}, "fields": ["o_orderkey"]}})
directive("sort_contains", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND contains(o_orderpriority, 'LOW')", {"orders": {"index": "by_status_priority", "where": {"o_orderstatus": "F"}, "sort": {"contains": "LOW"}, "fields": ["o_orderkey"]}})
PAGE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT {n} OFFSET {k}"
status_page = {"index": "by_status_price", "where": {"o_orderstatus": "F"}, "fields": ["o_orderkey"]}
directive("page_first", PAGE.format(n=25, k=0), {"orders": status_page | {"limit": 25}})
directive("page_second", PAGE.format(n=25, k=25), {"orders": status_page | {"limit": 25, "next_token": "25"}})
directive("page_last", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20", {"nation": {"limit": 10, "next_token": "20", "fields": ["n_nationkey"]}})
directive("page_desc", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10", {"orders": status_page | {"limit": 10, "sort_direction": "desc"}})
WORD = r"list_filter(list_transform(regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}]+'), lambda t: lower(t)), lambda t: t <> '')"
TOKENS = WORD.format(c="text")
directive("search_single", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'idiot')", {"documents": {"search": "Idiot", "fields": ["doc_id"]}})
directive("search_multi_and", f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'erth'])", {"documents": {"search": "the, ERTH the", "fields": ["doc_id"]}})
directive("search_where", f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the']) AND lang = 'en' AND source = 'src1'", {"documents": {"search": "the", "where": {"lang": "en", "source": "src1"}, "fields": ["doc_id"]}})
directive("search_no_match", "SELECT doc_id FROM documents WHERE false", {"documents": {"search": "zzzznosuchword", "fields": ["doc_id"]}})
directive("search_empty", "SELECT doc_id FROM documents WHERE false", {"documents": {"search": " ,. ", "fields": ["doc_id"]}})


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS})) AS token FROM documents) GROUP BY token")
def search_token_df(spark, sf_dir):
    view = database(spark, sf_dir).table("documents").view()
    return postings(view, ["text"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_id FROM benchmark WHERE list_has_all({TOKENS}, ['the', 'of'])")
def search_postings(spark, sf_dir):
    view = database(spark, sf_dir).table("benchmark").view()
    return search_all(view, postings(view, ["text"]), ["the", "of"]).frame.select("item_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS c FROM orders) WHERE c IS NOT DISTINCT FROM NULL")
def where_null_safe(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("c", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    return View(spec("orders"), rows).where({"c": None}).frame.select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS sk FROM orders) WHERE o_orderstatus = 'F' AND sk IS NOT NULL")
def gsi_null_sort_skipped(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("sk", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return View(spec("orders"), rows).partition(GsiSpec("g", "o_orderstatus", "sk"), "F").frame.select("o_orderkey")


@query(r"""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS sk FROM orders)
WHERE o_orderstatus = 'F' AND (CASE WHEN regexp_full_match(sk, '[0-9]+') THEN TRY_CAST(sk AS DOUBLE) > 900 ELSE true END)""")
def sort_coerced_string(spark, sf_dir):
    sk = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("sk", sk)
    return View(spec("orders"), rows).partition(GsiSpec("g", "o_orderstatus", "sk"), "F", Sort.gt("900")).frame.select("o_orderkey")


@query("""SELECT row_number() OVER (ORDER BY r, n, s, c_custkey) AS place, c_custkey FROM (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS r,
  CASE c_custkey % 5 WHEN 1 THEN CASE WHEN c_nationkey > 12 THEN 1 ELSE 0 END WHEN 2 THEN c_nationkey WHEN 4 THEN c_acctbal ELSE 0 END AS n,
  CASE c_custkey % 5 WHEN 3 THEN c_name ELSE '' END AS s FROM customer)""")
def mixed_type_order(spark, sf_dir):
    k, text = F.col("c_custkey") % 5, F.to_json(F.struct("c_name"))
    raw = (
        F.when(k == 1, F.when(F.col("c_nationkey") > 12, "true").otherwise("false")).when(k == 2, F.col("c_nationkey").cast("string"))
        .when(k == 3, F.regexp_extract(text, r"^\{[^:]*:(.*)\}$", 1)).when(k == 4, F.col("c_acctbal").cast("string")).otherwise("null")
    )
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("v", F.parse_json(raw))
    place = F.row_number().over(Window.orderBy(value_of(rows, "v").order, "c_custkey"))
    return rows.select(place.cast("long").alias("place"), "c_custkey")


@query("SELECT count(*) AS n FROM orders")
def count_table(spark, sf_dir):
    return database(spark, sf_dir).table("orders").view().frame.agg(F.count(F.lit(1)).alias("n"))


def _count(value):
    def run(spark, sf_dir):
        view = database(spark, sf_dir).table("orders").view()
        return view.partition(view.spec.gsis["by_status"], value).frame.agg(F.count(F.lit(1)).alias("n"))

    return run


QUERIES |= {"count_partition": _count("F"), "count_missing_partition": _count("none")}
SQL |= {"count_partition": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", "count_missing_partition": "SELECT count(*) AS n FROM orders WHERE false"}


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def partition_sizes(spark, sf_dir):
    view = database(spark, sf_dir).table("orders").view()
    return view.members(view.spec.gsis["by_status"]).frame.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _edge(db: Database, table: str, name: str, inner: dict | None = None) -> DataFrame:
    view = db.table(table).view()
    return resolve(view, view.spec.associations[name], inner or {}, lambda t: db.table(t).view())


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def belongs_to_customer(spark, sf_dir):
    return _edge(database(spark, sf_dir), "orders", "customer").select("o_orderkey", F.col("_inc_customer.c_name").alias("c_name"))


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def belongs_to_optional_label(spark, sf_dir):
    return _edge(database(spark, sf_dir), "documents", "label").select("doc_id", F.col("_inc_label.toxic").alias("toxic"))


def _ids(column: str, field: str):
    return F.array_join(F.transform(F.col(column), lambda x: x[field].cast("string")), ",")


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def has_many_orders(spark, sf_dir):
    return _edge(database(spark, sf_dir), "customer", "orders").select("c_custkey", _ids("_inc_orders", "o_orderkey").alias("orders"))


@query("SELECT c_custkey, '' AS orders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def has_many_empty(spark, sf_dir):
    rows = _edge(database(spark, sf_dir), "customer", "orders")
    return rows.where(F.size("_inc_orders") == 0).select("c_custkey", _ids("_inc_orders", "o_orderkey").alias("orders"))


@query("SELECT l_orderkey AS o_orderkey, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def through_parts(spark, sf_dir):
    rows = _edge(database(spark, sf_dir), "orders", "parts")
    rows = rows.select("o_orderkey", F.explode("_inc_parts").alias("p")).select("o_orderkey", F.col("p.p_partkey").alias("p_partkey"))
    return rows.groupBy("o_orderkey", "p_partkey").agg(F.count(F.lit(1)).alias("n"))


def _tree(spark, sf_dir) -> Database:
    """Parts as a tree: the parent of a part is its key divided by ten."""
    from .table import Table

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).alias("parent"))
    table = Table("part", primary_key="p_partkey", frame=rows)
    table.add_gsi("by_parent", "parent")
    table.add_belongs_to("parent_part", "part", "parent")
    table.add_has_many("children", "part", "by_parent")
    db = Database(spark)
    db.add_table("part", table)
    return db


@query("SELECT a.p_partkey, coalesce(string_agg(b.p_partkey, ',' ORDER BY b.p_partkey), '') AS children FROM part a LEFT JOIN part b ON b.p_partkey >= 10 AND b.p_partkey // 10 = a.p_partkey GROUP BY 1")
def self_ref_children(spark, sf_dir):
    return _edge(_tree(spark, sf_dir), "part", "children").select("p_partkey", _ids("_inc_children", "p_partkey").alias("children"))


@query("SELECT a.p_partkey, b.p_name AS parent_name FROM part a LEFT JOIN part b ON a.p_partkey >= 10 AND b.p_partkey = a.p_partkey // 10")
def self_ref_parent(spark, sf_dir):
    return _edge(_tree(spark, sf_dir), "part", "parent_part").select("p_partkey", F.col("_inc_parent_part.p_name").alias("parent_name"))


FIFTY = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, c_custkey LIMIT 50"
FIFTY_PAGE = {"index": "by_segment", "where": {"c_mktsegment": "BUILDING"}, "limit": 50}


@query(f"SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, count(*) AS n FROM ({FIFTY}) JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def nested_three_levels(spark, sf_dir):
    rows = database(spark, sf_dir).query({"customer": FIFTY_PAGE | {"include": {"orders": {"include": {"lines": {}}}}}})
    rows = rows.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.explode("o.lines").alias("l"))
    rows = rows.select("c_custkey", "o_orderkey", F.col("l.l_linenumber").alias("l_linenumber"), F.col("l.l_partkey").alias("l_partkey"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def nested_three_levels_whole(spark, sf_dir):
    rows = database(spark, sf_dir).query({"customer": {"include": {"orders": {"include": {"lines": {}}}}}})
    rows = rows.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.explode("o.lines").alias("l"))
    rows = rows.select("c_custkey", "o_orderkey", F.col("l.l_linenumber").alias("l_linenumber"), F.col("l.l_partkey").alias("l_partkey"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def nested_belongs_to_chain_whole(spark, sf_dir):
    rows = database(spark, sf_dir).query({"customer": {"include": {"nation": {"include": {"region": {}}}}}})
    return rows.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


@query(f"SELECT c_custkey, o_orderkey, o_totalprice FROM ({FIFTY}) JOIN orders ON o_custkey = c_custkey")
def nested_projection(spark, sf_dir):
    rows = database(spark, sf_dir).query({"customer": FIFTY_PAGE | {"fields": ["c_custkey"], "include": {"orders": {"fields": ["o_orderkey", "o_totalprice"], "limit": 1}}}})
    return rows.select("c_custkey", F.inline("orders"))


@query(f"SELECT c_custkey, n_name, r_name FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, c_custkey LIMIT 50) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def nested_belongs_to_chain(spark, sf_dir):
    rows = database(spark, sf_dir).query({"customer": FIFTY_PAGE | {"include": {"nation": {"include": {"region": {}}}}}})
    return rows.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


def _orphans(spark, sf_dir, keep) -> DataFrame:
    db = database(spark, sf_dir)
    views = {"orders": db.table("orders").view()}
    customers = db.table("customer").view()
    views["customer"] = customers.on(customers.frame.where(keep))
    return violations([views["orders"]], lambda t: views[t])


@query("SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS record_pk, 'customer' AS association, 'o_custkey' AS foreign_key, CAST(o_custkey AS VARCHAR) AS missing_target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def validate_orders(spark, sf_dir):
    return _orphans(spark, sf_dir, F.col("c_custkey") % 7 != 0)


@query("SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS record_pk, 'customer' AS association, 'o_custkey' AS foreign_key, CAST(o_custkey AS VARCHAR) AS missing_target FROM orders WHERE false")
def validate_clean(spark, sf_dir):
    return _orphans(spark, sf_dir, F.lit(True))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'second' WHEN s_suppkey % 2 = 0 THEN 'first' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'second' FROM supplier WHERE s_suppkey % 4 = 0")
def upsert_last_write(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    one = base.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("first").alias("s_name"), F.lit(1).alias("at"))
    two = base.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit("second").alias("s_name"), F.lit(2).alias("at"))
    new = two.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    changes = last_write(one.unionByName(two).unionByName(new), ["s_suppkey"], [F.col("at")]).drop("at")
    return upsert(base, changes, ["s_suppkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return delete_keys(rows, rows.where("o_orderstatus = 'P'"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def _manifests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.col("p_partkey"), F.lit(".json")).alias("file_name")
    old = rows.where("p_partkey % 10 <> 1").select(name, F.lit(1).cast("long").alias("mtime"), F.col("p_size").cast("long").alias("size"))
    grown = F.col("p_size") + F.when(F.col("p_partkey") % 10 == 3, 1).otherwise(0)
    new = rows.where("p_partkey % 10 <> 2").select(name, F.lit(1).cast("long").alias("mtime"), grown.cast("long").alias("size"))
    return old, new


@query("SELECT p_partkey || '.json' AS file_name, CASE p_partkey % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 IN (1, 2, 3)")
def manifest_diff(spark, sf_dir):
    return diff_frames(*_manifests(spark, sf_dir))


@query("SELECT p_partkey || '.json' AS file_name, CASE WHEN p_partkey % 10 = 3 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 10 <> 2")
def refresh_snapshot(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    change = diff_frames(old, new)
    kept = delete_keys(old, change.where("change <> 'added'"), ["file_name"])
    reread = new.join(change.where("change <> 'deleted'").select("file_name"), "file_name", "left_semi")
    return kept.unionByName(reread).select("file_name", "size")


@query("SELECT sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS missing_key, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS missing_index_field FROM orders")
def put_validation_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    view = View(spec("orders"), rows)
    count = lambda f: F.sum(view.value(f).is_null.cast("long"))
    return rows.agg(count("o_orderkey").alias("missing_key"), count("o_orderstatus").alias("missing_index_field"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def index_only_join_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = rows.select("doc_id", "source")  # the narrow part stays hot, documents are read by key
    hits = View(TableSpec("documents", "doc_id"), index).partition(GsiSpec("by_source", "source"), "src3").frame.select("doc_id")
    return rows.join(hits, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


from . import folders  # noqa: E402, F401  registers the queries of file-backed tables
