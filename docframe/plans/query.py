"""Directives to plans.

A directive becomes a QuerySpec, a QuerySpec a lazy DataFrame. The page is cut first, then
associations are joined to it: one join per edge of the include tree, however many records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import parse_condition
from ..functions.text import query_tokens
from ..spec import AssociationSpec
from .view import View

KNOWN = ("pk", "where", "index", "search", "fields", "limit", "sort", "sort_direction", "next_token", "include")


@dataclass
class QuerySpec:
    pk: Any = None
    key_sort: Any = None
    where: dict[str, Any] = field(default_factory=dict)
    index: str | None = None
    search: str | None = None
    fields: list[str] = field(default_factory=list)
    limit: int | None = None
    sort: Any = None
    descending: bool = False
    start: int = 0
    include: dict[str, dict] = field(default_factory=dict)

    @property
    def single(self) -> bool:
        return self.pk is not None

    @property
    def selects(self) -> bool:
        """Whether the query leaves rows of its table out."""
        return self.single or self.limit is not None or bool(self.where) or self.index is not None or self.search is not None


def parse_query(directive: dict[str, Any] | None) -> QuerySpec:
    d = directive or {}
    if not isinstance(d, dict):
        raise ValueError(f"a directive is a mapping, not {d!r}")
    limit, token = d.get("limit"), d.get("next_token")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError(f"limit takes a positive integer, not {limit!r}")
    start = 0
    if token is not None and limit is not None:
        if isinstance(token, bool) or not str(token).isdigit():
            raise ValueError(f"next_token takes what a page returned, not {token!r}")
        start = int(token)
    single = d.get("pk") is not None
    return QuerySpec(
        d.get("pk"), d.get("sort") if single else None, dict(d.get("where") or {}), d.get("index"), d.get("search"), list(d.get("fields") or []),
        limit, None if single else parse_condition(d.get("sort")), d.get("sort_direction") == "desc", start, dict(d.get("include") or {}),
    )


def select_rows(view: View, q: QuerySpec, search: Callable[[View, list[str]], View]) -> tuple[View, list[Column]]:
    """The rows that a query finds, and their order. pk goes before search, index and scan; the
    index path reads its partition key from ``where`` and ignores the rest of it."""
    if q.single:
        return view.by_key(q.pk, q.key_sort), view.order()
    if q.search is not None:
        found = search(view, query_tokens(q.search)).where(q.where)
        return found, found.order()
    if q.index is not None:
        if q.index not in view.spec.gsis:
            raise KeyError(f"table {view.spec.name!r} has no index {q.index!r}")
        gsi = view.spec.gsis[q.index]
        found = view.partition(gsi, q.where.get(gsi.partition_key), q.sort)
        return found, found.order(gsi, q.descending)
    found = view.where(q.where)
    return found, found.order()


def expand(view: View, include: dict[str, dict], tables: Callable[[str], View]) -> DataFrame:
    """view's rows with a column _inc_<name> for each association included."""
    frame = view.frame
    for name, directive in include.items():
        if name not in view.spec.associations:
            raise KeyError(f"table {view.spec.name!r} has no association {name!r}")
        frame = resolve(view.on(frame), view.spec.associations[name], directive or {}, tables)
    return frame


def _related(view: View, directive: dict[str, Any], tables: Callable[[str], View]) -> DataFrame:
    """Related rows with their own includes, and their records as _inc_payload."""
    inner = dict(directive.get("include") or {})
    expanded = view.on(expand(view, inner, tables))
    return expanded.frame.withColumn("_inc_payload", expanded.payload(list(directive.get("fields") or []), tuple(inner)))


def _collected(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """(key, out): the payloads of each key in order; duplicates stay."""
    items = F.collect_list(F.struct(F.struct(*order).alias("o"), F.col("_inc_payload").alias("v")))
    ordered = F.array_sort(items, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias(out))


def resolve(view: View, edge: AssociationSpec, directive: dict[str, Any], tables: Callable[[str], View]) -> DataFrame:
    """view's rows with _inc_<edge>: a struct or null, or an array.

    Helper columns are numbered, since rows that an outer level selected carry its own.
    """
    out, target, level = f"_inc_{edge.name}", tables(edge.table), len(view.frame.columns)
    key, sort, place, goal_key = (f"_inc_{level}_{x}" for x in ("key", "sort", "place", "goal"))
    own = view.value(edge.foreign_key if edge.kind == "belongs_to" else view.spec.own_key).text
    left = view.frame.withColumn(key, own)
    # what a selection relates to is cut to its keys before it is gathered; a whole table would
    # only be read twice for that
    cut = view.cut
    keys = left.select(key).where(F.col(key).isNotNull()).distinct() if cut else None
    of_keys = lambda rows, on: rows.join(keys, on, "left_semi") if cut else rows
    if edge.kind == "belongs_to":
        found = target.on(of_keys(target.frame.withColumn(key, target.pk), key), cut)
        one = _related(found, directive, tables).select(key, F.col("_inc_payload").alias(out))
        return left.join(one, key, "left").drop(key)
    if edge.kind == "has_many":
        children = target.members(gsi := _gsi(target, edge.index))
        by = children.value(gsi.sort_key).order if gsi.sort_key else F.lit(0)
        rows = children.frame.withColumns({key: children.value(gsi.partition_key).text, sort: by, place: _tie(children)})
        found = _related(target.on(of_keys(rows, key), cut), directive, tables)
    else:
        junction = tables(edge.through)
        links = junction.members(gsi := _gsi(junction, edge.index))
        by = links.value(gsi.sort_key).order if gsi.sort_key else F.lit(0)
        links = links.frame.select(links.value(gsi.partition_key).text.alias(key), by.alias(sort), _tie(links).alias(place), links.value(edge.foreign_key).text.alias(goal_key))
        links = of_keys(links, key)
        goal = target.frame.withColumn(goal_key, target.pk)
        if cut:
            goal = goal.join(links.select(goal_key).where(F.col(goal_key).isNotNull()).distinct(), goal_key, "left_semi")
        goal = target.on(goal, cut)
        found = links.join(_related(goal, directive, tables).select(goal_key, "_inc_payload"), goal_key)
    many = _collected(found, key, [sort, place], out)
    kind = many.schema[out].dataType.simpleString()
    return left.join(many, key, "left").withColumn(out, F.coalesce(out, F.expr(f"cast(array() as {kind})"))).drop(key)


def _tie(view: View) -> Column:
    return F.struct(*[c.alias(f"t{i}") for i, c in enumerate(view.ties)])


def _gsi(view: View, name: str):
    if name not in view.spec.gsis:
        raise KeyError(f"table {view.spec.name!r} has no index {name!r}")
    return view.spec.gsis[name]


def page(view: View, order: list[Column], q: QuerySpec) -> DataFrame:
    """The rows of a page, numbered by _rn; offset and limit on a total order plan as a top-k."""
    if q.limit is None:
        return view.frame
    rows = view.frame.orderBy(*order).offset(q.start).limit(q.limit)
    return rows.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))


def compile_query(view: View, q: QuerySpec, search, tables) -> tuple[DataFrame, list[Column]]:
    """(rows with one struct column ``record``, their order)."""
    found, order = select_rows(view, q, search)
    rows = page(found, order, q)
    if q.limit is not None:
        order = [F.col("_rn").asc()]
    expanded = found.on(expand(found.on(rows, q.selects), q.include, tables))
    record = expanded.payload(q.fields, tuple(q.include))
    return expanded.frame.withColumn("record", record), order
