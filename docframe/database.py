"""Named tables and the nested-dict query language over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.integrity import violations
from .plans.query import compile_query, parse_query
from .plans.view import DOC, View
from .spec import TableSpec, load_schema, parse_schema
from .table import Table, collect_records


class Database:
    def __init__(self, spark: SparkSession | None = None, loader: Callable[[str], Table | None] | None = None):
        """loader: gives a table when it is first named, or None where there is no such table."""
        self._spark, self._loader = spark, loader
        self.tables: dict[str, Table] = {}

    def add_table(self, name: str, table: Table | DataFrame, **spec: Any) -> Table:
        """Register a table, or a DataFrame with the keywords of a table's description."""
        self.tables[name] = table if isinstance(table, Table) else Table(name, frame=table, **spec)
        return self.tables[name]

    @classmethod
    def _from_specs(cls, specs: dict[str, TableSpec], spark: SparkSession | None) -> Database:
        db = cls(spark)
        for name, spec in specs.items():
            db.tables[name] = Table(name, spec=spec, spark=spark)
        for t in db.tables.values():
            if t.directory:
                t.load_from_dir()
        return db

    @classmethod
    def from_schema(cls, path: str, data_root: str | None = None, spark: SparkSession | None = None) -> Database:
        return cls._from_specs(load_schema(path, data_root), spark)

    @classmethod
    def from_schema_dict(cls, schema: dict[str, Any], data_root: str | None = None, spark: SparkSession | None = None) -> Database:
        return cls._from_specs(parse_schema(schema, data_root), spark)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            found = self._loader(name) if self._loader else None
            if found is None:
                raise KeyError(f"no table {name!r}")
            self.tables[name] = found
        return self.tables[name]

    def _view(self, name: str) -> View:
        t = self.table(name)
        t.fresh()
        return t.view()

    def _plan(self, directive: dict[str, Any]):
        if not isinstance(directive, dict) or len(directive) != 1:
            raise ValueError("a query names exactly one table")
        ((name, inner),) = directive.items()
        table, q = self.table(name), parse_query(inner)
        if not q.single:
            table.fresh()
        return table, q, table.view()

    def query(self, directive: dict[str, Any]) -> DataFrame:
        """The lazy half of execute: one column per field and per association, or ``doc`` for
        whole schemaless records."""
        table, q, view = self._plan(directive)
        rows, order = compile_query(view, q, table.search_view, self._view)
        out = rows.orderBy(*order) if q.limit is not None else rows  # a page; whole results have no order
        names = rows.schema["record"].dataType.names
        return out.select(*[F.col("record").getField(n).alias("doc" if n == DOC else n) for n in names])

    def execute(self, directive: dict[str, Any]) -> Any:
        """A record or None for ``pk``, else {"items": [...], "next_token"?}."""
        table, q, view = self._plan(directive)
        # one record beyond the page tells whether another page follows
        more = replace(q, limit=q.limit + 1) if q.limit is not None and not q.single else q
        rows, order = compile_query(view, more, table.search_view, self._view)
        items = collect_records(rows, order, q.include)
        if q.single:
            return items[0] if items else None
        out: dict[str, Any] = {"items": items}
        if q.limit is not None and len(items) > q.limit:
            out = {"items": items[: q.limit], "next_token": str(q.start + q.limit)}
        return out

    def describe(self) -> dict[str, Any]:
        return {name: t.describe() | {"stale": t.is_stale()} for name, t in self.tables.items()}

    def violations(self) -> DataFrame | None:
        return violations([t.view() for t in self.tables.values()], lambda n: self.table(n).view())

    def validate(self) -> list[dict[str, Any]]:
        found = self.violations()
        return [r.asDict() for r in found.orderBy("table", "record_pk", "association").collect()] if found is not None else []

    def check(self) -> dict[str, dict[str, int]]:
        return {name: t.check().to_dict() for name, t in self.tables.items()}

    def warm(self) -> dict[str, dict[str, int]]:
        return {name: t.warm().to_dict() for name, t in self.tables.items()}
