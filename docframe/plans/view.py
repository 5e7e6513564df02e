"""A table's rows as the compiler sees them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Condition
from ..functions.values import Value, value_of
from ..spec import GsiSpec, TableSpec

DOC = "__doc__"
SEPARATOR = "__"


@dataclass(frozen=True)
class View:
    """spec and frame; ``doc`` names the variant column of schemaless rows, which also hold
    ``_pk``. Typed rows have columns only, and their key is computed from them. ``cut`` says that
    frame holds some rows of the table only."""

    spec: TableSpec
    frame: DataFrame
    doc: str | None = None
    cut: bool = False

    def on(self, frame: DataFrame, cut: bool | None = None) -> View:
        return replace(self, frame=frame, cut=self.cut if cut is None else cut)

    def value(self, name: str) -> Value:
        return value_of(self.frame, name, self.doc)

    @property
    def pk(self) -> Column:
        """The key as text; two parts are joined by two underscores."""
        if self.doc:
            return F.col("_pk")
        return F.concat_ws(SEPARATOR, *[self.value(f).text for f in self.spec.key_fields]) if len(self.spec.key_fields) > 1 else self.value(self.spec.key_fields[0]).text

    @property
    def ties(self) -> list[Column]:
        """What makes any order of this table's rows total."""
        return [F.col("_pk")] if self.doc else [self.value(f).order for f in self.spec.key_fields]

    def where(self, conditions: dict[str, Any]) -> View:
        if not conditions:
            return self
        return self.on(self.frame.where(reduce(lambda a, b: a & b, [self.value(k).equals(v) for k, v in conditions.items()])))

    def by_key(self, pk: Any, sort: Any = None) -> View:
        """Rows of one key; literals take the type of a typed key so that the scan can use them."""
        parts = [pk] if sort is None else [pk, sort]
        if self.doc or len(parts) != len(self.spec.key_fields):
            return self.on(self.frame.where(self.pk == F.lit(SEPARATOR.join(map(_plain, parts)))))
        found = []
        for name, part in zip(self.spec.key_fields, parts):
            v = self.value(name)
            if isinstance(v.dtype, T.IntegralType):
                try:
                    found.append(v.column == F.lit(int(_plain(part))))
                except ValueError:
                    found.append(F.lit(False))
            else:
                found.append(v.column == F.lit(_plain(part)) if v.kind == "string" else v.text == F.lit(_plain(part)))
        return self.on(self.frame.where(reduce(lambda a, b: a & b, found)))

    def by_keys(self, keys: list[Any]) -> View:
        """Rows of many keys, by one join; keys are what the caller holds, so few enough to send."""
        names, session = self.spec.key_fields, self.frame.sparkSession
        known = session.createDataFrame([(_plain(k) if not isinstance(k, tuple) else SEPARATOR.join(map(_plain, k)),) for k in keys], "_key string").distinct()
        value = self.value(names[0])
        if not self.doc and len(names) == 1 and isinstance(value.dtype, T.IntegralType):
            known = known.select(F.col("_key").try_cast(value.dtype).alias("_key"))
            return self.on(self.frame.join(F.broadcast(known), value.column == F.col("_key"), "left_semi"), True)
        return self.on(self.frame.join(F.broadcast(known), self.pk == F.col("_key"), "left_semi"), True)

    def members(self, gsi: GsiSpec) -> View:
        """Rows that an index holds: those with a partition value, and a sort value if it has one."""
        present = ~self.value(gsi.partition_key).is_null
        if gsi.sort_key:
            present = present & ~self.value(gsi.sort_key).is_null
        return self.on(self.frame.where(present))

    def partition(self, gsi: GsiSpec, value: Any, condition: Condition | None = None) -> View:
        """Rows of one partition of an index, of those with a sort value that meets condition."""
        if value is None:
            return self.on(self.frame.where(F.lit(False)))
        view = self.on(self.frame.where(self.value(gsi.partition_key).equals(value))).members(gsi)
        if condition is not None:
            met = condition.column(view.value(gsi.sort_key)) if gsi.sort_key else F.lit(False)
            view = view.on(view.frame.where(met))
        return view

    def order(self, gsi: GsiSpec | None = None, descending: bool = False) -> list[Column]:
        """A total order: by the sort key of an index if given, then by key; reversed as a whole."""
        columns = ([self.value(gsi.sort_key).order] if gsi and gsi.sort_key else []) + self.ties
        return [c.desc() if descending else c.asc() for c in columns]

    def payload(self, fields: list[str] | None = None, includes: tuple[str, ...] = ()) -> Column:
        """One struct per record: chosen or all fields, then the included columns."""
        if self.doc and not fields:
            parts = [F.col(self.doc).alias(DOC)]
        else:
            names = fields or [c for c in self.frame.columns if not c.startswith("_inc_") and c not in ("_rn",)]
            parts = [self.value(n).column.alias(n) for n in dict.fromkeys(names)]
        return F.struct(*parts, *[F.col(f"_inc_{i}").alias(i) for i in includes])


def _plain(v: Any) -> str:
    return v if isinstance(v, str) else "true" if v is True else "false" if v is False else str(v)
