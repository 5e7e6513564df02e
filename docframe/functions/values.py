"""Values of fields that may hold any JSON type: total order, equality, coercion.

The order is null < bool < number < string < array < object. A value becomes a struct
(rank, num, str), which Spark compares field by field. Columns of one known type stay as they
are, so that filters on them reach the Parquet scan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_NUMERIC = re.compile(NUMERIC, re.ASCII)
NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT = range(6)


def rank_of(v: Any) -> int:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOL
    if isinstance(v, (int, float)):
        return NUMBER
    if isinstance(v, str):
        return STRING
    return ARRAY if isinstance(v, (list, tuple)) else OBJECT


def coerced(v: Any) -> Any:
    """Strings that spell a number become that number."""
    if isinstance(v, str) and _NUMERIC.match(v):
        return int(v) if re.fullmatch(r"[+-]?\d+", v, re.ASCII) else float(v)
    return v


def key_of(v: Any) -> tuple[int, float, str]:
    """The order of a Python value, as order_key has it for columns."""
    r = rank_of(v)
    num = float(v) if r in (BOOL, NUMBER) else 0.0
    return r, num, v if r == STRING else json.dumps(v, sort_keys=True, separators=(",", ":")) if r >= ARRAY else ""


def text_of(v: Any) -> str:
    return "true" if v is True else "false" if v is False else v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)


def literal_key(v: Any) -> Column:
    r, num, s = key_of(v)
    return F.struct(F.lit(r).alias("rank"), F.lit(num).alias("num"), F.lit(s).alias("str"))


@dataclass
class Value:
    """A field of a table's rows. kind: number, string, bool, time, other, variant or absent."""

    column: Column
    kind: str
    dtype: T.DataType | None = None

    @property
    def is_null(self) -> Column:
        if self.kind == "absent":
            return F.lit(True)
        return self.column.isNull() | F.is_variant_null(self.column) if self.kind == "variant" else self.column.isNull()

    @property
    def text(self) -> Column:
        """The value as text, null for null."""
        if self.kind == "variant":
            scalar = F.try_variant_get(self.column, "$", "string")
            return F.when(~F.coalesce(self.is_null, F.lit(True)), F.coalesce(scalar, F.to_json(self.column)))
        if self.kind == "other":
            return F.to_json(self.column) if isinstance(self.dtype, (T.StructType, T.ArrayType, T.MapType)) else self.column.cast("string")
        return self.column.cast("string")

    def key(self, coerce: bool = False) -> Column:
        """struct(rank, num, str); numeric strings count as numbers with coerce."""
        c, zero, none = self.column, F.lit(0.0), F.lit("")
        if self.kind == "variant":
            kind = F.schema_of_variant(c)
            rank = (
                F.when(F.coalesce(self.is_null, F.lit(True)), NULL).when(kind == "BOOLEAN", BOOL).when(kind == "STRING", STRING)
                .when(kind.startswith("ARRAY"), ARRAY).when(kind.startswith("OBJECT"), OBJECT).otherwise(NUMBER)
            )
            num = F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(c, "$", "double"))
            num = F.when(rank.isin(BOOL, NUMBER), F.coalesce(num, zero)).otherwise(zero)
            text = F.when(rank == STRING, F.try_variant_get(c, "$", "string")).when(rank >= ARRAY, F.to_json(c)).otherwise(none)
        else:
            own = {"number": NUMBER, "bool": BOOL, "string": STRING, "time": STRING, "absent": NULL}.get(self.kind, ARRAY if isinstance(self.dtype, T.ArrayType) else OBJECT)
            rank = F.when(self.is_null, NULL).otherwise(own)
            num = F.coalesce(c.cast("int").cast("double") if self.kind == "bool" else c.cast("double"), zero) if self.kind in ("number", "bool") else zero
            text = none if self.kind in ("number", "bool", "absent") else F.coalesce(self.text, none)
        if coerce and self.kind in ("variant", "string"):
            spelled = (rank == STRING) & F.coalesce(text.rlike(NUMERIC), F.lit(False))
            number = F.coalesce(text.try_cast("double"), zero)
            rank, num, text = F.when(spelled, NUMBER).otherwise(rank), F.when(spelled, number).otherwise(num), F.when(spelled, none).otherwise(text)
        return F.struct(rank.alias("rank"), num.alias("num"), text.alias("str"))

    @property
    def order(self) -> Column:
        return self.key() if self.kind in ("variant", "other") else self.column

    def equals(self, v: Any) -> Column:
        """Two-valued equality without coercion: numbers by value, bool is no number, null
        equals null and missing."""
        if v is None:
            return F.coalesce(self.is_null, F.lit(True))
        r = rank_of(v)
        if self.kind == "number":
            same = self.column == F.lit(v) if r == NUMBER else F.lit(False)
        elif self.kind == "string":
            same = self.column == F.lit(v) if r == STRING else F.lit(False)
        elif self.kind == "bool":
            same = self.column == F.lit(v) if r == BOOL else F.lit(False)
        elif self.kind == "time":
            same = self.column == F.lit(v).try_cast(self.dtype) if r == STRING else F.lit(False)
        elif self.kind == "absent":
            same = F.lit(False)
        else:
            same = self.key() == literal_key(v)
        return F.coalesce(same, F.lit(False)) if self.kind in ("variant", "other") else same


def value_of(df: DataFrame, name: str, doc: str | None = None) -> Value:
    """Field ``name`` of df's rows: a column, or a member of the variant column ``doc``."""
    if doc is not None:
        if "'" in name or "\\" in name:
            raise ValueError(f"field names with quotes or backslashes cannot be looked up: {name!r}")
        return Value(F.variant_get(F.col(doc), f"$['{name}']", "variant"), "variant")
    types = {f.name: f.dataType for f in df.schema.fields}
    if name not in types:
        return Value(F.lit(None).cast("string"), "absent")
    t, column = types[name], F.col(f"`{name}`")
    kinds = [(T.BooleanType, "bool"), (T.NumericType, "number"), (T.StringType, "string"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time"), (T.VariantType, "variant")]
    return Value(column, next((k for types_, k in kinds if isinstance(t, types_)), "other"), t)


def order_key(df: DataFrame, name: str, doc: str | None = None) -> Column:
    return value_of(df, name, doc).order
