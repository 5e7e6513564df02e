"""Keyword tokens: maximal runs of letters and digits, in lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Value

SPLIT = r"[^\p{L}\p{N}]+"
_SPLIT = re.compile(r"[\W_]+")


def tokens(text: Column) -> Column:
    """Split before lowering: lowering may add combining marks, which would split."""
    parts = F.filter(F.split(text, SPLIT), lambda t: t != "")
    return F.coalesce(F.transform(parts, lambda t: F.lower(t)), F.expr("cast(array() as array<string>)"))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in _SPLIT.split(query or "") if t))


def field_tokens(value: Value) -> Column:
    """Tokens of a string or of a list of strings; other types have none."""
    none = F.expr("cast(array() as array<string>)")
    if value.kind == "string":
        return tokens(value.column)
    if value.kind == "other" and isinstance(value.dtype, T.ArrayType) and isinstance(value.dtype.elementType, T.StringType):
        return F.coalesce(F.flatten(F.transform(value.column, tokens)), none)
    if value.kind == "variant":
        kind = F.schema_of_variant(value.column)
        own = tokens(F.try_variant_get(value.column, "$", "string"))
        members = F.try_variant_get(value.column, "$", "array<variant>")
        strings = F.filter(members, lambda m: F.schema_of_variant(m) == "STRING")
        listed = F.flatten(F.transform(strings, lambda m: tokens(F.try_variant_get(m, "$", "string"))))
        return F.when(kind == "STRING", own).when(kind.startswith("ARRAY"), F.coalesce(listed, none)).otherwise(none)
    return none
