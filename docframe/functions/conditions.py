"""Conditions on the sort key of an index.

A condition compiles to a Column and can be called on a Python value; both coerce strings that
spell numbers, on either side, and are false for null.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import NUMERIC, STRING, Value, coerced, key_of, literal_key, rank_of, text_of

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
TEXT = ("begins_with", "contains")


@dataclass(frozen=True)
class Condition:
    op: str
    args: tuple

    def __call__(self, value: Any) -> bool:
        if value is None:
            return False
        if self.op in TEXT:
            text, part = text_of(value), text_of(self.args[0])
            return text.startswith(part) if self.op == "begins_with" else part in text
        key = key_of(coerced(value))
        if self.op == "between":
            return key_of(coerced(self.args[0])) <= key <= key_of(coerced(self.args[1]))
        return COMPARE[self.op](key, key_of(coerced(self.args[0])))

    def column(self, value: Value) -> Column:
        if value.kind == "absent":
            return F.lit(False)
        if self.op in TEXT:
            part = F.lit(text_of(self.args[0]))
            found = value.text.startswith(part) if self.op == "begins_with" else F.contains(value.text, part)
        elif self.op == "between":
            found = _compare(value, "gte", self.args[0]) & _compare(value, "lte", self.args[1])
        else:
            found = _compare(value, self.op, self.args[0])
        return F.coalesce(found & ~value.is_null, F.lit(False)) if value.kind in ("variant", "other") or self.op == "ne" else found


def _compare(value: Value, op: str, other: Any) -> Column:
    compare, other = COMPARE[op], coerced(other)
    if value.kind == "number" and rank_of(other) == rank_of(0):
        return compare(value.column, F.lit(other))
    if value.kind == "time" and rank_of(other) == STRING:
        return compare(value.column, F.lit(other).try_cast(value.dtype))
    if value.kind == "string" and rank_of(other) == STRING:
        # strings that spell numbers rank below all others; the plain comparison is pushed down
        numeric, plain = value.column.rlike(NUMERIC), compare(value.column, F.lit(other))
        return plain | numeric if op in ("lt", "lte", "ne") else plain & ~numeric
    return F.when(~value.is_null, compare(value.key(coerce=True), literal_key(other)))


class Sort:
    """Constructors of conditions."""

    eq = staticmethod(lambda v: Condition("eq", (v,)))
    ne = staticmethod(lambda v: Condition("ne", (v,)))
    lt = staticmethod(lambda v: Condition("lt", (v,)))
    lte = staticmethod(lambda v: Condition("lte", (v,)))
    gt = staticmethod(lambda v: Condition("gt", (v,)))
    gte = staticmethod(lambda v: Condition("gte", (v,)))
    between = staticmethod(lambda low, high: Condition("between", (low, high)))
    begins_with = staticmethod(lambda v: Condition("begins_with", (v,)))
    contains = staticmethod(lambda v: Condition("contains", (v,)))


def parse_condition(d: Any) -> Condition | None:
    """The condition of a ``sort`` directive: its first operator; unknown operators filter nothing."""
    if isinstance(d, Condition) or d is None:
        return d
    if not isinstance(d, dict):
        raise ValueError(f"sort takes a mapping of an operator to its value, not {d!r}")
    for op, v in d.items():
        if op == "between":
            if not isinstance(v, (list, tuple)) or len(v) != 2:
                raise ValueError(f"between takes [low, high], not {v!r}")
            return Sort.between(*v)
        return Condition(op, (v,)) if op in COMPARE or op in TEXT else None
    return None
