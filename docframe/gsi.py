"""A secondary index as an object of its own, for records that the caller holds.

Its entries are rows of a table, and a query is a query of that table's index: an index is a
predicate and an order (plans.view). Tables do not need one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .functions.conditions import Condition
from .functions.values import text_of
from .spec import GsiSpec
from .table import Table

Predicate = Callable[[Any], bool]


class GSI:
    def __init__(self, name: str, partition_key: str, sort_key: str | None = None):
        self.spec = GsiSpec(name, partition_key, sort_key)
        self._entries, self._count = Table(name, primary_key="entry"), 0
        self._entries.add_gsi(name, "part", "sort" if sort_key else None)

    name = property(lambda self: self.spec.name)
    partition_key = property(lambda self: self.spec.partition_key)
    sort_key = property(lambda self: self.spec.sort_key)

    def put(self, pk: Any, record: dict[str, Any]) -> None:
        """Records without a partition value, or a sort value if the index has one, are skipped."""
        part, sort = record.get(self.partition_key), record.get(self.sort_key) if self.sort_key else None
        if part is None or self.sort_key and sort is None:
            return
        self._count += 1
        self._entries.put({"entry": f"{self._count:012d}", "pk": pk, "part": text_of(part), "sort": sort})

    def remove(self, pk: Any, record: dict[str, Any]) -> None:
        for entry in self._of(record.get(self.partition_key)):
            if entry["pk"] == pk:
                self._entries.delete(entry["entry"])

    def update(self, pk: Any, old: dict[str, Any], new: dict[str, Any]) -> None:
        self.remove(pk, old)
        self.put(pk, new)

    def _of(self, part: Any, condition: Condition | Predicate | None = None, descending: bool = False) -> list[dict[str, Any]]:
        return self._entries.query_gsi(self.name, text_of(part), condition, descending) if part is not None else []

    def query(self, partition_value: Any, sort_condition: Condition | Predicate | None = None, sort_direction: str = "asc") -> list[Any]:
        """Keys in order of sort value, then of insertion; desc reverses the whole list."""
        if sort_direction not in ("asc", "desc"):
            raise ValueError(f"sort_direction is asc or desc, not {sort_direction!r}")
        return [e["pk"] for e in self._of(partition_value, sort_condition, sort_direction == "desc")]
