"""Declarative table descriptions, from YAML, dicts or code."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

ASSOCIATION_KINDS = ("belongs_to", "has_many", "has_many_through")
VALIDATION_MODES = ("silent", "warn", "error")
STORAGE_MODES = ("memory", "index_only")


class SchemaError(ValueError):
    """A description that lacks a required field or has a wrong value."""


@dataclass(frozen=True)
class GsiSpec:
    name: str
    partition_key: str
    sort_key: str | None = None


@dataclass(frozen=True)
class AssociationSpec:
    name: str
    kind: str
    table: str
    index: str | None = None
    foreign_key: str | None = None
    through: str | None = None


@dataclass
class TableSpec:
    name: str
    primary_key: str | None = None
    partition_key: str | None = None
    sort_key: str | None = None
    directory: str | None = None
    validation: str = "silent"
    check_interval: float = 0
    auto_refresh: bool = True
    storage: str | None = None
    search_fields: list[str] = field(default_factory=list)
    gsis: dict[str, GsiSpec] = field(default_factory=dict)
    associations: dict[str, AssociationSpec] = field(default_factory=dict)

    def __post_init__(self) -> None:
        composite = self.partition_key is not None or self.sort_key is not None
        if self.primary_key is None and not (self.partition_key and self.sort_key):
            missing = "sort_key" if self.partition_key else "partition_key" if self.sort_key else "primary_key"
            raise SchemaError(f"table {self.name!r}: missing {missing}")
        if self.primary_key is not None and composite:
            raise SchemaError(f"table {self.name!r}: primary_key excludes partition_key and sort_key")
        if self.validation not in VALIDATION_MODES:
            raise SchemaError(f"table {self.name!r}: unknown validation {self.validation!r}")
        self.storage = self.storage or ("index_only" if self.directory else "memory")
        if self.storage not in STORAGE_MODES:
            raise SchemaError(f"table {self.name!r}: unknown storage {self.storage!r}")

    @property
    def key_fields(self) -> list[str]:
        return [self.primary_key] if self.primary_key else [self.partition_key, self.sort_key]

    @property
    def own_key(self) -> str:
        """The field whose value children refer to."""
        return self.primary_key or self.partition_key

    def indexed_fields(self) -> list[str]:
        return list(dict.fromkeys(f for g in self.gsis.values() for f in (g.partition_key, g.sort_key) if f))


def _need(d: dict[str, Any], key: str, where: str) -> Any:
    if not isinstance(d, dict) or d.get(key) is None:
        raise SchemaError(f"{where}: missing {key}")
    return d[key]


def parse_table(name: str, d: dict[str, Any], data_root: str | None) -> TableSpec:
    if not isinstance(d, dict):
        raise SchemaError(f"table {name!r}: a mapping is required")
    directory = d.get("directory")
    if directory is not None and data_root is not None:
        directory = os.path.join(data_root, directory)
    gsis = {}
    for g, x in (d.get("gsis") or {}).items():
        gsis[g] = GsiSpec(g, _need(x, "partition_key", f"table {name!r}, gsi {g!r}"), x.get("sort_key"))
    associations = {}
    for a, x in (d.get("associations") or {}).items():
        at = f"table {name!r}, association {a!r}"
        kind = _need(x, "type", at)
        if kind not in ASSOCIATION_KINDS:
            raise SchemaError(f"{at}: unknown type {kind!r}")
        needs = {"belongs_to": ["foreign_key"], "has_many": ["index"], "has_many_through": ["through", "index", "foreign_key"]}[kind]
        got = {k: _need(x, k, at) for k in needs}
        associations[a] = AssociationSpec(a, kind, _need(x, "table", at), **got)
    search = d.get("search") or {}
    return TableSpec(
        name, d.get("primary_key"), d.get("partition_key"), d.get("sort_key"), directory, d.get("validation", "warn"),
        storage=d.get("storage"), search_fields=list(search.get("fields") or []), gsis=gsis, associations=associations,
    )


def parse_schema(schema: dict[str, Any], data_root: str | None = None) -> dict[str, TableSpec]:
    tables = _need(schema, "tables", "schema")
    return {name: parse_table(name, d, data_root) for name, d in tables.items()}


def load_schema(path: str, data_root: str | None = None) -> dict[str, TableSpec]:
    import yaml

    with open(path) as f:
        return parse_schema(yaml.safe_load(f), data_root)
