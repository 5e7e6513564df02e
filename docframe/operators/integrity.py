"""Referential integrity: foreign keys of belongs_to edges that reach no record."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.view import View


def violations(views: list[View], tables: Callable[[str], View]) -> DataFrame | None:
    """(table, record_pk, association, foreign_key, missing_target): one anti-join per edge."""
    found = []
    for view in views:
        for edge in view.spec.associations.values():
            if edge.kind != "belongs_to":
                continue
            target = tables(edge.table)
            keys = target.frame.select(target.pk.alias("_k"))
            rows = view.frame.select(view.pk.alias("record_pk"), view.value(edge.foreign_key).text.alias("_fk")).where("_fk is not null")
            lost = rows.join(keys, F.col("_fk") == F.col("_k"), "left_anti")
            found.append(lost.select(
                F.lit(view.spec.name).alias("table"), "record_pk", F.lit(edge.name).alias("association"),
                F.lit(edge.foreign_key).alias("foreign_key"), F.col("_fk").alias("missing_target"),
            ))
    return reduce(DataFrame.unionByName, found) if found else None
