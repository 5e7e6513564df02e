"""Immutable snapshots: upserts and deletes make a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows of one key the last in order."""
    last = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """base with changes in place of its rows of the same key. Among changes of one key the last
    in order wins. Only keys of the changes move, not a sort of everything."""
    new = last_write(changes, key, order) if order else changes
    return base.join(new.select(*key), key, "left_anti").unionByName(new)


def delete_keys(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key), key, "left_anti")
