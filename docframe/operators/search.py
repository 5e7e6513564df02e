"""Keyword search over postings (token, key): all tokens of a query must occur."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_tokens
from ..plans.view import View


def tokens_of(view: View, fields: list[str]):
    arrays = [field_tokens(view.value(f)) for f in fields]
    return F.array_distinct(reduce(F.concat, arrays[1:], arrays[0]) if len(arrays) > 1 else arrays[0])


def postings(view: View, fields: list[str]) -> DataFrame:
    """(token, _key) once per token and record."""
    rows = view.frame.select(view.pk.alias("_key"), tokens_of(view, fields).alias("t"))
    return rows.select(F.explode("t").alias("token"), "_key")


def matching(view: View, fields: list[str], wanted: list[str]) -> View:
    """Rows that hold all tokens, straight from the texts: one narrow scan, no shuffle."""
    if not wanted:
        return view.on(view.frame.where(F.lit(False)))
    query = F.array(*[F.lit(t) for t in wanted])
    return view.on(view.frame.where(F.size(F.array_except(query, tokens_of(view, fields))) == 0))


def search_all(view: View, index: DataFrame, wanted: list[str]) -> View:
    """Rows that hold all tokens, through postings; the filter on token reaches their scan."""
    if not wanted:
        return view.on(view.frame.where(F.lit(False)))
    hits = index.where(F.col("token").isin(wanted)).groupBy("_key").agg(F.count_distinct("token").alias("n"))
    hits = hits.where(F.col("n") == len(wanted)).select(F.col("_key").alias("_hit"))
    keyed = view.frame.withColumn("_skey", view.pk)
    return view.on(keyed.join(hits, F.col("_skey") == F.col("_hit"), "left_semi").drop("_skey"))
