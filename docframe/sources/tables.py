"""Typed tables: any format that Spark reads, with its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
