"""The corpus pipeline: five of the operators in a row, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages rows are written
as Parquet and read back. run() applies all stages to the documents of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docframe.llm.common import materialize, table
from docframe.llm.line_dedup import dedup_documents
from docframe.llm.mixing import mix_documents
from docframe.llm.near_dedup import keep_one
from docframe.llm.packing import pack_documents
from docframe.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_documents),
    ("near dedup", keep_one),
    ("mixing", mix_documents),
    ("packing", pack_documents),
]

#: SQL can't express a trained classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
