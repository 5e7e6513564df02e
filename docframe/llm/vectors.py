"""What both vector searches share: vectors that take part, bounded cells, ranks.

Candidates are dealt to cells (a probed list, a band of lengths) and queries go to the cells
that they must look into. A cell may hold any share of all rows, so it is cut by hash into
``parts`` of bounded size, and its queries into ``turns`` of bounded size; a group of the
cogroup is one part of candidates and one turn of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = 4096
#: Candidates that are compared with all queries of a turn at one time.
STEP = 512
#: The share of a block's pairs below which they are followed one by one.
FEW = 0.15


def taking_part(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero_too: bool = True) -> tuple[DataFrame, int]:
    """((vec_id, v array<double>), dimensions): rows with an id and a vector that is not null,
    has no null or non-finite component and the length that most vectors have (of equally
    frequent lengths the largest). Without zero_too vectors of zeros are left out as well."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & (F.size("v") > 0))
    if not zero_too:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size("v") == d), d


def chosen(rows: DataFrame, is_query) -> DataFrame:
    """One row for each id that is_query holds of; of repeated ids the least vector counts."""
    return rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))


def kth_best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, have): the k-th best score of the queries that have so many."""
    return ranked(found, k, ascending).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("have"))


class Best:
    """The k least values found for each of n queries so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.query, self.value, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, value: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th least value of each query, infinite for those that have fewer."""
        query, value, ids = (np.concatenate(x) for x in ((self.query, query), (self.value, value), (self.id, ids)))
        order = np.lexsort((ids, value, query))
        query, value, ids = query[order], value[order], ids[order]
        first = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        self.query, self.value, self.id = query[keep], value[keep], ids[keep]
        out, last = np.full(self.n, np.inf), rank == self.k - 1
        out[query[last]] = value[last]
        return out


def matrix(column) -> np.ndarray:
    """float64 rows from a series of lists or arrays of one length."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def parts_of(counts: dict[int, int], most: int) -> dict[int, int]:
    return {k: max(1, math.ceil(n / most)) for k, n in counts.items()}


def number_of(cell, per_cell: dict[int, int]) -> F.Column:
    """A column with per_cell's value of column cell, else 0; the few cells are literals of the
    plan."""
    if not per_cell:
        return F.lit(0)
    numbers = F.array(*[F.lit(per_cell.get(k, 0)) for k in range(max(per_cell) + 1)])
    return F.coalesce(F.try_element_at(numbers, cell.cast("int") + 1), F.lit(0))


def search_cells(cands: DataFrame, queries: DataFrame, part_rows: int, search, schema: str, cells: int) -> DataFrame:
    """search(pdf of queries, pdf of candidates) for every part and turn of every cell.

    cands and queries need ``cell`` and ``vec_id``; a query may be in several cells. cells: how
    many there are at most, a fixed bound, so that their counts may come to the driver.
    """
    n_c = {r["cell"]: r["count"] for r in cands.groupBy("cell").count().limit(cells).collect()}
    n_q = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().limit(cells).collect()}
    parts, turns = parts_of(n_c, part_rows), parts_of(n_q, TURN)
    own = lambda per: F.pmod(F.xxhash64("vec_id"), number_of(F.col("cell"), per).cast("long"))
    all_of = lambda per: F.explode(F.sequence(F.lit(0).cast("long"), number_of(F.col("cell"), per).cast("long") - 1))
    # cells that no query visits stay where they are
    c = cands.where(number_of(F.col("cell"), turns) > 0).withColumn("part", own(parts)).withColumn("turn", all_of(turns))
    q = queries.where(number_of(F.col("cell"), parts) > 0).withColumn("turn", own(turns)).withColumn("part", all_of(parts))

    def both(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        return search(qs, cs)

    keys = ("cell", "part", "turn")
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(both, schema)


def ranked(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    best = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(best, "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
