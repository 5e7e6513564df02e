"""Approximate nearest neighbours by adaptive dimension scan in probed lists.

Index: k-means on a bounded sample of SAMPLE vectors (those with the smallest hashes of their
ids) gives the centroids; every vector goes to its nearest list. Search: a query probes its
nearest lists, as many as give the wanted recall on the sample: the nearest one first, and the
others with the k-th best distance of that. The index holds vectors as they are and rotated by one
random orthogonal matrix, which are read in column blocks; after d of D dimensions a candidate is
given up when its partial squared distance is above r2 * d / D * (1 + EPS / sqrt(d)) ** 2, where
r2 is the k-th best so far: under the random rotation that rejects the hypothesis that its full
distance is below r2. Survivors get their exact distance on the original vectors in double
precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part; neither do vectors of another length than most have. Rows that
share the query's id are the query's own. Fewer than k candidates give fewer rows. Ties go to
the smaller vec_id. A repeated query is searched once, with the least of its vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import FEW, STEP, Best, chosen, kth_best, matrix, ranked, search_cells, taking_part

SAMPLE, MOST_LISTS, TRIALS, GOAL, COLUMNS, EPS, PART_ROWS = 20_000, 1024, 200, 0.95, 16, 2.1, 8192
FOUND = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, count: int) -> np.ndarray:
    """The count nearest centers of each row, nearest first."""
    out = np.zeros((len(x), min(count, len(centers))), np.int64)
    norms = (centers * centers).sum(1)
    for lo in range(0, len(x), 4096):
        d = norms - 2 * x[lo : lo + 4096] @ centers.T
        if count == 1:
            out[lo : lo + 4096, 0] = d.argmin(1)
        else:
            out[lo : lo + 4096] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def rotation(d: int, seed: int = 13) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


def scan(q: np.ndarray, rq: np.ndarray, names: np.ndarray, r2: np.ndarray, x: np.ndarray, rx: np.ndarray, ids: np.ndarray, k: int) -> tuple[Best, int]:
    """(about the k nearest rows of x of each query by squared distance, values read).

    rq and rx are rotated; r2 is a squared distance within which a query has k rows already, or
    infinite."""
    d = q.shape[1]
    best, seen, r2 = Best(len(q), k), 0, r2.copy()
    slack = 1e-8 * ((q * q).sum(1) + (x * x).sum(1).max(initial=0))
    for lo in range(0, len(x), STEP):
        rows, cols = np.arange(lo, min(len(x), lo + STEP)), np.arange(len(q))
        some, part, pairs = ids[rows, None] != names, np.zeros((len(rows), len(q))), False
        for c in range(0, d, COLUMNS):
            seen += part.size * min(COLUMNS, d - c)
            at = min(d, c + COLUMNS)
            wide = (1 + EPS / math.sqrt(at)) ** 2 if at < d else 1 + 1e-5
            most = r2 * at / d * wide + slack
            if pairs:
                part += ((rx[i, c:at] - rq[j, c:at]) ** 2).sum(1)
                keep = part <= most[j]
                i, j, part = i[keep], j[keep], part[keep]
                continue
            a, b = rx[rows, c:at], rq[cols, c:at]
            part += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
            some &= part <= most[cols]
            if some.sum() <= FEW * some.size or at == d:  # from here on pairs are cheaper than blocks
                i, j = np.nonzero(some)
                i, j, part, pairs = rows[i], cols[j], part[i, j], True
        if len(i):
            exact = [((x[i[at : at + 65536]] - q[j[at : at + 65536]]) ** 2).sum(1) for at in range(0, len(i), 65536)]
            r2 = np.minimum(r2, best.add(j, np.concatenate(exact), ids[i]))
    return best, seen


def index(rows: DataFrame, d: int, k: int, turn: np.ndarray) -> tuple[DataFrame, np.ndarray, int]:
    """((cell, vec_id, v, r) of every row, r rotated by turn, centroids, lists to probe)."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    sample = matrix(sample["v"])
    centers = kmeans(sample, max(1, min(MOST_LISTS, int(math.sqrt(n) / 2))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cell = pa.array(nearest(x, centers, 1)[:, 0])
            r = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * d + 1, d), pa.int32()), pa.array((x @ turn).astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([cell, b.column("vec_id"), v, r], names=["cell", "vec_id", "v", "r"])

    return materialize(rows.select("vec_id", "v").mapInArrow(assign, "cell long, vec_id long, v array<double>, r array<float>"), "lists"), centers, probes_for(sample, centers, k)


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    """How many lists to probe for a recall of GOAL, measured on the sample.

    TRIALS of its vectors look for their k nearest in it by brute force; the answer is the
    GOAL-quantile of how far down their own order of lists these neighbours' lists stand. True
    neighbours among all rows are nearer than those of a sample, so this errs to more probes.
    """
    if len(sample) <= k:
        return len(centers)
    own, ranks = nearest(sample, centers, 1)[:, 0], []
    norms = (sample * sample).sum(1)
    for i in range(0, len(sample), max(1, len(sample) // TRIALS)):
        d = norms - 2 * sample @ sample[i]
        d[i] = math.inf
        order = np.empty(len(centers), np.int64)
        order[nearest(sample[i : i + 1], centers, len(centers))[0]] = np.arange(len(centers))
        ranks.append(order[own[np.argpartition(d, k)[:k]]])
    return int(np.quantile(np.concatenate(ranks), GOAL, method="higher")) + 1


def search(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each row whose id is_query holds of."""
    rows, d = taking_part(rows, id_col, vec_col, zero_too=False)
    rows = materialize(rows, "vectors")
    if not d:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turn = rotation(d)
    lists, centers, count = index(rows, d, k, turn)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cells = nearest(matrix(b["v"]), centers, count)
                at = np.repeat(np.arange(len(b)), cells.shape[1])
                yield pd.DataFrame({"cell": cells.ravel(), "nth": np.tile(np.arange(cells.shape[1]), len(b)), "vec_id": b["vec_id"].to_numpy()[at], "v": b["v"].to_numpy()[at]})

    def near(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, names, r2 = matrix(qs["v"]), qs["vec_id"].to_numpy(), qs["have"].to_numpy() ** 2
        # the rounding of rotated vectors to single precision is within the slack of the test
        found, _ = scan(q, q @ turn, names, r2, matrix(cs["v"]), matrix(cs["r"]), cs["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": names[found.query], "vec_id": found.id, "score": np.sqrt(found.value)})

    queries = materialize(chosen(rows, is_query).mapInPandas(probe, "cell long, nth long, vec_id long, v array<double>"), "probes")
    first = queries.where("nth = 0").withColumn("have", F.lit(float("inf")))
    found = materialize(search_cells(lists, first, PART_ROWS, near, FOUND, MOST_LISTS), "nearest")
    if count > 1:
        have = kth_best(found, k, True).withColumnRenamed("query_id", "vec_id")
        others = queries.where("nth > 0").join(have, "vec_id", "left").fillna(float("inf"), ["have"])
        found = found.unionByName(search_cells(lists, materialize(others, "others"), PART_ROWS, near, FOUND, MOST_LISTS))
    return ranked(found, k, ascending=True)


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
