"""Exact top-k by inner product: descending lengths, SVD-rotated partial sums, residual bounds.

The Gram matrix of all vectors, summed where the rows are, gives the right singular vectors; in
that basis the first coordinates hold most of each inner product. Vectors are dealt by
descending length into BANDS of about equal counts. All queries first meet the longest WAVE of
the bands, which gives each a k-th best score; then they only visit bands that can beat it by
length (Cauchy-Schwarz). Within a band, longest first, inner products grow by blocks of
coordinates (STAGES); after each, the partial sum plus |rest of q| * |rest of x| rules out the
pairs that cannot beat the k-th best so far, and what is left gets its exact integer score.
Bounds have slack for rounding, so no result depends on floating point.

Integers are held as doubles, in which every product and sum is exact while squared lengths
stay below 2 ** 53; longer vectors are multiplied as Python integers. Scores beyond a long are
given as the nearest long.

Defined results: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; neither do vectors of another length than most have. Rows that share the
query's id are the query's own. Fewer than k candidates give fewer rows. Ties go to the smaller
vec_id. A repeated query is searched once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import FEW, STEP, Best, chosen, kth_best, matrix, ranked, search_cells, taking_part

BANDS, WAVE, STAGES, PART_ROWS, SCALE = 64, 8, (16, 32, 48), 16_384, 256
FOUND = "query_id long, vec_id long, score long"
EXACT = float(1 << 53)


def gram(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of v v^T over all rows; what each task has summed meets per matrix cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "value"])

    cells = rows.select("v").mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(d * d)
    for r in cells.collect():  # d * d numbers
        out[r["at"]] = r["value"]
    return out.reshape(d, d)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, as integers."""
    if np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt(q @ q) < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in x], object)


def longs(s: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what lies beyond becomes the nearest of them."""
    return s.astype(np.int64) if s.dtype != object else np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in s], np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score.astype(np.float64)))[:k] if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], int)


def scan(q: np.ndarray, rq: np.ndarray, own: np.ndarray, names: np.ndarray, have: np.ndarray, x: np.ndarray, rx: np.ndarray, length: np.ndarray, ids: np.ndarray, k: int) -> tuple[Best, int]:
    """(the k best of each query among rows of x in order of descending length, pairs scored).

    rq and rx are rotated; have is a score that a query has k of already, or -inf. Best holds
    scores with their sign changed."""
    best, exact, have = Best(len(q), k), 0, have.copy()
    stages = [(a, b) for a, b in zip((0, *STAGES), STAGES) if b < q.shape[1]]
    rest = lambda r, b: np.sqrt((r[:, b:] ** 2).sum(1))
    rest_q, rest_x = ({b: rest(r, b) for _, b in stages} for r in (rq, rx))
    for lo in range(0, len(x), STEP):
        limit = have - (1e-9 * own * length[lo] + 1e-6)
        rows, cols = np.arange(lo, min(len(x), lo + STEP)), np.flatnonzero(own * length[lo] >= limit)
        sums, pairs, i, j = np.zeros((len(rows), len(cols))), False, *np.zeros((2, 0), int)
        for a, b in stages:
            if pairs:
                sums += np.einsum("ij,ij->i", rx[i, a:b], rq[j, a:b])
                keep = sums + rest_x[b][i] * rest_q[b][j] >= limit[j]
                i, j, sums = i[keep], j[keep], sums[keep]
                continue
            sums += rx[rows, a:b] @ rq[cols, a:b].T
            some = sums + rest_x[b][rows, None] * rest_q[b][cols] >= limit[cols]
            if some.sum() <= FEW * some.size or b == stages[-1][1]:  # from here on pairs are cheaper than blocks
                i, j = np.nonzero(some)
                i, j, sums, pairs = rows[i], cols[j], sums[i, j], True
        if not stages:
            i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
        other = ids[i] != names[j]
        i, j = i[other], j[other]
        exact += len(i)
        if len(i):
            score = np.concatenate([np.einsum("ij,ij->i", x[i[at : at + 65536]], q[j[at : at + 65536]]) for at in range(0, len(i), 65536)])
            have = np.maximum(have, -best.add(j, -score, ids[i]))
    return best, exact


def search(rows: DataFrame, is_query, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of the highest inner product of floor(scale * x), for each row that is_query
    holds of."""
    rows, d = taking_part(rows, id_col, vec_col)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = materialize(rows.withColumn("length", length), "vectors")
    if not d:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = np.linalg.eigh(gram(rows, d))[1][:, ::-1].copy()
    steps = [i / BANDS for i in range(1, BANDS)]
    cuts = rows.agg(F.percentile_approx("length", F.array(*[F.lit(s) for s in steps]), F.lit(10_000)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)  # band b holds lengths above cuts[b], up to cuts[b - 1]
    band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("length") <= c)).cast("long") if cuts else F.lit(0).cast("long")
    cands = materialize(rows.withColumn("cell", band), "bands")
    tops = {r["cell"]: r["top"] for r in cands.groupBy("cell").agg(F.max("length").alias("top")).collect()}  # BANDS rows at most

    def most(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        cs = cs.sort_values(["length", "vec_id"], ascending=[False, True])
        x, ids, lengths = matrix(cs["v"]), cs["vec_id"].to_numpy(), cs["length"].to_numpy()
        q, names, own = matrix(qs["v"]), qs["vec_id"].to_numpy(), qs["length"].to_numpy()
        if lengths[0] * own.max() < EXACT:
            found, _ = scan(q, q @ basis, own, names, qs["have"].to_numpy(), x, x @ basis, lengths, ids, k)
            return pd.DataFrame({"query_id": names[found.query], "vec_id": found.id, "score": (-found.value).astype(np.int64)})
        out = []
        for i, query in enumerate(names):
            at = np.flatnonzero(ids != query)
            s = scores(x[at], q[i])
            good = best(ids[at], s, k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][good], "score": longs(s[good])}))
        return pd.concat(out)

    def visits(queries: DataFrame, some: list[int]) -> DataFrame:
        """queries at each of some bands that can beat what they have by length."""
        bands = F.array(*[F.struct(F.lit(b).cast("long").alias("cell"), F.lit(float(tops[b])).alias("top")) for b in some])
        can = F.filter(bands, lambda b: b["top"] * F.col("length") * (1 + 1e-9) + 1e-6 >= F.col("have"))
        return queries.withColumn("_b", F.explode(can)).select(F.col("_b.cell").alias("cell"), "vec_id", "v", "length", "have")

    queries = chosen(rows, is_query).withColumn("length", length)
    queries = materialize(queries, "queries")
    near = visits(queries.withColumn("have", F.lit(float("-inf"))), sorted(tops)[:WAVE])
    found = materialize(search_cells(cands, near, PART_ROWS, most, FOUND, BANDS), "wave")
    if len(tops) > WAVE:
        reached = queries.join(kth_best(found, k, False).withColumnRenamed("query_id", "vec_id"), "vec_id", "left").fillna(float("-inf"), ["have"])
        far = materialize(visits(reached, sorted(tops)[WAVE:]), "visits")
        found = found.unionByName(search_cells(cands, far, PART_ROWS, most, FOUND, BANDS))
    return ranked(found, k, ascending=False)


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
