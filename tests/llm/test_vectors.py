import numpy as np
import pytest

from docframe.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, path, vectors, extra=()):
    rows = [(i, [float(x) for x in v], 0, 9.0, 1) for i, v in enumerate(vectors)] + [(*e, 0, 9.0, 1) for e in extra]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/embeddings.parquet")


ODD = [(None, [1.0] * 8), (7000, None), (7100, [float("nan")] + [1.0] * 7), (7200, [float("inf")] + [1.0] * 7), (7300, [1.0] * 3), (7400, [None] + [1.0] * 7), (7500, [])]


def clusters(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    v = (centers[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.4).astype(np.float32)
    v[n // 3 : n // 2] = v[0]  # one vector that a sixth of all rows hold
    return v


def test_ann_recall_order_and_scores(spark, tmp_path):
    v = clusters(1500, 8)
    table(spark, tmp_path, v, ODD + [(7600, [0.0] * 8)])
    got = ann.op5_ann(spark, str(tmp_path)).collect()
    x, hit, total = v.astype(np.float64), 0, 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 100))
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11)) and q not in [r["vec_id"] for r in rows]
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        for r in rows:
            assert r["score"] == pytest.approx(d[r["vec_id"]], rel=1e-14, abs=0)
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hit, total = hit + len({*want} & {r["vec_id"] for r in rows}), total + 10
    assert hit / total >= 0.9


def test_ann_ties_go_to_smaller_ids(spark, tmp_path):
    table(spark, tmp_path, clusters(600, 8))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.op5_ann(spark, str(tmp_path)).collect() if r["query_id"] == 0)
    assert [g[1] for g in got] == list(range(200, 210)) and all(g[2] == 0 for g in got)


def exact(v, ids, step, k):
    e = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    out = {}
    for q in sorted({i for i in ids if i % step == 0}):
        own = ids == q
        s = e @ e[np.flatnonzero(own)[0]]
        order = [i for i in np.lexsort((ids, -s)) if not own[i]][:k]
        out[q] = [(int(ids[i]), int(s[i])) for i in order]
    return out


@pytest.mark.parametrize(("n", "d", "parts"), [(1200, 8, 100), (700, 32, 4096), (3, 8, 4096)])
def test_topk_is_exact(spark, tmp_path, monkeypatch, n, d, parts):
    monkeypatch.setattr(topk, "PART_ROWS", parts)
    monkeypatch.setattr(topk, "WAVE", 1)
    v = clusters(n, d, 3) * np.random.default_rng(1).uniform(0.1, 3, (n, 1)).astype(np.float32)
    table(spark, tmp_path, v, ODD if d == 8 and n > 7 else ())
    got = {}
    for r in sorted(topk.op9_topk(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == exact(v, np.arange(n), 50, 5)


def test_partial_sums_rule_out_most_pairs():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(4000, 64)) * 0.9 ** np.arange(64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0])
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    basis, length, ids = np.linalg.eigh(x.T @ x)[1][:, ::-1], np.linalg.norm(x, axis=1), np.arange(4000)
    own = rng.permutation(4000)[:80]
    found, exact_pairs = topk.scan(x[own], x[own] @ basis, length[own], own, np.full(80, -np.inf), x, x @ basis, length, ids, 5)
    s = x[own] @ x.T
    s[np.arange(80), own] = -np.inf
    for i in range(80):
        assert found.id[found.query == i].tolist() == np.lexsort((ids, -s[i]))[:5].tolist()
    assert exact_pairs < 0.25 * 80 * 4000


def test_column_blocks_abandon_most_candidates():
    rng = np.random.default_rng(6)
    x = rng.permutation(np.concatenate([rng.normal(size=(1, 64)) * 3 + rng.normal(size=(400, 64)) for _ in range(10)]))
    turn, ids, own = ann.rotation(64), np.arange(4000), np.arange(0, 4000, 50)
    found, seen = ann.scan(x[own], x[own] @ turn, own, np.full(80, np.inf), x, x @ turn, ids, 10)
    hits = 0
    for i, q in enumerate(own):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({*found.id[found.query == i].tolist()} & {*np.argsort(d)[:10].tolist()})
    assert hits >= 0.97 * 800 and seen < 0.5 * 80 * 4000 * 64


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ann_recall_on_the_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]]), rows["vec_id"].to_numpy()
    got = {}
    for r in ann.op5_ann(spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in got:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits, total = hits + len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())), total + 10
    assert total and hits / total >= 0.9


def test_topk_of_huge_and_of_zero_vectors(spark, tmp_path):
    v = np.array([[3e5] * 8, [2e5] * 8, [0.0] * 8, [-1e5] * 8], np.float32)
    table(spark, tmp_path, v)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.op9_topk(spark, str(tmp_path)).collect())
    assert [(i, s) for _, i, s in got] == exact(v, np.arange(4), 50, 5)[0]


def test_scores_beyond_exact_doubles():
    x, q = np.array([[2.0**40 + 1, 2.0**40 - 1], [2.0**40, 2.0**40]]), np.array([2.0**20 + 1, 2.0**20 + 1])
    assert topk.scores(x, q).tolist() == [2 * 2**40 * (2**20 + 1)] * 2


def test_scores_beyond_a_long_saturate(spark, tmp_path):
    table(spark, tmp_path, np.array([[3e14] * 8, [2e14] * 8, [-2e14] * 8], np.float32))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.op9_topk(spark, str(tmp_path)).collect())
    assert got == [(1, 1, (1 << 63) - 1), (2, 2, -(1 << 63))]


@pytest.mark.parametrize("query", [ann.op5_ann, topk.op9_topk])
def test_empty_single_and_repeated(spark, tmp_path, query):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert query(spark, f"{tmp_path}/a").collect() == []
    table(spark, f"{tmp_path}/b", [[1.0, 2.0]])
    assert query(spark, f"{tmp_path}/b").collect() == []
    table(spark, f"{tmp_path}/c", [[1.0, 2.0], [2.0, 1.0]], [(0, [1.0, 2.0])])
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in query(spark, f"{tmp_path}/c").collect()] == [(0, 1, 1)]
