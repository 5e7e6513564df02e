import random

import pytest
from pyspark.sql import functions as F

from docframe.llm import mixing as mx


def expected_targets(sizes):
    """Brute force: share, cap, reshare until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def corpus(counts, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in counts.items():
        for _ in range(n):
            rows.append((len(rows), " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), source, "clash", 7))
    return rows


COLUMNS = "doc_id long, text string, source string, size string, target int"


@pytest.mark.parametrize("counts", [{"a": 300, "b": 300, "c": 300, None: 50}, {"a": 5, "b": 900, "c": 20, "d": 3}, {"only": 40}])
def test_targets_and_taken(spark, tmp_path, counts):
    rows = corpus(counts)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = mx.op2_mixing(spark, str(tmp_path)).collect()
    again = mx.op2_mixing(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(again)
    source = {r[0]: r[2] for r in rows}
    sizes, most = {}, {}
    for i, text, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
        most[s] = max(most.get(s, 0), len(text.split()))
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_words_are_ascii_separated(spark, tmp_path):
    texts = ["a b c", "\x0b a\tb\r\n", None, "", "\x1f x"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["size"] for r in mx.op2_mixing(spark, str(tmp_path)).collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: 0, 4: 2}


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, "x"), (1, "c", "x"), (1, "c", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert mx.op2_mixing(spark, f"{tmp_path}/a").count() == 5
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert mx.op2_mixing(spark, f"{tmp_path}/b").count() == 0
    spark.createDataFrame([(1, "", "x")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/c/documents.parquet")
    assert [(r["target"], r["taken"]) for r in mx.op2_mixing(spark, f"{tmp_path}/c").collect()] == [(0.0, 0)]


def test_stage_repeats_documents_as_taken(spark):
    rows = corpus({"a": 20, "b": 300})
    docs = spark.createDataFrame(rows, COLUMNS)
    want = {r["doc_id"]: r["copies"] * r["times"] for r in mx.mix(docs).collect()}
    out = mx.mix_documents(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_main_path_has_no_python(spark, tmp_path):
    spark.createDataFrame(corpus({"a": 30}), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    plan = mx.op2_mixing(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_equal_rows_are_shared_out(spark, tmp_path):
    rows = [(7, "w " * 5, "a")] * 50_000 + [(i, "w " * (i % 40), "b") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    got = mx.op2_mixing(spark, str(tmp_path)).groupBy("doc_id", "size", "target", "taken").count().collect()
    equal = [r for r in got if r["doc_id"] == 7 and r["size"] == 5]
    assert sum(r["count"] for r in got) == len(rows) and sum(r["count"] for r in equal) >= 50_000
    assert {r["taken"] % 5 for r in equal} == {0} and max(r["taken"] for r in equal) - min(r["taken"] for r in equal) <= 10
    assert abs(sum(r["taken"] * r["count"] for r in equal) - equal[0]["target"]) <= 45
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = mx.mix_documents(spark, docs, "").where("source = 'a'").count()
    assert abs(stage * 5 - equal[0]["target"]) <= 5


def test_every_row_is_taken_as_likely_as_due(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i < 40 else "b") for i in range(120)] + [(3, "w " * 4, "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    seeds, total = 6, {}
    for seed in range(seeds):
        for r in mx.mix(docs, seed=seed).collect():
            k = (r["source"], r["size"])
            n, due, taken = total.get(k, (0, 0.0, 0))
            total[k] = (n + r["times"], due + r["times"] * r["target"] / r["source_size"], taken + r["times"] * r["copies"])
    for n, due, taken in total.values():
        assert abs(taken - due) < 4.5 * n**0.5 * 0.5  # four standard deviations of independent draws
