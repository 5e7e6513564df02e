import numpy as np
import pytest

from docframe.llm import toxicity as tx

CALM = "the river ran along the quiet field and over the old stone bridge near our house . ".split(" . ")
WORDS = "river field stone bridge quiet house garden window morning paper winter music letter market simple yellow silver people".split()


def sentences(n, insult=None, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = list(rng.choice(WORDS, 25))
        if insult:
            words.insert(int(rng.integers(0, 25)), insult[int(rng.integers(0, len(insult)))])
        out.append(" ".join(words) + ".")
    return out


@pytest.fixture(scope="module")
def model():
    bad, good = sentences(150, ["blockhead", "numbskull"], 1), sentences(150, None, 2)
    return tx.train(bad + good, [1] * 150 + [0] * 150)


def test_held_out_accuracy(model):
    bad, good = sentences(80, ["blockhead", "numbskull"], 3), sentences(80, None, 4)
    assert (model.score(bad) >= 0.5).mean() > 0.97
    assert (model.score(good) < 0.5).mean() > 0.97


@pytest.mark.parametrize("form", ["BLOCKHEAD", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "blockxhead", "block-head", "blöckhead"])
def test_gaps_and_insertions(model, form):
    text = f"the quiet garden {form} near the window"
    assert model.score([text])[0] > model.score(["the quiet garden market near the window"])[0]
    assert model.score([text])[0] >= 0.5


def test_folded_weights_equal_the_kernel_expansion():
    rng = np.random.default_rng(0)
    w = np.zeros(tx.SYMBOLS**tx.ORDER, np.float32)
    idx, val = tx.subsequences(tx.encode(["blockhead"])[0])
    np.add.at(w, idx, val)
    sym, _ = tx.encode(["a bl ockhead of the river"])
    windows = tx.window_scores(sym, w)
    landmark = dict()
    for i, v in zip(idx, val):
        landmark[i] = landmark.get(i, 0) + v
    at = int(rng.integers(0, len(windows)))
    total = 0.0
    for j in range(at, at + tx.WINDOW):  # every subsequence that begins in the window
        for _, a, b, c in tx.GAPS:
            u = (int(sym[j]) << 15) + (int(sym[j + a]) << 10) + (int(sym[j + b]) << 5) + int(sym[j + c])
            total += landmark.get(u, 0) * tx.DECAY ** (c + 1)
    assert windows[at] == pytest.approx(total, rel=1e-5)


def test_batches_do_not_change_scores(model):
    texts = sentences(20, ["numbskull"], 5) + ["", "x", "\0\0"]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts])


def test_long_text_is_scored_whole(model):
    long = " ".join(sentences(3000, None, 6))
    assert model.score([long])[0] < 0.5
    assert model.score([long + " numbskull"])[0] >= 0.5


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_class_or_none(labels):
    m = tx.train(["a b c"] * len(labels), labels)
    assert m.score(["any"])[0] == pytest.approx(1.0 if labels[:1] == [1] else 0.0, abs=1e-6)


def test_operator_and_stage(spark, tmp_path):
    bad, good = sentences(60, ["blockhead"], 7), sentences(60, None, 8)
    rows = [(i, t, "x", i) for i, t in enumerate(bad + good)] + [(500, None, "x", 0), (None, "", "x", 0), (3, bad[3], "x", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1 if i < 60 else 0) for i in range(120)] + [(None, 1), (5, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60) > 55
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = tx.reject_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "score", "toxic"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(60, 120)) <= set(ids) and 500 in ids and None in ids


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert tx.op1_toxicity(spark, str(tmp_path)).collect() == []


def test_held_out_labels_are_never_seen(spark, tmp_path):
    import zlib

    bad, good = sentences(60, ["blockhead"], 7), sentences(60, None, 8)
    spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in tx.op1_toxicity(spark, str(tmp_path)).collect()}
    assert 5 < len(held) < 60
    flipped = spark.createDataFrame([(i, int((i < 60) != (i in held))) for i in range(120)], "doc_id long, toxic int")
    flipped.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"]: r["score"] for r in tx.op1_toxicity(spark, str(tmp_path)).collect()} == scores


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(400)] + [(11, "x" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 12, int(i % 12 < 5)) for i in range(600)], "doc_id long, toxic int")
    rows, share = tx.training_rows(docs, labels, max_docs=6, max_chars=100)
    got = [tuple(r) for r in rows.select("_id", "toxic", "text").collect()]
    assert len(got) == len({g[0] for g in got}) <= 11 and all(i != 11 for i, _, _ in got)
    assert {i for i, y, _ in got if y} == set(range(5)) and share == pytest.approx(5 / 12)
    assert all(t == min(f"text {k}" for k in range(i, 400, 10)) for i, _, t in got)
