import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docframe.llm import near_dedup as nd


def weights_of(texts, share=nd.FLOOR):
    """id to {shingle: weight}, by words and dictionaries alone."""
    sets, df = {}, Counter()
    for i, t in texts.items():
        words = re.findall(r"\w+", (t or "").lower())
        sets[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
        df.update(sets[i].keys())
    n = sum(len(x) > 0 for x in sets.values())
    floor = max(1, int(share * n))
    return {i: {s: c * (1 + math.log10(n / max(df[s], floor))) for s, c in x.items()} for i, x in sets.items()}


def jaccard(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute_force(texts, share=nd.FLOOR):
    """id to the least id that links of at least 0.8 reach."""
    w, at = weights_of(texts, share), {i: i for i in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if w[a] and w[b] and jaccard(w[a], w[b]) >= nd.THRESHOLD - 1e-9:
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus(seed, groups=12, spread=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = {}
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(60, 220))]
        for k in range(spread if g == 0 else rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 12 if g == 0 else 8)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t += passage
            texts[len(texts)] = " ".join(t)
            if k == 1:
                texts[len(texts)] = " ".join(t).upper() + " !"  # equal words
    return texts


@pytest.mark.parametrize(("seed", "few", "block"), [(1, 16, 256), (2, 3, 8)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, few, block):
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "BLOCK", block)
    texts = corpus(seed) | {900: "", 901: None, 902: "one two", 903: "one two", 904: "One, two!", 905: "...", 906: "word " * 5000, 907: "word " * 5000}
    spark.createDataFrame([(i, t, "c", 1) for i, t in texts.items()], "doc_id long, text string, node string, class_id int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = nd.op10_near_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_force(texts)
    assert all(r["keep"] == (r["doc_id"] == r["class_id"]) for r in got) and len(got) == len(texts)


def test_samples_agree_as_often_as_similar():
    rng, sampler = np.random.default_rng(3), nd.Sampler(100, 4)
    h = np.sort(rng.integers(0, 1 << 32, 400, dtype=np.uint32))
    w = np.where(np.arange(400) % 3 == 0, 2.0, 1.0)
    v = w.copy()
    v[:60], v[60:100] = 0, 4.0
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    got = (sampler.samples(h, w) == sampler.samples(h[v > 0], v[v > 0])).mean()
    assert got == pytest.approx(want, abs=0.09)


@pytest.mark.parametrize("share", [0.02, 0.2])
def test_frequencies_are_exact_above_the_floor(spark, monkeypatch, share):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 2000)
    texts = corpus(5) | {900: "", 901: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    stored = nd.shingled(docs.selectExpr("doc_id", "doc_id AS th", "coalesce(text, '') AS text"))
    got = nd.idf_of(stored, share)
    want, shingle = weights_of(texts, share), nd.Shingler()
    for i, t in texts.items():
        _, h, c = shingle(t or "")
        w = got.weights(h, c.astype("<u4").tobytes())
        assert sorted(w.tolist()) == pytest.approx(sorted(want[i].values()), rel=1e-5)
    assert 0 < len(got.keys) < len({s for x in want.values() for s in x})


@pytest.mark.parametrize("least_equal", [0.0, nd.LEAST_EQUAL])
def test_floor_and_exact_way(spark, least_equal):
    texts = corpus(6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = nd.classes(docs, least_equal=least_equal, floor=0.05).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_force(texts, 0.05)


def test_samples_of_long_texts_agree_as_often_as_similar():
    rng, sampler = np.random.default_rng(4), nd.Sampler(100, 4)
    h = np.sort(rng.integers(0, 1 << 32, 200_000, dtype=np.uint32))
    w = np.where(rng.random(len(h)) < 0.3, 1.7, 4.0)
    v = w * (rng.random(len(h)) < 0.85)
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    got = (sampler.samples(h, w) == sampler.samples(h[v > 0], v[v > 0])).mean()
    assert got == pytest.approx(want, abs=0.06)


def test_blocks_give_the_links_of_all_pairs():
    import pandas as pd

    rng = random.Random(1)
    texts = corpus(4, groups=1, spread=30)
    sampler, shingle = nd.Sampler(), nd.Shingler()
    rows = []
    for i, t in texts.items():
        _, h, c = shingle(t)
        s = sampler.samples(h, c.astype(np.float64))
        rows.append(dict(key=int(sampler.keys(s).view(np.int64)[0]), node=i, comp=i, weight=float(c.sum()), equal=(s & np.uint64(255)).astype(np.uint8).tobytes(), keys=sampler.keys(s).view(np.int64), part=rng.randint(0, 1), lo=0, hi=0, h=h, c=c))
    g = pd.DataFrame(rows)
    most = Counter(g["key"]).most_common(1)[0][0]
    g = g[g["key"] == most].reset_index(drop=True)
    i, j = nd._open_pairs(g, 0.8)
    open_pairs = {frozenset((g["node"][a], g["node"][b])) for a, b in zip(i, j)}
    plain = {r.node: (r.h, r.c.astype(np.float32)) for r in g.itertuples()}
    near = {frozenset((a, b)) for a in g["node"] for b in g["node"] if a < b and nd.similarity(*plain[a], *plain[b]) >= 0.8}
    assert near <= open_pairs and len(g) > 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(900, 870, -1)]
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 500 for i in range(500, 560)) and all(got[i] == 871 for i in range(871, 902))


def test_stage_nulls_repeats_and_empty_table(spark, tmp_path):
    text = "a b c d e f g h i j k l m n"
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (5, "other words that stand quite alone here", "x"), (6, None, "x"), (7, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    out = nd.keep_one(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(False, 5, rows[3][1]), (False, 6, ""), (False, 7, ""), (True, 0, ""), (True, 0, text)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert nd.op10_near_dedup(spark, str(tmp_path)).collect() == []


def test_a_floor_of_one_document_needs_one_pass(spark, monkeypatch):
    """Only shingles of several documents reach the driver; before, all did, and were sent back."""
    texts = {1: "a b c d e f", 2: "a b c d e g", 3: "a b c d e f", 4: "h i j k l m n o p q r"}
    rows = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "doc_id long, th long, text string").repartition(3)
    stored = nd.materialize(nd.shingled(rows))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("all shingles are sent"))
    keys, df = nd.document_frequencies(stored, len(texts), 1)
    want = Counter(h for t in texts.values() for h in nd.Shingler()(t)[1].tolist())
    assert dict(zip(keys.tolist(), df.tolist())) == {h: n for h, n in want.items() if n > 1} and sorted(df.tolist()) == [2, 3]
    assert keys.dtype == np.uint32 and (np.diff(keys.astype(np.int64)) > 0).all()
