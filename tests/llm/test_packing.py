import zlib

import numpy as np
import pytest

from docframe.llm import packing as pk


def check(pieces, texts, capacity=pk.CAPACITY):
    """Exact round trip: every id in exactly one piece, windows gapless and within capacity."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pk.default_tokenizer())
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    sizes = []
    for w in by_window.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        sizes.append(at)
    return sizes


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = {i: " ".join(rng.choice(["don't", "stop", "naïve", "日本語", "x1y2", "…", "Straße", "\x1codd", "<|endoftext|>", "é" * 9], int(rng.integers(0, 900)))) for i in range(120)}
    texts |= {500: None, 501: "", 502: " \n\t ", 503: "word " * 30_000, 504: "a" * 60_000, 505: "tab\x0bnbsp\xa0nel\x85x y"}
    spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, length int").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = pk.op4_packing(spark, str(tmp_path)).collect()
    sizes = check(pieces, texts)
    assert sum(pk.CAPACITY - s for s in sizes) < 2 * pk.CAPACITY


def test_packer_keeps_few_windows_open():
    rng = np.random.default_rng(2)
    p = pk.Packer(100, 4)
    for row in range(500):
        p.add(row, np.arange(int(rng.integers(1, 260)), dtype="<u4"))
        assert len(p.windows) <= 4
    p.end()
    assert all(sum(len(x[2]) for x in w) == 100 for w in p.closed)


def test_best_fit():
    p = pk.Packer(10, 3)
    for row, n in enumerate((6, 7, 9)):
        p.windows[row] = [[row, 0, np.zeros(n, "<u4"), n]]
    p.free, p.made = [(1, 2), (3, 1), (4, 0)], 3
    p.place([9, 0, np.zeros(3, "<u4"), 3])
    assert [len(w) for w in p.closed] == [2] and p.closed[0][0][0] == 1  # the window with room for exactly 3


def test_merge_joins_whole_windows():
    import pandas as pd

    rows = [(s, n, s << 40, 0) for s, n in enumerate((60, 50, 45, 40, 5))]
    pieces = pd.DataFrame([dict(row=r, start=0, length=n, ids_crc32=0, doc_tokens=n, sequence_id=s, offset=o, part=True) for r, n, s, o in rows])
    out = pk._merge(100)((0,), pieces)
    assert sorted(out.groupby("sequence_id")["length"].sum()) == [100, 100]
    assert all((g.sort_values("offset")["offset"].tolist() == np.concatenate([[0], g.sort_values("offset")["length"].cumsum()[:-1]]).tolist()) for _, g in out.groupby("sequence_id"))


def test_many_tasks_merge_their_leftovers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pk, "MERGE", 4)
    texts = {i: "one two three " * 20 for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        sizes = check(pk.op4_packing(spark, str(tmp_path)).collect(), texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) <= 3


def test_repeated_and_null_ids_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert pk.op4_packing(spark, f"{tmp_path}/a").count() == 3
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pk.op4_packing(spark, f"{tmp_path}/b").count() == 0


TEXTS = ["Hello, world!", "it's we'll", "ABCİ", "á ë", "12 345", "﻿x", "ΣΑΣ ς", "x²½Ⅷ", "a\u0301b \u0301", "don't'S", "\x7f\x01 \xad", "\u200bzero\u3000wide", "¡Hola!"]


def test_word_tokenizer_equals_whole_on_single_characters():
    t = pk.WordTokenizer(pk.default_tokenizer())
    for cp in [*range(0x300), *range(0x370, 0x600, 3), *range(0x600, 0x2100, 17), 0x1E9E, 0x1F600, 0xFFFD]:
        text = f"a{chr(cp)}b {chr(cp)}"
        assert t.encode(text).tolist() == [*t.whole.encode(text, add_special_tokens=False).ids, 1], hex(cp)


@pytest.mark.parametrize("text", TEXTS)
def test_word_tokenizer_equals_whole(text):
    t = pk.WordTokenizer(pk.default_tokenizer())
    assert t.encode(text).tolist() == [*t.whole.encode(text, add_special_tokens=False).ids, 1]
