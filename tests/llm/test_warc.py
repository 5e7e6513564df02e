import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from docframe.llm import warc

COLUMNS = "page_id long, url string, html string, digest string"


def pages():
    rng = random.Random(3)
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 4
    bodies = ["x" * 99, "x" * 100, "é" * 60, tricky, "\r\n\r\n" * 30, "plain " * 50, "", None, "\x00\x01 binary " * 12, "\U0001f600" * 40]
    rows = [(i, f"https://www.Host{i % 7}.example.org:80/p/{i % 5}?q={i % 2}#f", rng.choice(bodies), "c") for i in range(200)]
    return rows + [(900, None, "y" * 500, "c"), (901, "", "y" * 500, "c"), (902, "a\r\nb", "z" * 300_000, "c")]


def test_round_trip(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, COLUMNS).repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op7_warc(spark, str(tmp_path)).collect()
    first, want = {}, {}
    for i, _, html, _ in sorted(rows):
        first.setdefault(html or "", i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html or ""] != i
        want[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None)
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    order = [(r["url_key"], r["stamp"], r["page_id"]) for r in got]
    assert order == sorted(order)


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200, "not a time", 5)]
    spark.createDataFrame(rows, "page_id long, url string, html string, stamp string, bytes int").write.parquet(f"{tmp_path}/pages.parquet")
    (r,) = warc.op7_warc(spark, str(tmp_path)).collect()
    assert (r["page_id"], r["payload_bytes"], r["stamp"]) == (1, 200, "1970-01-01T00:00:00Z")


def test_small_archives_are_merged_in_many_ranges(spark):
    rows = pages()
    got = warc.archive(spark.createDataFrame(rows, COLUMNS).repartition(4), archive_bytes=4000, range_lines=25, compression="none").collect()
    assert len({r["archive"] for r in got}) > 10 and len(got) == len(rows)
    keys = [(r["url_key"], r["stamp"], r["page_id"]) for r in got]
    assert keys == sorted(keys)
    for r in got:  # a record can be read at its offset
        path = r["archive"].removeprefix("file:")
        with open(path, "rb") as f:
            f.seek(r["at"])
            head = f.read(2000)
        assert head.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r['page_id']}>".encode() in head
        assert os.path.getsize(path) < 9000 or "902" in open(path, newline="").read()


def test_slices_out_of_turn_become_runs():
    import pandas as pd

    rows = [("a", "t", i, "u", 1, "d", "response", None, f"x{i % 2}", i) for i in (5, 7, 9, 1, 3, 8, 2, 4)]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in warc.INDEX.split(", ")])
    runs = warc._runs(iter([frame[:3], frame[3:]]))
    assert len(runs) > 2 and [r.page_id for _, r in warc.LoserTree(runs)] == [1, 2, 3, 4, 5, 7, 8, 9]


def test_timestamps_order_a_history(spark):
    rows = [(i, "http://a.b/c", f"{i}" * 10, f"2024-01-{20 - i:02d} 00:00:00") for i in range(1, 10)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, stamp string").withColumn("stamp", F.col("stamp").cast("timestamp"))
    assert [r["page_id"] for r in warc.archive(docs, stamp_col="stamp").collect()] == list(range(9, 0, -1))


def test_null_ids_repeats_and_empty_table(spark, tmp_path):
    rows = [(None, "http://a/", "n" * 200, ""), (None, "http://a/", "n" * 200, ""), (5, "http://b/", "m" * 200, ""), (5, "http://b/", "m" * 200, ""), (6, "http://b/", "m" * 200, ""), (None, "http://c/", "m" * 200, "")]
    got = warc.archive(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if r["refers_to"] is None) == [(-1, "response", None)] * 2 + [(5, "response", None)] * 2
    assert sorted((r["page_id"] or -1, r["refers_to"]) for r in got if r["refers_to"] is not None) == [(-1, 5), (6, 5)]
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op7_warc(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.randint(0, 12))) for i in range(k)]
    runs = [[(key, (key, i)) for key, i in run] for run in runs]
    merged = [x[1] for x in warc.LoserTree(runs)]
    assert merged == sorted(v for run in runs for _, v in run)


def test_a_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"no record"))
    assert list(warc.parse(b"")) == []


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com/A?b#c", "com,example)/a?b"), ("https://u:p@x.y.org:8080", "org,y,x)/"), (None, ""), ("/only/path", "/only/path")])
def test_url_keys(spark, url, key):
    (r,) = spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()
    assert r["k"] == key
