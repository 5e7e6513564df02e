import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docframe.llm import line_dedup as ld


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, least=ld.MIN_CHARS):
    """rows of (doc_id, text) with distinct ids: id to kept text."""
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, (i is not None, i or 0, k))
    lines = sorted(first, key=first.get)
    near = {b for n, b in enumerate(lines) if any(within_one(a, b) for a in lines[:n] if abs(len(a) - len(b)) <= 1)}
    keep = lambda i, k, x: len(x) < least or (first[x] == (i is not None, i or 0, k) and x not in near)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if keep(i, k, x)) for i, t in rows}


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(18, 40))) for _ in range(25)]
    base += ["aaaaaaaaaaaaaaaaaaaaaaaaa", "ababababababababababababab", "x" * 20, "\U0001f600" * 21]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x, edit, at = rng.choice(base), rng.randint(0, 5), 0
            at = rng.randrange(len(x))
            lines.append({0: x[:at] + x[at + 1 :], 1: x[:at] + rng.choice("abz") + x[at:], 2: x[:at] + rng.choice("abz") + x[at + 1 :], 3: x[:at] + "zz" + x[at:]}.get(edit, x))
        rows.append((i * 3, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, "\n\n"), (None, "a line without any id at all")]
    spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, line string, row int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in ld.op6_line_dedup(spark, str(tmp_path)).collect()}
    want = brute_force(rows)
    assert {i: r["text_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(got[i]["n_lines"] == len((t or "").split("\n")) for i, t in rows)


def test_texts_come_by_a_join(spark, tmp_path):
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text_sha256"] for r in ld.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute_force(rows).items()}


def test_a_very_long_line(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    rows = [(1, long), (2, long[:50_000] + "z" + long[50_000:]), (3, long[::-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_dropped"] for r in ld.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "this is a line of text"), (1, "this is a line of text"), (2, "this is a line of text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted((r["doc_id"], r["n_dropped"]) for r in ld.op6_line_dedup(spark, f"{tmp_path}/a").collect())
    assert got == [(1, 0), (1, 0), (2, 1)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert ld.op6_line_dedup(spark, f"{tmp_path}/b").collect() == []


def test_stage_keeps_clean_documents(spark):
    rows = [(1, "one line that stays as it is\nshort", "en", 1), (2, "one line that stays as it is\nanother line which is new", "en", 1), (3, "one line that stays as it is", "en", 1), (4, "", "en", 0), (5, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = ld.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (rows[0][1], 1), 2: ("another line which is new", 25), 4: ("", 0), 5: (None, None)}


def test_within_one_against_the_definition():
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("aé") for _ in range(rng.randint(0, 6)))
        b = "".join(rng.choice("aé") for _ in range(rng.randint(0, 6)))
        assert ld.within_one(a, b) == within_one(a, b), (a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def bounds_brute_force(rows, bounds):
    """rows of (doc_id, text) with distinct ids from 0 on: id to kept text."""
    least, first = bounds[0][0], {}
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= least:
                first.setdefault(line, (i, k))
    lines = sorted(first, key=first.get)
    bound = lambda a, b: max(k for n, k in bounds if min(len(a), len(b)) >= n)
    near = {b for n, b in enumerate(lines) if any(abs(len(a) - len(b)) <= 3 and distance(a, b) <= bound(a, b) for a in lines[:n])}
    keep = lambda i, k, x: len(x) < least or (first[x] == (i, k) and x not in near)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if keep(i, k, x)) for i, t in rows}


@pytest.mark.parametrize("bounds", [((20, 1), (24, 2)), ((6, 1), (12, 2), (22, 3))])
def test_bounds_against_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(ld, "FEW", 2)
    monkeypatch.setattr(ld, "BLOCK", 5)
    rng = random.Random(len(bounds))
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([6, 12, 20, 22, 23, 24, 25, 31]))) for _ in range(20)] + ["ab" * 12]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice(["", "z" + x[at], rng.choice("az")]) + x[at + 1 :]
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    docs = ld.with_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in ld.dedup(docs, bounds=bounds).collect()}
    assert got == bounds_brute_force(rows, bounds)


def test_within_against_the_definition():
    rng = random.Random(10)
    for _ in range(2000):
        a = "".join(rng.choice("aéb") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("aéb") for _ in range(rng.randint(0, 9)))
        for k in (0, 1, 2, 3):
            assert ld.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_the_stage_drops_a_line_with_two_edits(spark):
    rows = [(1, "Ening thheeaan. That ha thnt to of of nd inntble."), (2, "Ening thheeaan. That ha thnt in of of nd inntble.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in ld.dedup_documents(spark, docs, "").collect()] == [1]


def test_texts_of_other_lines_are_not_shuffled(spark, monkeypatch):
    """Of many long lines two are neighbours; before, whole documents were shuffled for them."""
    monkeypatch.setattr(ld, "materialize", lambda df, name="": df)
    rng = random.Random(5)
    rows = [(i, "\n".join("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(20))) for i in range(200)]
    docs = ld.with_rows(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("row", F.col("_row"))
    every = ld.lines_of(docs).select(*ld._hashes("line"), F.struct("doc_id", "row", "no").alias("first"))
    some = every.where("first.doc_id in (3, 150) and first.no = 7").localCheckpoint()
    wanted = some.select(F.col("first.row").alias("_row"), F.col("first.no").alias("_no"))
    lines = ld.lines_of(docs).select(F.col("row").alias("_row"), F.col("no").alias("_no"), "line")
    left = [r["line"] for r in ld._may_be_in(lines, wanted, ["_row", "_no"]).collect()]
    want = {rows[i][1].split("\n")[7] for i in (3, 150)}
    assert want <= set(left) and len(left) < 20
    assert {r["text"] for r in ld._texts(docs, some).collect()} == want
    monkeypatch.setattr(ld, "BITS", 64)  # with far too few bits more lines come, but the texts are the same
    assert {r["text"] for r in ld._texts(docs, some).collect()} == want
