import hashlib
import random
import re

from docframe.llm import secrets as sc

RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, rx, g, least) in enumerate(RULES) for m in rx.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


def texts():
    rng = random.Random(4)
    bits = ['password="', "token = ", "SECRET:", "api_key='", "ApiKey=", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef" * 4, " ", "\n", "é", "\U0001f600", "\x01", "\x02", "=", ":", "abc", "hunter2+/_.", "passwd", "AKIA" * 6]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", None, "passwd=token:abcdefgh", "x" * 200_000 + " token=abcdefg", "$1 token=abcdef \\ $0"]


def test_against_brute_force(spark, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "token=abcdef", "c"), (0, None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"]) for r in sc.op3_secrets(spark, str(tmp_path)).collect())
    want = sorted((i is None, i or 0, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t, _ in rows)
    assert got == want


def test_more_rules_add_spans(spark, tmp_path):
    text = "-----BEGIN RSA PRIVATE KEY----- token=ghp_" + "a1B2" * 10
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = sc.op3_secrets(spark, str(tmp_path)).collect()
    spans = r["spans"].split(",")
    assert spans[0] == "pem:0:31" and set(base_spans(text).split(",")) < set(spans)


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    first = spark.createDataFrame([("a.py", 1, "token=abcdef"), ("b.py", 1, "nothing")], "path string, version int, text string")
    found, fresh = sc.scan(first, ledger)
    assert fresh.count() == 2 and {r["path"]: len(r["_spans"]) for r in found.collect()} == {"a.py": 1, "b.py": 0}
    known = {r["blob"] for r in fresh.collect()}
    second = spark.createDataFrame([("a.py", 2, "nothing"), ("c.py", 1, "token=abcdef"), ("d.py", 1, "secret: zzzzzzz")], "path string, version int, text string")
    found, fresh = sc.scan(second, ledger)
    assert {r["path"]: len(r["_spans"]) for r in found.collect()} == {"a.py": 0, "c.py": 1, "d.py": 1}
    assert fresh.count() == 1 and not {r["blob"] for r in fresh.collect()} & known and sc.ledger_at(spark, ledger).count() == 3
    _, fresh = sc.scan(second, ledger, version="2")  # a new rule version scans blobs again
    assert fresh.count() == 3 and sc.ledger_at(spark, ledger).count() == 6
    _, fresh = sc.scan(second, ledger, version="2")
    assert fresh.count() == 0


def test_the_query_twice_with_one_ledger(spark, tmp_path):
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(tuple(r) for r in sc.op3_secrets(spark, str(tmp_path), f"{tmp_path}/ledger").collect())
    blobs = sc.ledger_at(spark, f"{tmp_path}/ledger").count()
    assert sorted(tuple(r) for r in sc.op3_secrets(spark, str(tmp_path), f"{tmp_path}/ledger").collect()) == first
    assert sc.ledger_at(spark, f"{tmp_path}/ledger").count() == blobs


def test_a_text_of_many_matches(spark):
    text = "token=abcdef " * 20_000
    found, _ = sc.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    spans = [(s["start"], s["stop"]) for s in found.first()["_spans"]]
    assert spans == [(13 * i, 13 * i + 12) for i in range(20_000)]


def test_empty_table_and_native_plan(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sc.op3_secrets(spark, str(tmp_path))
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
