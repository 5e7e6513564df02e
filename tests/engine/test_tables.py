import json
import os
import time

import pytest

from docframe import GSI, Database, Sort, Table
from docframe.operators.write import InvalidKey
from docframe.spec import SchemaError


def users(spark, **more):
    return Table("users", primary_key="id", spark=spark, **more)


def write(folder, name, record):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(record if isinstance(record, str) else json.dumps(record, indent=2))


@pytest.fixture
def folder(tmp_path):
    path = str(tmp_path / "users")
    for i in range(5):
        write(path, f"user-{i}.json", {"id": f"user-{i}", "status": "active", "n": i})
    return path


def test_crud(spark):
    t = users(spark)
    t.put({"id": "a", "name": "Alice"})
    t.put({"id": "a", "name": "Alicia"})
    t.bulk_load([{"id": "b"}, {"id": 3}])
    assert t.get("a") == {"id": "a", "name": "Alicia"} and t.get("none") is None
    assert t.get("3") == {"id": 3} and t.count() == 3
    t.delete("a")
    t.delete("none")
    assert [r["id"] for r in t.scan()] == [3, "b"]


def test_composite_key(spark, tmp_path):
    t = Table("scores", partition_key="user_id", sort_key="game_id", directory=str(tmp_path), spark=spark)
    t.put({"user_id": "u", "game_id": "g", "score": 1})
    t.put({"user_id": "u", "game_id": "h", "score": 2})
    assert os.path.exists(tmp_path / "u__g.json") and t.last_write_used_atomic
    assert t.get("u", "h")["score"] == 2
    t.delete("u", "g")
    assert t.count() == 1 and os.listdir(tmp_path) == ["u__h.json"]


def test_buffer_becomes_a_snapshot(spark, monkeypatch):
    monkeypatch.setattr("docframe.table.BUFFER", 5)
    t = users(spark)
    t.bulk_load({"id": str(i), "v": i} for i in range(12))
    t.put({"id": "3", "v": 99})
    t.delete("4")
    assert t.count() == 11 and t.get("3")["v"] == 99 and t.get("4") is None


@pytest.mark.parametrize("mode", ["memory", "index_only"])
def test_load_and_refresh(spark, folder, mode):
    t = users(spark, directory=folder, storage=mode)
    seen = []
    t.load_from_dir()
    assert t.count() == 5 and t.get("user-3")["n"] == 3 and not t.is_stale()
    write(folder, "new.json", {"id": "user-9", "status": "new"})
    write(folder, "_hidden.json", {"id": "hidden"})
    time.sleep(0.02)
    write(folder, "user-1.json", {"id": "user-1", "status": "changed!"})
    os.unlink(f"{folder}/user-2.json")
    assert t.check().to_dict() == {"added": 2, "modified": 1, "deleted": 1, "reread": 3} and t.count() == 5
    t.on_refresh.append(seen.append)
    assert t.refresh().to_dict() == {"added": 2, "modified": 1, "deleted": 1, "reread": 3}
    assert seen == [t.last_change_summary.to_dict()]
    assert sorted(r["id"] for r in t.scan()) == ["hidden", "user-0", "user-1", "user-3", "user-4", "user-9"]
    assert t.get("user-1")["status"] == "changed!" and t.check().to_dict()["added"] == 0


def test_queries_refresh_just_in_time(spark, folder):
    t = users(spark, directory=folder)
    t.load_from_dir()
    write(folder, "user-7.json", {"id": "user-7"})
    assert len(t.scan()) == 6
    still = users(spark, directory=folder, auto_refresh=False)
    still.load_from_dir()
    write(folder, "user-8.json", {"id": "user-8"})
    assert len(still.scan()) == 6 and still.is_stale(force_scan=True)
    lazy = users(spark, directory=folder, check_interval=60)
    lazy.load_from_dir()
    write(folder, "user-6.json", {"id": "user-6"})
    assert not lazy.is_stale() and lazy.is_stale(force_scan=True)


def test_odd_files(spark, folder):
    write(folder, "broken.json", '{"id": "x"')
    write(folder, "empty.json", "")
    write(folder, "array.json", '[{"id": "in-array"}]')
    write(folder, "no-key.json", {"name": "nobody"})
    write(folder, "twice.json", {"id": "user-0", "name": "Updated"})
    write(folder, "notes.txt", "not json")
    os.utime(f"{folder}/user-0.json", (1, 1))
    t = users(spark, directory=folder)
    t.load_from_dir()
    assert t.count() == 5 and t.get("user-0")["name"] == "Updated"
    assert t.load_errors == ["broken.json", "empty.json"]
    assert os.path.exists(f"{folder}/notes.txt")


def test_missing_directory(spark, tmp_path):
    t = users(spark, directory=str(tmp_path / "none"))
    t.load_from_dir()
    assert t.count() == 0 and t.scan() == []
    with pytest.raises(ValueError):
        users(spark).load_from_dir()


def test_types_survive(spark, folder):
    for i, v in enumerate((1, "10", True, 2.5, None, [1, "a"], {"x": None})):
        write(folder, f"v{i}.json", {"id": f"v{i}", "v": v})
    t = users(spark, directory=folder)
    t.load_from_dir()
    assert [t.get(f"v{i}")["v"] for i in range(7)] == [1, "10", True, 2.5, None, [1, "a"], {"x": None}]


@pytest.mark.parametrize("bad", ["user/1", "user\\1"])
def test_keys_are_file_names(spark, tmp_path, bad):
    with pytest.raises(InvalidKey):
        users(spark, directory=str(tmp_path)).put({"id": bad})
    t = users(spark)
    t.put({"id": bad})
    with pytest.raises(InvalidKey):
        t.export(str(tmp_path / "out"))


def test_export_round_trip(spark, tmp_path):
    t = users(spark)
    t.bulk_load({"id": f"u{i}", "tags": ["a", i], "none": None} for i in range(10))
    assert t.export(str(tmp_path / "out")) == 10
    back = users(spark, directory=str(tmp_path / "out"))
    back.load_from_dir()
    assert back.scan() == t.scan()
    assert users(spark).export(str(tmp_path / "empty")) == 0 and os.listdir(tmp_path / "empty") == []


def test_validation(spark):
    for mode in ("silent", "warn"):
        t = users(spark, validation=mode)
        t.add_gsi("by_email", "email")
        t.put({"name": "no key"})
        t.put({"id": "a"})
        assert t.count() == 1 and len(t.warnings) == (2 if mode == "warn" else 0)
    assert "primary key" in t.warnings[0] and "'email'" in t.warnings[1]
    strict = users(spark, validation="error")
    with pytest.raises(ValueError, match="primary key"):
        strict.put({"name": "x"})
    for wrong in (dict(validation="loud"), dict(storage="tape"), dict(storage="index_only"), dict(sort_key="s")):
        with pytest.raises(SchemaError):
            users(spark, **wrong)


def test_hooks(spark):
    t, seen = users(spark), []
    t.on_put += [lambda r: seen.append(("put", r["id"])), lambda r: 1 / 0, lambda r: seen.append(("again", r["id"]))]
    t.on_delete.append(lambda r: seen.append(("delete", r["name"])))
    t.put({"id": "a", "name": "Alice"})
    t.delete("a")
    t.delete("a")
    assert seen == [("put", "a"), ("again", "a"), ("delete", "Alice")] and len(t.hook_errors) == 1


def test_gsi_queries(spark):
    t = Table("users", primary_key="id", spark=spark)
    t.add_gsi("by_org", "org", "at")
    t.add_gsi("by_hash", "org")
    t.bulk_load([{"id": i, "org": o, "at": a} for i, o, a in (("a", "x", "2024-03-01"), ("b", "x", "2024-01-01"), ("c", "x", "2024-02-01"), ("d", "y", "2024-01-01"), ("e", "x", None), ("f", None, "2024-01-01"), ("g", "x", "2024-02-01"))])
    ids = lambda *a, **k: [r["id"] for r in t.query_gsi(*a, **k)]
    assert ids("by_org", "x") == ["b", "c", "g", "a"] and ids("by_org", "x", descending=True) == ["a", "g", "c", "b"]
    assert ids("by_org", "x", Sort.gte("2024-02-01")) == ["c", "g", "a"]
    assert ids("by_org", "x", lambda v: v.endswith("03-01")) == ["a"]
    assert ids("by_hash", "x") == ["a", "b", "c", "e", "g"] and ids("by_hash", "x", Sort.eq(1)) == []
    assert t.count("by_org", "x") == 4 and t.count("none", "x") == 0 and t.count("by_org", "none") == 0
    t.remove_gsi("by_hash")
    with pytest.raises(KeyError):
        t.query_gsi("by_hash", "x")


def test_gsi_object():
    g = GSI("g", "org", "n")
    for pk, n in (("a", 10), ("b", 9), ("c", "9"), ("d", None), ("e", 9)):
        g.put(pk, {"org": "x", "n": n})
    assert g.query("x") == ["b", "e", "a", "c"] and g.query("x", sort_direction="desc") == ["c", "a", "e", "b"]
    assert g.query("x", Sort.gt(9)) == ["a"] and g.query("none") == [] and g.query(None) == []
    g.update("b", {"org": "x", "n": 9}, {"org": "y", "n": 1})
    g.remove("a", {"org": "x", "n": 10})
    assert g.query("x") == ["e", "c"] and g.query("y") == ["b"]
    with pytest.raises(ValueError):
        g.query("x", sort_direction="up")


def test_describe(spark):
    t = users(spark)
    t.add_gsi("by_email", "email")
    t.add_has_many("posts", "posts", "by_user")
    d = t.describe()
    assert d["record_count"] == 0 and d["primary_key"] == "id" and list(d["gsis"]) == ["by_email"] and d["associations"] == ["posts"]


def test_search_index_persists(spark, tmp_path):
    path = str(tmp_path / "news")
    write(path, "n1.json", {"id": "n1", "title": "Alpha Beta", "tags": ["Gamma", 5, "delta-Echo"], "n": 7})
    write(path, "n2.json", {"id": "n2", "title": "Omega", "tags": "ALPHA zeta"})
    make = lambda: Table("news", primary_key="id", directory=path, search_fields=["title", "tags", "n"], spark=spark)
    t = make()
    t.load_from_dir()
    ids = lambda q: [r["id"] for r in t.search(q)]
    assert ids("alpha") == ["n1", "n2"] and ids("alpha beta") == ["n1"] and ids("echo GAMMA") == ["n1"]
    assert ids("none") == ids("") == ids("alpha none") == ids("7") == []
    assert os.path.exists(tmp_path / ".docframe/index/news/postings")
    again = make()
    again.load_from_dir()
    assert again.persist_search_index() is True
    write(path, "n3.json", {"id": "n3", "title": "alpha"})
    assert [r["id"] for r in again.search("alpha")] == ["n1", "n2", "n3"]
    with pytest.raises(ValueError):
        users(spark).search("x")


def test_concurrent_readers_see_whole_snapshots(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    t = users(spark, directory=folder, storage="memory")
    t.load_from_dir()
    with ThreadPoolExecutor(4) as pool:
        reads = [pool.submit(lambda: len(t.scan_snapshot())) for _ in range(6)]
        write(folder, "user-8.json", {"id": "user-8"})
        pool.submit(t.refresh).result()
        assert all(r.result() in (5, 6) for r in reads) and t.count() == 6


def test_schema_errors(spark, tmp_path):
    for bad, what in (({"tables": {"t": {"directory": "t"}}}, "primary_key"), ({"tables": {"t": {"primary_key": "id", "gsis": {"g": {}}}}}, "partition_key"), ({}, "tables"), ({"tables": {"t": {"primary_key": "id", "associations": {"a": {"type": "has_many", "table": "u"}}}}}, "index")):
        with pytest.raises(SchemaError, match=what):
            Database.from_schema_dict(bad, str(tmp_path), spark)


def test_threads_put_and_none_is_lost(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    import docframe.table as module

    table = Table("users", primary_key="id", directory=str(tmp_path), spark=spark)
    old, module.BUFFER = module.BUFFER, 30
    try:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda i: table.put({"id": f"u{i}", "n": i}), range(100)))
            counts = list(pool.map(lambda _: table.count(), range(4)))
    finally:
        module.BUFFER = old
    assert counts == [100] * 4 and {r["id"] for r in table.scan()} == {f"u{i}" for i in range(100)}
    again = Table("users", primary_key="id", directory=str(tmp_path), spark=spark)
    again.load_from_dir()
    assert again.count() == 100


def test_threads_put_one_key_and_refresh(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = Table("users", primary_key="id", directory=str(tmp_path), spark=spark)
    table.put({"id": "a", "n": -1})
    with ThreadPoolExecutor(8) as pool:
        waits = [pool.submit(table.put, {"id": "a", "n": i}) for i in range(20)] + [pool.submit(table.refresh) for _ in range(3)]
        reads = [pool.submit(table.get, "a") for _ in range(4)]
        for w in waits:
            w.result()
    assert all(r.result()["n"] in range(-1, 20) for r in reads)
    table.put({"id": "a", "n": 99})
    assert table.get("a") == {"id": "a", "n": 99} and table.count() == 1


def test_bulk_load_in_batches(spark, tmp_path, monkeypatch):
    import docframe.table as module

    monkeypatch.setattr(module, "BATCH", 40)
    table, seen = Table("users", primary_key="id", directory=str(tmp_path), spark=spark), []
    table.on_put.append(seen.append)
    table.bulk_load([{"id": f"u{i % 90}", "n": i} for i in range(100)] + [{"n": 5}])
    assert table.count() == 90 and len(seen) == 100 and table.get("u3")["n"] == 93
    assert sorted(r["n"] for r in table.get_many(["u0", "u50", "none"])) == [50, 90]
    again = Table("users", primary_key="id", directory=str(tmp_path), spark=spark)
    again.load_from_dir()
    assert again.count() == 90 and again.get("u3")["n"] == 93


def test_rows_are_put_as_single_records_are(spark, monkeypatch):
    rows = [("a", "x"), (None, "x"), ("b", None), (None, None), ("c", "y")]
    one, many = (users(spark, validation="warn") for _ in range(2))
    for t in (one, many):
        t.add_gsi("by_email", "email")
        t.put({"id": "a", "email": "old"})
    for i, e in rows:
        one.put({k: v for k, v in (("id", i), ("email", e)) if v is not None})
    monkeypatch.setattr(Table, "put", lambda *_: pytest.fail("records pass through the driver"))
    problems = many.put_rows(spark.createDataFrame(rows, "id string, email string"))
    assert sorted(r["problem"] for r in problems.collect()) == sorted(one.warnings) and len(one.warnings) == 3
    assert many.scan() == one.scan() and many.count() == 3 and many.get("a")["email"] == "x"
    with pytest.raises(ValueError, match="primary key"):
        users(spark, validation="error").put_rows(spark.createDataFrame(rows, "id string, email string"))


def test_many_flushes_keep_a_short_plan(spark, monkeypatch):
    """Before, each flush put its plan on top of all earlier ones, which filled the driver."""
    monkeypatch.setattr("docframe.table.BUFFER", 2)
    monkeypatch.setattr("docframe.table.LINEAGE", 4)
    t, sizes = users(spark), []
    for i in range(32):
        t.put({"id": str(i % 20), "n": i})
        sizes.append(len(t.view().frame._jdf.queryExecution().toString()))
    assert t.count() == 20 and t.get("3")["n"] == 23 and t.get("15")["n"] == 15
    assert max(sizes[16:]) < 1.2 * max(sizes[:16])
