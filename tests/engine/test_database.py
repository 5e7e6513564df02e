import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from docframe import Database, Table
from docframe.cli import main
from docframe.server import Server

SCHEMA = """
tables:
  users:
    primary_key: id
    directory: users
    gsis:
      by_status: { partition_key: status }
      by_email: { partition_key: email }
    associations:
      posts: { type: has_many, table: posts, index: by_user }
      jobs: { type: has_many_through, through: assignments, index: by_worker, table: jobs, foreign_key: job_id }
  posts:
    primary_key: id
    directory: posts
    gsis:
      by_user: { partition_key: user_id, sort_key: created_at }
    associations:
      author: { type: belongs_to, table: users, foreign_key: user_id }
      comments: { type: has_many, table: comments, index: by_post }
    search: { fields: [title] }
  comments:
    primary_key: id
    directory: comments
    gsis: { by_post: { partition_key: post_id } }
  assignments:
    primary_key: id
    directory: assignments
    gsis: { by_worker: { partition_key: user_id } }
  jobs:
    primary_key: id
    directory: jobs
    storage: memory
"""
DATA = {
    "users": [{"id": "u1", "name": "Alice", "status": "active", "email": "alice@example.com"}, {"id": "u2", "name": "Bob", "status": "active"}, {"id": "u3", "name": "Carol", "status": "inactive"}],
    "posts": [{"id": f"p{i}", "user_id": "u1" if i % 2 else "u2", "title": f"Post number {i}", "created_at": f"2024-01-{20 - i:02d}"} for i in range(1, 9)] + [{"id": "p9", "user_id": "gone", "title": "Lost", "created_at": "2024-02-01"}, {"id": "p10", "title": "Null", "created_at": "2024-02-01"}],
    "comments": [{"id": "c1", "post_id": "p1"}, {"id": "c2", "post_id": "p1"}, {"id": "c3", "post_id": "p3"}],
    "assignments": [{"id": "a1", "user_id": "u1", "job_id": 7}, {"id": "a2", "user_id": "u1", "job_id": "8"}, {"id": "a3", "user_id": "u1", "job_id": 7}, {"id": "a4", "user_id": "u1", "job_id": "none"}],
    "jobs": [{"id": 7, "name": "build"}, {"id": "8", "name": "test"}],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "schema.yml").write_text(SCHEMA)
    for table, rows in DATA.items():
        os.makedirs(root / table)
        for r in rows:
            (root / table / f"file-{r['id']}.json").write_text(json.dumps(r))
    return root


@pytest.fixture(scope="module")
def db(spark, root):
    return Database.from_schema(str(root / "schema.yml"), str(root), spark)


def ids(result):
    return [r["id"] for r in result["items"]]


def test_basic(db):
    assert db.execute({"users": {"pk": "u1"}}) == DATA["users"][0]
    assert db.execute({"users": {"pk": "none"}}) is None
    assert db.execute({"jobs": {"pk": 7}})["name"] == db.execute({"jobs": {"pk": "7"}})["name"] == "build"
    assert ids(db.execute({"users": {}})) == ["u1", "u2", "u3"] and ids(db.execute({"users": None})) == ["u1", "u2", "u3"]
    assert ids(db.execute({"users": {"where": {"status": "active", "name": "Bob"}}})) == ["u2"]
    assert ids(db.execute({"users": {"where": {"email": None}}})) == ["u2", "u3"]
    assert db.execute({"users": {"pk": "u2", "fields": ["name", "email"]}}) == {"name": "Bob", "email": None}
    assert ids(db.execute({"posts": {"search": "POST 3"}})) == ["p3"]
    assert ids(db.execute({"posts": {"search": "post", "where": {"user_id": "u2"}}})) == ["p2", "p4", "p6", "p8"]


def test_indexed(db):
    q = {"index": "by_user", "where": {"user_id": "u1", "title": "ignored"}}
    assert ids(db.execute({"posts": q})) == ["p7", "p5", "p3", "p1"]
    assert ids(db.execute({"posts": q | {"sort_direction": "desc", "limit": 2}})) == ["p1", "p3"]
    assert ids(db.execute({"posts": q | {"sort": {"between": ["2024-01-15", "2024-01-17"]}}})) == ["p5", "p3"]
    assert ids(db.execute({"posts": {"index": "by_user", "where": {}}})) == []


def test_paging(db):
    got, token, pages = [], None, 0
    while True:
        r = db.execute({"posts": {"limit": 4} | ({"next_token": token} if token else {})})
        got, pages = got + ids(r), pages + 1
        if "next_token" not in r:
            break
        token = r["next_token"]
    assert pages == 3 and got == sorted(p["id"] for p in DATA["posts"])
    assert "next_token" not in db.execute({"posts": {"limit": 10}})
    for bad in ({"limit": 0}, {"limit": 3, "next_token": "x"}, {"limit": -1}):
        with pytest.raises(ValueError):
            db.execute({"posts": bad})


def test_include(db):
    r = db.execute({"users": {"pk": "u1", "fields": ["name"], "include": {"posts": {"limit": 1, "fields": ["id"], "include": {"comments": {}, "author": {"fields": ["name"]}}}}}})
    assert r["name"] == "Alice" and [p["id"] for p in r["posts"]] == ["p7", "p5", "p3", "p1"]
    assert [[c["id"] for c in p["comments"]] for p in r["posts"]] == [[], [], ["c3"], ["c1", "c2"]]
    assert all(p["author"] == {"name": "Alice"} for p in r["posts"])
    assert [j["name"] for j in db.execute({"users": {"pk": "u1", "include": {"jobs": {}}}})["jobs"]] == ["build", "test", "build"]
    assert db.execute({"users": {"pk": "u3", "include": {"posts": {}, "jobs": {}}}}) == DATA["users"][2] | {"posts": [], "jobs": []}
    posts = {p["id"]: p for p in db.execute({"posts": {"include": {"author": {}}}})["items"]}
    assert posts["p9"]["author"] is None and posts["p10"]["author"] is None and posts["p1"]["author"]["id"] == "u1"
    with pytest.raises(KeyError):
        db.execute({"users": {"pk": "u1", "include": {"nobody": {}}}})


def test_resolve_association(db):
    users, posts = db.tables["users"], db.tables["posts"]
    assert [p["id"] for p in users.resolve_association("posts", "u2", db.tables)] == ["p8", "p6", "p4", "p2"]
    assert posts.resolve_association("author", "p1", db.tables)["name"] == "Alice"
    assert posts.resolve_association("author", "p9", db.tables) is None and users.resolve_association("posts", "none", db.tables) == []


def test_self_reference(spark):
    t = Table("categories", primary_key="id", spark=spark)
    t.bulk_load([{"id": "root", "parent_id": None}, {"id": "a", "parent_id": "root"}, {"id": "b", "parent_id": "root"}, {"id": "c", "parent_id": "a"}])
    t.add_gsi("by_parent", "parent_id")
    t.add_has_many("children", "categories", "by_parent")
    t.add_belongs_to("parent", "categories", "parent_id")
    db = Database(spark)
    db.add_table("categories", t)
    r = db.execute({"categories": {"pk": "root", "include": {"children": {"include": {"children": {}}}, "parent": {}}}})
    assert r["parent"] is None and [(c["id"], [x["id"] for x in c["children"]]) for c in r["children"]] == [("a", ["c"]), ("b", [])]


def test_validate_describe_check_warm(db):
    assert db.validate() == [{"table": "posts", "record_pk": "p9", "association": "author", "foreign_key": "user_id", "missing_target": "gone"}]
    d = db.describe()
    assert d["users"]["storage"] == "index_only" and d["jobs"]["storage"] == "memory" and d["posts"]["search_fields"] == ["title"] and not d["users"]["stale"]
    assert all(c["added"] == 0 for c in db.check().values()) and set(db.warm()) == set(DATA)


def test_errors(db):
    for bad in ({}, {"users": {}, "posts": {}}, [], {"users": 3}):
        with pytest.raises(ValueError):
            db.execute(bad)
    with pytest.raises(KeyError):
        db.execute({"nobody": {}})


def test_typed_tables_and_lazy_queries(spark):
    db = Database(spark)
    frame = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(9)], "k long, g int, name string")
    t = db.add_table("t", frame, primary_key="k")
    t.add_gsi("by_g", "g")
    q = db.query({"t": {"index": "by_g", "where": {"g": 1}, "fields": ["k"]}})
    assert q.columns == ["k"] and [r["k"] for r in q.collect()] == [1, 4, 7]
    t.put({"k": 100, "g": 1, "name": "new"})
    t.delete(4)
    assert [r["k"] for r in db.execute({"t": {"index": "by_g", "where": {"g": 1}}})["items"]] in ([1, 100, 7], [1, 7, 100])


def test_filters_reach_the_scan(spark):
    from docframe import catalog

    plan = catalog.QUERIES["gsi_hash"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    plan = catalog.QUERIES["pk_text_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_cli(spark, root, capsys):
    base = ["query", "--dir", str(root)]
    assert main([*base, "--table", "users", "--index", "by_email", "--where", "email=alice@example.com"]) == 0
    assert [r["id"] for r in json.loads(capsys.readouterr().out)] == ["u1"]
    assert main([*base, "--table", "users", "--index", "by_email", "--where", "email=nobody"]) == 0
    assert json.loads(capsys.readouterr().out) == []
    assert main([*base, "--schema", str(root / "schema.yml"), "--table", "users", "--pk", "u2"]) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "Bob"
    assert main([*base, "--table", "nonexistent"]) == 1
    assert "not found" in capsys.readouterr().err


def test_server(db, root):
    server = Server(db, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body.encode() if body is not None else None)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.headers["Content-Type"], json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, e.headers["Content-Type"], json.loads(e.read())

    try:
        assert call("/query", '{"users": {"pk": "u1"}}') == (200, "application/json", DATA["users"][0])
        assert call("/query", "not json")[0] == 400 and "error" in call("/query", '{"nobody": {}}')[2]
        assert call("/health")[2]["status"] == "ok" and call("/memory")[2]["rss_bytes"] > 0 and call("/none")[0] == 404
        assert call("/describe", "")[2]["users"]["record_count"] == 3 and len(call("/validate", "")[2]["violations"]) == 1
        (root / "users" / "late.json").write_text('{"id": "u9", "status": "late"}')
        assert [r["id"] for r in call("/query", '{"users": {"index": "by_status", "where": {"status": "late"}}}')[2]["items"]] == ["u9"]
        assert call("/warm", "")[0] == 200
    finally:
        server.shutdown()
        os.unlink(root / "users" / "late.json")
        db.warm()


def test_streaming_ingest(spark, tmp_path):
    from docframe.streaming import ingest_json, ingest_table, watch_changes

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1}')
    ingest_table(ingest_json(spark, str(source)).selectExpr("to_json(doc) AS doc", "_file"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (source / "b.json").write_text('{"id": 2}')
    ingest_table(ingest_json(spark, str(source)).selectExpr("to_json(doc) AS doc", "_file"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["doc"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ['{"id":1}', '{"id":2}']
    seen = []
    watch_changes(ingest_json(spark, str(source)), lambda b, _: seen.extend(r["_file"] for r in b.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(seen) == ["a.json", "b.json"]
