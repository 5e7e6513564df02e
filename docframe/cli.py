"""Command line: query, serve, memory."""

from __future__ import annotations

import argparse
import json
import os
import sys
import urllib.request

from .database import Database
from .table import Table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docframe")
    commands = p.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run one query and print its records")
    for name in ("--dir", "--table"):
        q.add_argument(name, required=True)
    for name in ("--schema", "--index", "--pk", "--where"):
        q.add_argument(name)
    s = commands.add_parser("serve", help="load once and answer over HTTP")
    for name in ("--dir", "--schema"):
        s.add_argument(name, required=True)
    m = commands.add_parser("memory", help="print the memory of a running server")
    for x in (s, m):
        x.add_argument("--port", type=int, default=8080)
        x.add_argument("--host", default="127.0.0.1")
    return p


def condition(text: str | None) -> dict[str, str]:
    if not text:
        return {}
    field, sign, value = text.partition("=")
    if not sign or not field:
        raise ValueError(f"--where takes field=value, not {text!r}")
    return {field: value}


def load(a: argparse.Namespace) -> Database:
    """By schema, or one folder as a table with key ``id`` and an index on the field of --where."""
    if a.schema:
        return Database.from_schema(a.schema, a.dir)
    folder = os.path.join(a.dir, a.table)
    if not os.path.isdir(folder):
        raise KeyError(f"table {a.table!r} not found in {a.dir}")
    table = Table(a.table, primary_key="id", directory=folder)
    if a.index:
        table.add_gsi(a.index, next(iter(condition(a.where)), "id"))
    table.load_from_dir()
    db = Database()
    db.add_table(a.table, table)
    return db


def run_query(a: argparse.Namespace) -> str:
    directive = {k: v for k, v in (("pk", a.pk), ("index", a.index), ("where", condition(a.where))) if v}
    found = load(a).execute({a.table: directive})
    return json.dumps(found["items"] if isinstance(found, dict) and a.pk is None else found, default=str)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "query":
            print(run_query(a))
        elif a.command == "memory":
            with urllib.request.urlopen(f"http://{a.host}:{a.port}/memory") as r:
                print(r.read().decode())
        else:
            from .server import Server

            server = Server(Database.from_schema(a.schema, a.dir), a.host, a.port)
            print(f"serving on http://{a.host}:{a.port}", flush=True)
            server.serve_forever()
    except KeyboardInterrupt:
        return 0
    except Exception as e:  # noqa: BLE001  reported to the caller of the command
        print(e.args[0] if isinstance(e, KeyError) and e.args else e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
