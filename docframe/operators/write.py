"""One JSON file per record, written to a temporary name and renamed."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


class InvalidKey(ValueError):
    """A key that cannot be a file name."""


def check_key(key: str) -> str:
    if "/" in key or "\\" in key:
        raise InvalidKey(f"keys of file-backed tables hold no path separators: {key!r}")
    return key


def write_atomic(directory: str, key: str, text: str) -> str:
    """Write <key>.json; readers see the old file or the new one, never a part."""
    check_key(key)
    os.makedirs(directory, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=directory, prefix=".tmp-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, os.path.join(directory, f"{key}.json"))
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return f"{key}.json"


class JsonWriter:
    """Writes (key, text) rows to a directory that all tasks share; a repeated task writes the
    same files again."""

    def __init__(self, directory: str):
        self.directory = directory

    def write(self, rows: DataFrame) -> int:
        os.makedirs(self.directory, exist_ok=True)
        directory = self.directory

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, text in zip(b["key"], b["text"]):
                    write_atomic(directory, key, text)
                yield pd.DataFrame({"n": [len(b)]})

        return rows.select("key", "text").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0
