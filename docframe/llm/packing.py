"""Bounded-space online packing of token sequences.

A task reads its documents in order and keeps at most OPEN windows of ``capacity`` tokens. The
part of a document beyond whole windows goes to the open window that it fills best. Where none
has room, the fullest one is emitted: the document is cut so that its head fills that window to
the last token, and the rest is placed again. A document of at least ``capacity`` tokens first
gives whole windows of its own. When a task ends it packs its open windows into each other the
same way, so that one partial window is left. Those of all tasks, one each, are merged whole, by
best fit, in groups of MERGE, in rounds until one group is left.

Tokens are never moved: only pieces (document, start, length, checksum) are, and the merge of
leftovers cuts nothing, so checksums stay.

Tokens. Where a vocabulary's pre-tokeniser never joins characters across white space (which is
read from its file), a text's ids are those of its white-space-separated words in turn. Plain
words are cut into pieces by the file's own pattern and each distinct piece goes to its model
once; other words go through the whole tokenizer. What is known stays with the worker process, up
to CACHED_BYTES. Texts with a special token's string or with separator control characters, where
that rule needs care, and texts for any other kind of vocabulary are encoded whole.

Defined results: null texts are empty and give the end id alone; ids of any type, null ones too, are kept; texts of any length are packed
whole; repeated rows give pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_of

CAPACITY, OPEN, MERGE, END_ID = 2048, 64, 64, 1
#: What a worker process keeps of known words, and what each takes besides its characters.
CACHED_BYTES, WORD_BYTES = 64 << 20, 130
CARE = re.compile(r"[\x1c-\x1f]|<\|")
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part boolean"


def word_rule(path: str) -> tuple[str, bool] | None:
    """(pattern of pieces, whether lower case) of a tokenizers file by which words may be encoded
    one by one; None for files of another build."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x, inner: x.get(inner, [x]) if x else []
    cuts = parts(spec.get("pre_tokenizer"), "pretokenizers")
    norms = [n["type"] if n["type"] != "Replace" else (n["pattern"].get("Regex"), n["content"]) for n in parts(spec.get("normalizer"), "normalizers")]
    if not cuts or cuts[0]["type"] != "Split" or not cuts[0].get("invert") or cuts[0].get("behavior") != "Removed":
        return None
    if any(c["type"] != "ByteLevel" or c.get("use_regex", True) or c.get("add_prefix_space", True) for c in cuts[1:]):
        return None
    pattern = cuts[0]["pattern"].get("Regex")
    if pattern is None or any(n not in ("NFC", "Lowercase", ("\\s+", " ")) for n in norms):
        return None
    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not CARE.match(c))
    return None if regex.search(pattern, white) else (pattern, "Lowercase" in norms)


class Words(dict):
    """Words to the bytes of their ids; a new word is encoded when it is first looked up."""

    def __init__(self, whole, pattern: str, lower: bool):
        import regex

        self.whole, self.model, self.lower, self.size = whole, whole.model, lower, 0
        self.cut = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            low = word.lower() if self.lower else word
            pieces = [low] if low.isalpha() else self.cut(low)
            if pieces == [word]:
                out = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            else:
                out = b"".join([self[p] for p in pieces])
        else:
            out = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        self.size += WORD_BYTES + len(word) + len(out)
        self[word] = out
        return out


class WordTokenizer:
    """ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        rule = word_rule(path)
        self.words = Words(self.whole, *rule) if rule else None
        self.end = array("I", [END_ID]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids and the end id."""
        if self.words is None or CARE.search(text):
            return np.array([*self.whole.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
        if self.words.size > CACHED_BYTES:
            self.words.clear()
            self.words.size = 0
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())) + self.end, "<u4")


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One per worker process, so that its words serve all tasks that the process runs."""
    return WordTokenizer(path)


class Packer:
    """Windows of one task; ``emit`` receives closed windows as lists of pieces.

    A piece is [row, start, ids, doc_tokens]; ids are kept only while the window is open.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (room, window) in order
        self.windows: dict[int, list] = {}
        self.made = 0
        self.closed: list[list] = []

    def add(self, row: int, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.closed.append([[row, start, ids[start : start + self.capacity], total]])
            start += self.capacity
        self.place([row, start, ids[start:], total])

    def place(self, piece: list) -> None:
        while len(piece[2]):
            at = bisect_left(self.free, (len(piece[2]), -1))
            if at < len(self.free):
                return self.put(at, piece)
            if len(self.free) < self.limit:
                self.windows[self.made] = []
                insort(self.free, (self.capacity, self.made))
                self.made += 1
                continue
            room = self.free[0][0]  # none fits: the fullest is filled by a cut and emitted
            head, piece = [piece[0], piece[1], piece[2][:room], piece[3]], [piece[0], piece[1] + room, piece[2][room:], piece[3]]
            self.put(0, head)

    def put(self, at: int, piece: list) -> None:
        room, w = self.free.pop(at)
        self.windows[w].append(piece)
        if room == len(piece[2]):
            self.closed.append(self.windows.pop(w))
        else:
            insort(self.free, (room - len(piece[2]), w))

    def end(self) -> list | None:
        """Pack the open windows into each other; the partial one that is left."""
        rest = [self.windows[w] for _, w in self.free]
        self.free, self.windows, self.limit = [], {}, 1
        for piece in chain.from_iterable(rest):
            self.place(piece)
        return next(iter(self.windows.values()), None)


COLUMNS = ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")


def _rows(windows: list[list], first: int, part: bool) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in COLUMNS}
    for k, pieces in enumerate(windows):
        offset = 0
        for row, start, ids, total in pieces:
            for name, v in zip(out, (row, start, len(ids), zlib.crc32(ids.tobytes()), total, first + k, offset, part)):
                out[name].append(v)
            offset += len(ids)
    return out


def pack_tokens(tokenizer_path: str, capacity: int = CAPACITY, limit: int = OPEN):
    """A function for mapInArrow: batches of (row, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokenizer_of(tokenizer_path), Packer(capacity, limit)
        context = TaskContext.get()
        first, types = (context.partitionId() if context else 0) << 40, {"part": pa.bool_()}

        def batch(windows, part=False):
            nonlocal first
            got = _rows(windows, first, part)
            first += len(windows)
            return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in got.items()})

        for b in batches:
            types["row"] = b.schema.field("row").type
            rows = b.column("row").to_pylist()
            for lo in range(0, len(rows), 256):
                for row, text in zip(rows[lo : lo + 256], b.column("text").slice(lo, 256).to_pylist()):
                    packer.add(row, tokens.encode(text))
                if packer.closed:
                    yield batch(packer.closed)
                    packer.closed = []
        left = packer.end()
        if packer.closed:
            yield batch(packer.closed)
        if left:
            yield batch([left], True)

    return run


def _merge(capacity: int):
    """A function for applyInPandas: whole partial windows of a group into as few as best fit gives."""

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["sequence_id", "offset"], kind="stable")
        size = pieces.groupby("sequence_id")["length"].sum()
        order = sorted(size.items(), key=lambda x: (-x[1], x[0]))
        free: list[tuple[int, int]] = []
        used, to = {}, {}
        for w, n in order:
            at = bisect_left(free, (n, -1))
            room, goal = free.pop(at) if at < len(free) else (capacity, w)
            to[w], used[w] = goal, capacity - room
            insort(free, (room - n, goal))
        pieces["offset"] += pieces["sequence_id"].map(used)
        pieces["sequence_id"] = pieces["sequence_id"].map(to)
        return pieces

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, limit: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset); ids keep their type."""
    rows = docs.select(F.col(id_col).alias("row"), text_of(F.col(text_col)).alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, {PIECES}"
    pieces = materialize(rows.mapInArrow(pack_tokens(tokenizer_path, capacity, limit), kind), "pieces")
    left, done = pieces.where("part"), pieces.where("not part")
    tasks = left.select("sequence_id").distinct().count()
    width = MERGE
    while tasks > 1:
        # sequence ids begin with the task's number, so its neighbours share a group
        group = F.shiftright("sequence_id", 40) / F.lit(width)
        left = left.groupBy(F.floor(group).alias("_group")).applyInPandas(_merge(capacity), kind)
        left = materialize(left, "left")
        tasks, width = -(-tasks // MERGE), width * MERGE
    out = done.unionByName(left)
    return out.select(F.col("row").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def pack_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left."""
    return pack(docs, default_tokenizer())
