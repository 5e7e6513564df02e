"""Line dedup by a deletion-neighbourhood join, keeping the earliest.

A line occurrence goes when its line occurred earlier, in order of (doc_id, line number), or when
some line that first occurred earlier is within edit distance 1 of it. Lines of fewer than
``min_chars`` characters always stay, and so do documents' other lines.

Edit distance 1 is found by equality of hashed variants. A line emits, for each of its
characters, the variant without it. Two lines of one length that share a variant with the
character gone at the same place differ in that one character: key (variant, place). A line
that equals a variant of a line one longer differs from it by that insertion: key (variant).
So within a key all lines are neighbours of each other, or all of one line, and it is enough to
aggregate: the earliest line of each key answers for all, no pairs are formed, and a hot key is
pre-aggregated like any sum. Matches are then verified by edit distance on the texts.

Emitting variants of every line would multiply the corpus by the length of its lines. One edit
leaves one half of a line untouched, so lines that share neither half (at its length and place)
with another distinct line have no neighbour, and only the others emit, and only for characters of the half that may differ. That test loses nothing:
for each line it compares the halves it would have at its own length and at one less.

Bounds of more than 1, for lines of some length, are a parameter (``bounds``; the shorter line of a
pair decides). Then a line is split into bound + 1 segments, one of which ``bound`` edits leave
whole, at a place that they shift by few characters: lines that share such a segment are compared
and verified by edit distance. Up to FEW lines of a segment are paired by a join; more of them are
compared in blocks of bounded size, which give the lines that go and no pairs. No pair within the
bounds is lost; the comparisons within a block's hot segment grow with the square of its lines.

Lines and rows are the same where two 64-bit hashes of them agree; keys of variants and segments
have 64 bits and only choose what is compared, so a chance match costs a comparison, or, if it is
the earliest of a key, one link of that key (about 1e-6 a key for 1e13 keys).

Defined results: null texts count as empty and null ids sort first; rows that agree in id and
text count as one occurrence, and each is returned; texts of any length are taken whole; an empty
table gives an empty result. A document keeps its row, if need be with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove_table, table, text_of

MIN_CHARS = 20
B = 0x9E3779B97F4A7C15 | 1
B_INVERSE = pow(B, -1, 1 << 64)
#: (least characters, edit distance), in order of length
BOUNDS = ((20, 1), (40, 2))
#: Lines of a segment that are paired by a join, and lines or characters of half a block.
FEW, BLOCK, BLOCK_CHARS = 16, 512, 1 << 19
#: Bits that tell which lines' texts are not wanted: 2**18 rows of 64, some MB.
BITS = 1 << 24
VARIANTS = "line long, key long, whole boolean"
STEP = 1 << 16


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, no, line): every line of every document; ``row`` tells rows apart."""
    rows = docs.select("row", "doc_id", F.split(text_of(F.col("text")), "\n").alias("lines"))
    return rows.select("row", "doc_id", F.posexplode("lines").alias("no", "line"))


def _halves(line, length) -> list[F.Column]:
    """Keys of a line's halves at its own length, then at one less, as if a character were gone
    from the other half."""
    out = []
    for n in (length, length - 1):
        left = F.floor(n / 2).cast("int")
        for tag, part in ((0, F.substring(line, F.lit(1), left)), (1, F.right(line, (n - left).cast("int")))):
            out.append(F.xxhash64(n.cast("int"), F.lit(tag), part))
    return out


def _segments(line, length, bounds: tuple[tuple[int, int], ...]) -> tuple[F.Column, F.Column]:
    """(own, probe): keys of a line's segments, and of the parts that may be segments of lines of
    the same or a lesser length, as far as the edits before and after a part can shift it."""
    own = probe = none = F.expr("cast(array() as array<bigint>)")
    for gap in range(max(k for _, k in bounds) + 1):
        n, at_gap = (length - gap).cast("int"), none
        for least, k in bounds:
            mine, others = [], []
            for i in range(k + 1 if gap <= k else 0):
                start, stop = (F.floor(n * x / (k + 1)).cast("int") for x in (i, i + 1))
                for shift in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1):
                    key = F.xxhash64(n, F.lit(i), F.substring(line, start + (shift + 1), stop - start))
                    (others if gap or shift else mine).append(key)
            at_gap = F.when(n >= least, F.array(*others) if others else none).otherwise(at_gap)
            own = own if gap else F.when(n >= least, F.array(*mine)).otherwise(own)
        probe = F.concat(probe, at_gap) if gap else at_gap
    return own, probe


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (line, text, left, right) to the line's own key and those of its variants that
    lack a character of its left or right half, the middle one counting to both.

    Keys are polynomial hashes modulo 2**64 of mixed code points; prefix sums give those of all
    variants of a line at once.
    """

    def batch(lines, keys, whole):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (lines, keys, whole)], names=["line", "key", "whole"])

    power = np.ones(1, np.uint64)
    for b in batches:
        lines, keys, whole, size = [], [], [], 0
        for line, text, left, right in zip(*(b.column(c).to_pylist() for c in ("line", "text", "left", "right"))):
            cps = _mix(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1))
            if len(power) <= len(cps):
                power = np.full(2 * len(cps) + 1, B, np.uint64)
                power[0] = 1
                power = np.cumprod(power, dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cps * power[: len(cps)], dtype=np.uint64)])
            total = sums[-1]
            middle = (len(cps) - 1) // 2
            some = slice(0 if left else middle, len(cps) if right else middle + 1)
            gone = _mix(sums[:-1][some] + (total - sums[1:][some]) * np.uint64(B_INVERSE))
            place = _mix(gone + np.arange(1, len(cps) + 1, dtype=np.uint64)[some] * np.uint64(B))
            own = np.concatenate([place, np.unique(gone), _mix(np.array([total]))])
            keys.append(own.view(np.int64))
            whole.append(np.arange(len(own)) == len(own) - 1)
            lines.append(np.full(len(own), line, np.int64))
            size += len(own)
            if size > STEP:
                yield batch(lines, keys, whole)
                lines, keys, whole, size = [], [], [], 0
        if lines:
            yield batch(lines, keys, whole)


def within_one(a: str, b: str) -> bool:
    """Whether two strings are within edit distance 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32) for s in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    at = int(differ[0]) if len(differ) else len(x)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the lines of (line, twin, t, u) whose texts are neighbours."""
    for b in batches:
        keep = [within_one(t, u) for t, u in zip(b.column("t").to_pylist(), b.column("u").to_pylist())]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in ("line", "twin")], names=["line", "twin"])


def _hashes(line) -> tuple[F.Column, F.Column]:
    """Two hashes, which together tell lines apart."""
    return F.xxhash64(line).alias("line"), F.xxhash64(F.lit(1), line).alias("twin")


def _may_be_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys are not in wanted; none of wanted is lost.

    The hashes of wanted's keys are bits of BITS, 64 to a row of what is broadcast, so that has a
    bounded size. The more bits are set, the more other rows stay."""
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    bits = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return rows.join(F.broadcast(bits), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def _texts(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(line, twin, text) of the lines of some, (line, twin, first, ...), from where they first
    occurred. Of all lines only those that may be among them are shuffled, once a task."""
    spot = ["_row", "_no"]
    wanted = some.select("line", "twin", F.col("first.row").alias("_row"), F.col("first.no").alias("_no"))
    lines = lines_of(docs).select(F.col("row").alias("_row"), F.col("no").alias("_no"), F.col("line").alias("text"))
    held = _may_be_in(lines, wanted, spot).groupBy(*spot).agg(F.min("text").alias("text"))  # of equal rows one
    return materialize(held.join(wanted, spot).select("line", "twin", "text"), "texts")


def _bound_of(shorter, bounds: tuple[tuple[int, int], ...]) -> F.Column:
    bound = F.lit(-1)
    for least, k in bounds:
        bound = F.when(shorter >= least, k).otherwise(bound)
    return bound


def within(a: str, b: str, k: int) -> bool:
    """Whether two strings are within edit distance k: only the 2 k + 1 diagonals that k edits
    can reach are followed."""
    if abs(len(a) - len(b)) > k:
        return False
    row = {d: d for d in range(k + 1)}  # by diagonal: edits up to here; column = line + diagonal
    for i, x in enumerate(a):
        new = {}
        for d in range(-k, k + 1):
            j = i + 1 + d
            if 0 <= j <= len(b):
                best = min(row.get(d + 1, k) + 1, new.get(d - 1, k) + 1, row.get(d, k + 1) + (j == 0 or x != b[j - 1]))
                if best <= k:
                    new[d] = best
        if not new:
            return False
        row = new
    return row.get(len(b) - len(a), k + 1) <= k


def _late_lines(g: pd.DataFrame, bounds: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The rows of a block, in order of first occurrence, that are near an earlier one of it.

    Pairs of which neither has the segment as its own, or of one part in a block of two, belong
    elsewhere. Lengths and counts of characters rule out most others at once."""
    texts, own, part = g["text"].tolist(), g["own"].to_numpy(), g["part"].to_numpy()
    length, two = g["text"].str.len().to_numpy(), g["lo"].iloc[0] != g["hi"].iloc[0]
    kinds = np.zeros((len(g), 64), np.int32)
    for row, t in zip(kinds, texts):
        row += np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) % 64, minlength=64).astype(np.int32)
    gone = np.zeros(len(g), bool)
    for i in range(1, len(g)):
        shorter, bound = np.minimum(length[:i], length[i]), np.full(i, -1)
        for least, k in bounds:
            bound[shorter >= least] = k
        may = (np.abs(length[:i] - length[i]) <= bound) & (own[:i] | own[i])
        if two:
            may &= part[:i] != part[i]
        at = np.flatnonzero(may)
        at = at[np.abs(kinds[at] - kinds[i]).sum(1) <= 2 * bound[at]]
        gone[i] = any(within(texts[i], texts[j], int(bound[j])) for j in at.tolist())
    return np.flatnonzero(gone)


def _hot_lines(some: DataFrame, texts: DataFrame, bounds: tuple[tuple[int, int], ...]) -> DataFrame:
    """(line, twin) of the lines that are near an earlier one that shares a hot segment."""
    parts = F.col("parts")
    rows = some.groupBy("key", "line").agg(F.max("own").alias("own"), F.first("parts").alias("parts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("line"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts")
    rows = rows.join(texts, "line")
    # a block's order of first occurrence, as a number that pandas can sort
    order = F.row_number().over(Window.partitionBy("key", "lo", "hi").orderBy("first", "twin"))
    rows = rows.withColumn("nth", order).select("key", "lo", "hi", "part", "own", "nth", "line", "twin", "text")

    def late(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("nth", ignore_index=True)
        return g.loc[_late_lines(g, bounds), ["line", "twin"]]

    return rows.groupBy("key", "lo", "hi").applyInPandas(late, "line long, twin long")


def far_lines(docs: DataFrame, bounds: tuple[tuple[int, int], ...]) -> tuple[DataFrame, DataFrame]:
    """As repeated_lines, with a bound for each length."""
    long_ones = lines_of(docs).where(F.length("line") >= bounds[0][0])
    own, probe = _segments(F.col("line"), F.length("line"), bounds)
    each = long_ones.select(*_hashes("line"), F.struct("doc_id", "row", "no").alias("at"), F.length("line").alias("chars"), own.alias("own"), probe.alias("probe"))
    known = each.groupBy("line", "twin").agg(F.min(F.struct("at", "chars", "own", "probe")).alias("x"))
    known = materialize(known.select("line", "twin", F.col("x.at").alias("first"), F.col("x.chars").alias("chars"), F.col("x.own").alias("own"), F.col("x.probe").alias("probe")), "lines")
    keys = known.select("line", "chars", F.explode("own").alias("key"), F.lit(True).alias("own"))
    keys = keys.union(known.select("line", "chars", F.explode("probe").alias("key"), F.lit(False).alias("own")))
    # a key matters if it holds two lines, one of them with its own segment
    shared = keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("long")
    shared = shared.where("a <> b and own").select("key", "n", parts.alias("parts"))
    some = materialize(keys.drop("chars").join(shared, "key"), "candidates")
    few, many = some.where(F.col("n") <= FEW), some.where(F.col("n") > FEW).drop("n")
    left = few.where("own").select("key", F.col("line").alias("a"))
    right = few.select("key", F.col("line").alias("b"))
    pairs = left.join(right, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(many.select("line")).distinct()
    wanted = materialize(known.select("line", "twin", "first").join(wanted, "line"), "wanted")
    texts = _texts(docs, wanted).join(wanted, ["line", "twin"])
    side = lambda c: texts.select(F.col("line").alias(c), F.struct("line", "twin").alias(f"{c}_line"), F.col("text").alias(f"{c}_text"), F.col("first").alias(f"{c}_first"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    bound = _bound_of(F.least(F.length("a_text"), F.length("b_text")), bounds)
    both = both.where(F.levenshtein("a_text", "b_text", max(k for _, k in bounds)).between(0, bound))
    near = both.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b_line")).otherwise(F.col("a_line")).alias("x")).select("x.line", "x.twin")
    near = materialize(near.unionByName(_hot_lines(many, texts, bounds)).distinct(), "near")
    for done in (some, pairs, wanted):
        remove_table(done)
    return known.select("line", "twin", "first"), near


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """((line, twin, first) of every distinct line of at least min_chars, (line, twin): lines that
    go for an earlier neighbour). line and twin are a line's hashes, first where it first occurred."""
    long_ones = lines_of(docs).where(F.length("line") >= min_chars)
    n = F.length("line")
    at = F.struct("doc_id", "row", "no")
    each = long_ones.select(*_hashes("line"), at.alias("at"), F.array(*_halves(F.col("line"), n)).alias("halves"))
    # the halves are a function of the line, so the minimum of this struct has its first place
    known = each.groupBy("line", "twin").agg(F.min(F.struct("at", "halves")).alias("x"))
    known = materialize(known.select("line", "twin", F.col("x.at").alias("first"), F.col("x.halves").alias("halves")), "lines")
    half = known.select("line", F.posexplode("halves").alias("kind", "key"))
    half = half.select("line", "key", (F.col("kind") < 2).alias("own"), (F.col("kind") % 2).alias("side"))
    # a key matters if it holds two lines, one of them at its own length; equal left halves leave
    # a difference on the right
    shared = half.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.max("own").alias("own"))
    shared = shared.where("a <> b and own").select("key")
    some = half.join(shared, "key").groupBy("line").agg(F.max(F.col("side") == 1).alias("left"), F.max(F.col("side") == 0).alias("right"))
    some = materialize(some.join(known.select("line", "twin", "first"), "line"), "candidates")
    texts = _texts(docs, some)
    emitted = texts.join(some.select("line", "twin", "left", "right"), ["line", "twin"]).select("line", "text", "left", "right")
    # one shuffle serves both the sums and the rows that they choose
    emitted = emitted.mapInArrow(variants, VARIANTS).repartition("key")
    common = emitted.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key")
    hits = materialize(emitted.join(common, "key").join(some.select("line", "first"), "line"), "hits")
    # the earliest line of a key: of those that are the variant itself, and of those that lost a
    # character; place keys have the latter only and there all are neighbours
    own = lambda cond: F.min(F.when(cond, F.struct("first", "line")))
    groups = hits.groupBy("key").agg(own(F.col("whole")).alias("self"), own(~F.col("whole")).alias("cut"))
    near = F.when(F.col("whole"), F.col("cut")).otherwise(F.coalesce("self", "cut"))
    links = hits.join(groups, "key").select("line", "first", near.alias("near")).where("near.first < first")
    links = links.select("line", F.col("near.line").alias("near")).distinct()
    pairs = links.join(texts.withColumnRenamed("text", "t"), "line").join(texts.select(F.col("line").alias("near"), F.col("text").alias("u")), "near")
    near_lines = materialize(pairs.select("line", "twin", "t", "u").mapInArrow(verified, "line long, twin long").distinct(), "near")
    for done in (some, texts, hits):
        remove_table(done)
    return known.select("line", "twin", "first"), near_lines


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", bounds: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(row, doc_id, n_lines, n_dropped, text) with the lines that stay, for each row of docs; with
    ``bounds``, their first length is the least number of characters."""
    rows = docs.select(F.col("_row").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    min_chars = bounds[0][0] if bounds else min_chars
    first, near = far_lines(rows, bounds) if bounds else repeated_lines(rows, min_chars)
    # what goes: later occurrences, and every occurrence of a line with an earlier neighbour
    occurrences = lines_of(rows).where(F.length("line") >= min_chars).select("row", "no", "doc_id", *_hashes("line"))
    marks = first.join(near.withColumn("near", F.lit(True)), ["line", "twin"], "left")
    gone = occurrences.join(marks, ["line", "twin"]).where(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "row", "no") != F.col("first")))
    gone = materialize(gone.groupBy("row").agg(F.collect_set("no").alias("gone")), "gone")
    out = rows.join(gone.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left").drop("_r")
    lines = F.split(text_of(F.col("text")), "\n")
    out = out.withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)"))).withColumn("lines", lines)
    flags = F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True)))
    kept = F.filter("lines", lambda _, i: ~F.map_contains_key("flags", i))
    out = out.withColumn("flags", flags).withColumn("kept", F.when(F.size("gone") == 0, F.col("lines")).otherwise(kept))
    return out.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with two hashes of each row: ids may be null or repeat."""
    return docs.withColumn("_row", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op6_line_dedup_bounds(spark, sf_dir: str) -> DataFrame:
    """op6_line_dedup with the bounds of the pipeline."""
    docs = with_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = dedup(docs, bounds=BOUNDS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def dedup_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and with them documents of which nothing but blank
    lines is left; documents that lose no line stay as they are. n_chars follows the text."""
    marked = with_rows(docs)
    found = dedup(marked, bounds=BOUNDS).where("n_dropped > 0").select(F.col("row").alias("_r"), F.col("text").alias("_kept")).dropDuplicates(["_r"])
    out = marked.join(found, F.col("_row") == F.col("_r"), "left")
    changed = F.col("_kept").isNotNull()
    out = out.where(~changed | F.regexp_like("_kept", F.lit(r"\S")))
    values = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("_kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumns(values).select(*docs.columns)
