"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (lower case, letters and digits); a shorter text is one
shingle. A shingle's weight is its count in the text times 1 + log10(N / df), with df the exact
number of documents of the whole corpus that hold it, but at least FLOOR * N: what fewer than one
in a thousand documents share is as telling as what only one has, and boilerplate of many
documents weighs up to four times less.

Document frequencies. Each block of rows emits the shingles that reach half of the floor's share
of its own documents. A shingle above the floor has at least half of its documents in blocks that
emit it, so only shingles whose emitted sum is half the floor are counted exactly, in a second
pass; these are at most 2 / FLOOR times the mean number of shingles of a document, whatever the
size of the corpus, which is what may be broadcast. At a floor of one document all shingles are
emitted and the sums are exact at once. Shingles are told apart by 32 bits of their
hashes: by chance that adds less than 1e-3 of the floor to a frequency, at every size, and less
than 3e-4 to a similarity, even of texts of a million words.

Sketches. For each of BANDS * ROWS functions, improved consistent weighted sampling draws for a
shingle of weight w: r, c ~ Gamma(2, 1), b ~ U(0, 1), t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; the shingle of the least a, with its t, is the sample. Two texts
agree in a sample with probability equal to their weighted Jaccard similarity. (r, b) and c come
from two pools of 2**13 draws, at indexes hashed per function.

Links. Texts with equal words are one node from the start. In each bucket of a band every node
is compared with the bucket's least node (no pairs within a group), and components follow. Nodes
that still share a bucket with another component are then compared across components, unless
their total weights, or far too few equal samples (``least_equal``; 0 compares them all), rule
out the similarity. All comparisons are exact weighted Jaccard similarities of whole texts, and
count from ``threshold`` on. Two texts of similarity 0.8 share no bucket with a chance of 2e-4.

Defined results: null texts and those without a word link to nothing and form classes of their
own row each (rows of one id share it); null ids stay null and their class is named by the least
id that is not null, else null; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, release, remove_table, table, text_of

SHINGLE, BANDS, ROWS, THRESHOLD, EXACT = 5, 16, 4, 0.8, 1e-6
FLOOR, POOL_BITS = 1e-3, 13
#: Shingles that a block of rows counts together.
BLOCK_SHINGLES = 1 << 21
#: Of 64 samples at a similarity of 0.8, a smaller share agrees with a chance below 1e-5.
LEAST_EQUAL = 0.55
WORDS = re.compile(r"\w+")
CACHED_WORDS = 150_000
COLUMNS = 4096
#: Texts of a batch that are Python strings at one time.
SLICE = 250
#: Buckets up to FEW nodes are compared by a join, larger ones in blocks of twice BLOCK nodes.
FEW, BLOCK = 16, 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upper(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(32)).astype(np.uint32)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACE = _odd(SHINGLE, 5)


class Shingler:
    """Texts to (two hashes of all words, sorted shingle hashes, their counts)."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
        words = WORDS.findall(text.lower())
        cache = self.cache
        try:
            codes = list(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > CACHED_WORDS:
                cache.clear()
            digest = xxhash.xxh3_64_intdigest
            cache.update((w, digest(w)) for w in set(words).difference(cache))
            codes = list(map(cache.__getitem__, words))
        w = np.array(codes, np.uint64)
        n = len(w) - SHINGLE + 1
        if len(w) == 0:
            return (0, 0), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        node = tuple(np.frombuffer(xxhash.xxh3_128_digest(w.tobytes()), np.int64).tolist())
        if n < 1:
            one = (w * PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
            return node, _upper(np.array([one], np.uint64)), np.ones(1, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h += w[k : k + n] * PLACE[k]
        h, count = np.unique(_upper(h), return_counts=True)
        return node, h, count


def shingled(rows: DataFrame) -> DataFrame:
    """(doc_id, th, node, check, size, h, c) of each row of (doc_id, th, text): the hashes of its
    words, how many distinct shingles it has, their sorted hashes and their counts, as bytes; c is
    empty if all counts are 1. Rows without a word have no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                found = [shingles(t) for t in b.column("text").slice(lo, SLICE).to_pylist()]
                size = pa.array([len(h) for _, h, _ in found], pa.int64())
                node, check = (pa.array([x[k] if len(h) else None for x, h, _ in found], pa.int64()) for k in (0, 1))
                h = pa.array([h.tobytes() for _, h, _ in found], pa.binary())
                c = pa.array([c.astype("<u4").tobytes() if (c > 1).any() else b"" for _, _, c in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, SLICE), b.column("th").slice(lo, SLICE), node, check, size, h, c], names=["doc_id", "th", "node", "check", "size", "h", "c"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, node long, check long, size long, h binary, c binary")


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), np.uint32) for x in column)


def document_frequencies(sh: DataFrame, n: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, document frequencies) of the shingles in more than floor documents, of n."""
    least = floor + 1  # of whole numbers above a whole floor; floor itself is cut to one

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, docs, size = [], 0, 0

        def block():
            h, count = np.unique(np.concatenate(some), return_counts=True)
            often = count >= least / 2 * docs / n
            return pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(count[often])], names=["h", "n"])

        for b in batches:
            for h in _hashes(b.column("h")):
                some.append(h)
                docs, size = docs + 1, size + len(h)
                if size >= BLOCK_SHINGLES:
                    yield block()
                    some, docs, size = [], 0, 0
        if some:
            yield block()

    rows = sh.where("size > 0").select("h")
    # blocks that a task fills: one of few rows would have to emit all their shingles
    blocks = (sh.agg(F.sum("size")).first()[0] or 0) // BLOCK_SHINGLES + 1
    held = rows.coalesce(blocks).mapInArrow(emitted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    if least <= 2:  # blocks emit all of their shingles then, so the sums are exact, and most shingles need not come here
        exact = held.where(F.col("n") >= least).toPandas().sort_values("h")
        return exact["h"].to_numpy(np.int64).astype(np.uint32), exact["n"].to_numpy(np.int64)
    held = held.where(F.col("n") >= least / 2)
    keys = np.sort(held.select("h").toPandas()["h"].to_numpy(np.int64)).astype(np.uint32)  # 2 * shingles / least at most
    sent = sh.sparkSession.sparkContext.broadcast(keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(len(sent.value), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                h = np.concatenate(list(_hashes(b.column("h").slice(lo, SLICE))))
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                total += np.bincount(at[own[at] == h], minlength=len(own))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    if not len(keys):
        return keys, np.zeros(0, np.int64)
    exact = rows.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    at = exact["at"].to_numpy(np.int64)
    order = np.argsort(at)
    return keys[at[order]], exact["n"].to_numpy(np.int64)[order]


class Idf:
    """1 + log10(N / df) of shingles; ``most`` is that of all that are at the floor or below."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, floor: float):
        self.keys, self.most = keys, np.float32(1 + np.log10(max(n, 1) / max(floor, 1)))
        self.values = (1 + np.log10(max(n, 1) / np.maximum(df, 1))).astype(np.float32)

    def weights(self, h: np.ndarray, c: bytes) -> np.ndarray:
        w = np.full(len(h), self.most, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            common = np.flatnonzero(self.keys[at] == h)
            w[common] = self.values[at[common]]
        return w * np.frombuffer(c, "<u4").astype(np.float32) if len(c) else w


def idf_of(sh: DataFrame, share: float = FLOOR) -> Idf:
    n = sh.where("node is not null").count()
    floor = max(1, int(share * n))
    return Idf(*document_frequencies(sh, max(n, 1), floor), n, floor)


class Sampler:
    """Consistent weighted samples of weighted shingles, and band keys from them."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 23):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.r, self.lnc = rng.gamma(2, 1, 1 << POOL_BITS), np.log(rng.gamma(2, 1, 1 << POOL_BITS)).astype(np.float32)
        self.b = rng.random(1 << POOL_BITS)
        self.odd = (_odd(bands * rows, seed + 1)[:, None] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.mixer = _odd(rows, seed + 2)
        self.tables: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, w: float) -> tuple[np.ndarray, np.ndarray]:
        """For a weight: what is added to ln c, and t, of each (r, b)."""
        if w not in self.tables:
            if len(self.tables) > 1024:
                self.tables.clear()
            t = np.floor(np.log(w) / self.r + self.b)
            self.tables[w] = ((-self.r * (t - self.b) - self.r).astype(np.float32), t.astype(np.int64))
        return self.tables[w]

    def samples(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One hash of (shingle, t) for each function. Ties of a go to the lesser hash."""
        k = self.bands * self.rows
        every, least, out = np.arange(k), np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        tie = np.zeros(k, np.uint64)
        values, kind = np.unique(w, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=len(values)))
        for value, lo, hi in zip(values.tolist(), [0, *ends.tolist()], ends.tolist()):
            low, t = self.table(value)
            for at in range(lo, hi, COLUMNS):
                part = h[order[at : min(hi, at + COLUMNS)]]
                mixed = part * self.odd
                first = mixed >> np.uint32(32 - POOL_BITS)
                a = low.take(first)
                a += self.lnc.take((mixed >> np.uint32(32 - 2 * POOL_BITS)) & np.uint32((1 << POOL_BITS) - 1))
                best = a.argmin(1)
                own, shingle = a[every, best], part[best].astype(np.uint64)
                better = (own < least) | (own == least) & (shingle < tie)
                sample = _mix(shingle + t[first[every, best]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                least, out, tie = np.where(better, own, least), np.where(better, sample, out), np.where(better, shingle, tie)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        s = samples.reshape(self.bands, self.rows)
        return _mix((s * self.mixer).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))


def sketches(sh: DataFrame, idf) -> DataFrame:
    """(doc_id, th, node, weight, keys, equal) of each row; ``equal`` is a byte of each sample.
    idf is a broadcast Idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, own = Sampler(), idf.value
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                weights, keys, equal = [], [], []
                part = b.slice(lo, SLICE)
                for h, c in zip(_hashes(part.column("h")), part.column("c").to_pylist()):
                    w = own.weights(h, c)
                    s = sampler.samples(h, w) if len(h) else np.zeros(0, np.uint64)
                    weights.append(float(w.sum(dtype=np.float64)))
                    keys.append((sampler.keys(s) if len(h) else s).view(np.int64))
                    equal.append((s & np.uint64(255)).astype(np.uint8).tobytes())
                ends = np.cumsum([0, *map(len, keys)])
                key = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                columns = [part.column("doc_id"), part.column("th"), part.column("node"), pa.array(weights, pa.float64()), key, pa.array(equal, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "weight", "keys", "equal"])

    kind = sh.schema["doc_id"].dataType.simpleString()
    return sh.select("doc_id", "th", "node", "h", "c").mapInArrow(run, f"doc_id {kind}, th long, node long, weight double, keys array<long>, equal binary")


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    low = np.minimum(w1[i], w2[j]).sum(dtype=np.float64)
    total = w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64) - low
    return float(low / total) if total > 0 else 0.0


def verified(pairs: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold; sets has (node, h, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = idf.value
        for b in batches:
            keep = []
            for ha, ca, hb, cb in zip(_hashes(b.column("ha")), b.column("ca"), _hashes(b.column("hb")), b.column("cb")):
                keep.append(similarity(ha, own.weights(ha, ca.as_py()), hb, own.weights(hb, cb.as_py())) >= threshold - EXACT)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"), F.col("c").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a long, b long")


def _open_pairs(g: pd.DataFrame, threshold: float, least_equal: float = LEAST_EQUAL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block that may be links across components, most equal samples first."""
    equal = np.stack([np.frombuffer(x, np.uint8) for x in g["equal"]])
    keys, own = np.stack(list(g["keys"])), g["key"].iloc[0]
    weight, comp, part = g["weight"].to_numpy(), g["comp"].to_numpy(), g["part"].to_numpy()
    diagonal = g["lo"].iloc[0] == g["hi"].iloc[0]
    least = round(least_equal * BANDS * ROWS)
    i_of, j_of, n_of = [], [], []
    for i in range(1, len(g)):
        some = (comp[:i] != comp[i]) & (weight[:i] >= (threshold - EXACT) * weight[i] - 1e-3) & (weight[i] >= (threshold - EXACT) * weight[:i] - 1e-3)
        if not diagonal:
            some &= part[:i] != part[i]
        j = np.flatnonzero(some)
        if len(j):
            n = (equal[j] == equal[i]).sum(1)
            shared = keys[j] == keys[i]
            first = keys[i][shared.argmax(1)] == own
            good = (n >= least) & first
            j_of.append(j[good])
            n_of.append(n[good])
            i_of.append(np.full(int(good.sum()), i))
    if not i_of:
        return np.zeros(0, int), np.zeros(0, int)
    i_of, j_of, n_of = map(np.concatenate, (i_of, j_of, n_of))
    order = np.argsort(-n_of, kind="stable")
    return i_of[order], j_of[order]


def block_links(many: DataFrame, sets: DataFrame, idf, threshold: float, least_equal: float) -> DataFrame:
    """Links (a, b) across components within the buckets of ``many``.

    A bucket's nodes are dealt by hash into parts of about BLOCK; a block holds two parts, or one
    with itself. First the sketches alone tell which nodes of a block have an open pair; only
    their sets go to the block, where pairs are compared until all of it is one component.
    """
    parts = F.ceil(F.col("size") / BLOCK)
    rows = many.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "size")

    def involved(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", ignore_index=True)
        return g.iloc[np.unique(np.concatenate(_open_pairs(g, threshold, least_equal)))]

    def compared(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", ignore_index=True)
        h = [np.frombuffer(x, np.uint32) for x in g["h"]]
        w = [idf.value.weights(x, c) for x, c in zip(h, g["c"])]
        at = {c: c for c in g["comp"]}

        def root(c):
            while at[c] != c:
                at[c] = c = at[at[c]]
            return c

        comp, node, out = g["comp"].to_numpy(), g["node"].to_numpy(), []
        for i, j in zip(*_open_pairs(g, threshold, least_equal)):
            a, b = root(comp[i]), root(comp[j])
            if a != b and similarity(h[i], w[i], h[j], w[j]) >= threshold - EXACT:
                at[a] = b
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    blocks = ("key", "lo", "hi")
    rows = rows.select("key", "node", "comp", "weight", "equal", "keys", "part", "lo", "hi")
    some = rows.groupBy(*blocks).applyInPandas(involved, rows.schema)
    return some.join(sets, "node").groupBy(*blocks).applyInPandas(compared, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp, ...) of every node in links (a, b): comp is the least node that it reaches.

    Each round takes the least label among neighbours, then the label of that label, and is
    written to the shared folder; stars settle in two rounds, chains in a logarithmic number.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    table = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        labels = table.select("node", "comp")
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "n").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), (F.least("new", F.coalesce("far", "new")) != F.col("comp")).alias("moved"))
        step = materialize(step, "labels")
        remove_table(table)
        table = step
        if step.where("moved").isEmpty():
            remove_table(both)
            return step


def _distinct_nodes(sh: DataFrame) -> DataFrame:
    """sh with nodes that two texts of different words share told apart. Of 64-bit hashes hardly
    any do (some hundred of 1e11 texts), so those are few enough to broadcast."""
    same = sh.groupBy("node").agg(F.min("check").alias("_lo"), F.max("check").alias("_hi")).where("_lo <> _hi")
    out = sh.join(F.broadcast(same.select(F.col("node").alias("_node"), "_lo")), F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("_node").isNull() | (F.col("check") == F.col("_lo")), F.col("node")).otherwise(F.xxhash64("node", "check"))
    return out.withColumn("node", own).drop("_node", "_lo")


def classes(docs: DataFrame, threshold: float = THRESHOLD, least_equal: float = LEAST_EQUAL, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, class_id, keep) of each row; th is a hash of its text, keep marks the rows
    of the least (doc_id, th) of each class."""
    text = text_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    stored = materialize(shingled(rows), "shingles")
    idf = docs.sparkSession.sparkContext.broadcast(idf_of(stored, floor))
    release(docs.sparkSession)
    sh = _distinct_nodes(stored)
    sk = materialize(sketches(sh, idf), "sketches")
    # equal rows of words are one node; copies meet map-side
    nodes = sk.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "th")).alias("least"), F.min(F.struct("weight", "keys", "equal")).alias("x"))
    nodes = materialize(nodes.select("node", "rows", "id", "least", "x.weight", "x.keys", "x.equal"), "nodes")
    member = nodes.select("node", F.explode("keys").alias("key"))
    full = member.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center <> last")
    member = materialize(member.join(full.select("key", "center"), "key"), "buckets")
    sets = materialize(sh.select("node", "h", "c").join(member.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
    remove_table(stored)
    stars = member.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = materialize(stars, "stars")
    links = materialize(verified(stars, sets, idf, threshold), "verified")
    comps = components(links)
    # nodes that share a bucket with another component
    at = member.select("key", "node").join(comps.select("node", "comp"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    rest = at.join(split, "key").join(nodes.select("node", "weight", "equal", "keys"), "node")
    rest = materialize(rest, "rest")
    few, many = rest.where(F.col("size") <= FEW), rest.where(F.col("size") > FEW)
    x = few.select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("weight").alias("va"), F.col("equal").alias("ea"))
    y = few.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("weight").alias("vb"), F.col("equal").alias("eb"))
    same = F.expr(f"size(filter(sequence(1, {BANDS * ROWS}), i -> substring(ea, i, 1) = substring(eb, i, 1))) >= {round(least_equal * BANDS * ROWS)}")
    heavy = lambda v, u: F.col(v) >= (threshold - EXACT) * F.col(u) - 1e-3
    near = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & heavy("va", "vb") & heavy("vb", "va")
    across = x.join(y, "key").where(near & same).select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(across, sets, idf, threshold).unionByName(block_links(many, sets, idf, threshold, least_equal))
    more = materialize(more, "more")
    if not more.isEmpty():
        remove_table(comps)
        comps = components(links.unionByName(more))
    for done in (member, stars, sets, rest, links, more):
        remove_table(done)
    # the least row of each component, then of each node: a hot one is summed map-side before, and
    # its name is broadcast
    owner = nodes.select("node", "rows", "id", "least").join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    owner = materialize(owner, "owner")
    names = owner.groupBy("comp").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("class_id"), F.min("least").alias("least"))
    node_names = join_counted(owner.select("node", "comp", "rows"), names, "comp").select("node", F.col("rows").alias("_n"), "class_id", "least")
    node_names = materialize(node_names, "names")
    named = join_counted(sk.where("node is not null").select("doc_id", "th", "node"), node_names, "node")
    out = named.select("doc_id", "th", "class_id", F.struct("doc_id", "th").eqNullSafe(F.col("least")).alias("keep"))
    alone = sk.where("node is null").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(True).alias("keep"))
    return out.unionByName(alone)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near-duplicates the row of the least id stays."""
    marked = docs.withColumn("_id", F.col("doc_id")).withColumn("_th", F.xxhash64(text_of(F.col("text"))))
    kept = classes(docs).where("keep").select(F.col("doc_id").alias("_keep_id"), F.col("th").alias("_keep_th"))
    out = marked.join(kept, F.col("_th").eqNullSafe(F.col("_keep_th")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi")
    return out.dropDuplicates(["_id", "_th"]).select(*docs.columns)
