"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel. A text becomes a stream of 32 symbols: letters without case and accent, five classes
for letters of other scripts, and one symbol for each run of anything else. For windows x, y of
that stream k(x, y) sums, over all subsequences u of four symbols that span at most seven,
phi_u(x) * phi_u(y), where phi_u adds DECAY ** span for each occurrence. A letter put into an
insult, or a blank or dot between its letters, lengthens spans and lowers the value a little
instead of making it zero.

Landmarks. Substrings of the training texts with the largest contrast of document frequency
between the labels. With Z = K_mm^(-1/2) k(landmarks, x) the SVM is linear in Z.

Training. Windows of sentences inherit the label of their document; since only a few windows of
a toxic document are toxic, the SVM is refitted a few times on those windows that score highest
(multiple instances), and on windows with inserted letters and gaps made from them. At most
``max_docs`` labelled documents of each label are used, those with the smallest hashes of
doc_id, of at most ``max_chars`` characters each; these bounds make collecting them safe. Scores are calibrated to the share of label 1 among
all labels, so that 0.5 is where either label is as likely.

Scoring. sum_j b_j k(x, landmark_j) is linear in phi, so all landmarks fold into one weight for
each u: scoring a window of any text costs twenty table lookups for each symbol, whatever the
number of landmarks, and gives exactly the value of the kernel expansion. A document gets its
highest window through a logistic calibration.

Defined results: null and empty texts get the score of a text without windows; texts of any
length are scored whole; equal texts get equal scores; with labels of one class only (or none)
every document gets that class's share of the labels (0 without labels); an empty table gives
an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

SYMBOLS, ORDER, SPAN, DECAY, WINDOW = 32, 4, 7, 0.6, 8
GAPS = [(0, *g) for g in combinations(range(1, SPAN), ORDER - 1)]
SEP = "\0" * (SPAN + WINDOW)
#: Characters that are scored together, and texts that are Python strings at one time.
CHUNK, SLICE = 1 << 20, 500
#: Landmarks that may share four letters, and the least z-score of a landmark's contrast.
PER_CORE, LEAST_CONTRAST = 3, 1.0


def _symbols() -> np.ndarray:
    lut = np.zeros(65536, np.uint8)
    for cp in range(65536):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if not c.isalpha():
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower()
        lut[cp] = ord(base) - 96 if "a" <= base <= "z" else 27 + cp % 5
    return lut


LUT = _symbols()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in one array, and where the SEP before each text begins."""
    raw = "".join([SEP + t.replace("\0", " ").lower() for t in texts]) + SEP
    cps = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    sym = LUT[np.minimum(cps, 65535)]
    cut = cps == 0
    before = np.empty_like(sym)
    before[0], before[1:] = 1, sym[:-1]
    before2 = np.ones_like(sym)
    before2[2:] = sym[:-2]
    keep = cut | ((sym != 0) | (before != 0)) & ~((sym == before) & (sym == before2))
    sym, cut = sym[keep], cut[keep]
    if len(sym) > 4:  # i d i o t: no gap between letters that stand alone
        blank = sym == 0
        lone = np.zeros_like(blank)
        lone[2:-2] = blank[2:-2] & blank[:-4] & blank[4:] & ~blank[1:-3] & ~blank[3:-1]
        sym, cut = sym[~lone], cut[~lone]
    return sym, np.flatnonzero(cut)[:: len(SEP)][: len(texts)]


def position_scores(sym: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each position the weighted subsequences that begin there; weights has one entry for
    each subsequence, without the decay of its span."""
    n = len(sym) - SPAN + 1
    out = np.zeros(max(n, 0), np.float32)
    step = 1 << 15
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = sym[lo : hi + SPAN - 1].astype(np.int32)
        a, b, c = part << 15, part << 10, part << 5
        m, acc = hi - lo, np.zeros(hi - lo, np.float32)
        head = a[:m]
        for k in range(ORDER - 1, SPAN):
            ends, of_span = head + part[k : k + m], np.zeros(m, np.float32)
            for _, i, j, last in GAPS:
                if last == k:
                    of_span += weights.take(ends + b[i : i + m] + c[j : j + m])
            acc += of_span * np.float32(DECAY ** (k + 1))
        out[lo:hi] = acc
    return out


def window_scores(sym: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = position_scores(sym, weights)
    n = len(s) - WINDOW + 1
    out = np.zeros(max(n, 0), np.float32)
    for k in range(WINDOW):
        out += s[k : k + n]
    return out


def best_windows(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The highest window of each text, in chunks of bounded size."""
    out, lo = np.zeros(len(texts)), 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        sym, starts = encode(texts[lo:hi])
        out[lo:hi] = np.maximum.reduceat(np.append(window_scores(sym, weights), np.float32(0)), starts)
        lo = hi
    return out


def subsequences(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (subsequence, weight) pairs of a short stream."""
    idx, val = [], []
    s = sym.astype(np.int64)
    for _, i, j, k in GAPS:
        if (m := len(s) - k) > 0:
            idx.append((s[:m] << 15) + (s[i : i + m] << 10) + (s[j : j + m] << 5) + s[k : k + m])
            val.append(np.full(m, DECAY ** (k + 1)))
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0)
    idx, val = np.concatenate(idx), np.concatenate(val)
    used = idx != 0
    return idx[used], val[used]


@dataclass
class Model:
    """weights: one for each subsequence; slope and bias: the calibration."""

    weights: np.ndarray
    slope: float
    bias: float
    landmarks: list[str]

    def score(self, texts: list[str]) -> np.ndarray:
        raw = best_windows(texts, self.weights)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.bias, -40, 40)))


def _spell(code: int, n: int) -> str:
    return "".join("_abcdefghijklmnopqrstuvwxyz01234"[code >> 5 * (n - 1 - i) & 31] for i in range(n))


def _landmarks(docs: list[np.ndarray], y: np.ndarray, count: int) -> list[tuple[int, int]]:
    """(code, length) of the substrings whose share of documents differs most by label."""
    found = []
    for n in (4, 5, 6):
        codes, of = [], []
        for i, s in enumerate(docs):
            if len(s) >= n:
                s = s.astype(np.int32)  # six symbols have 30 bits
                code = sum(s[k : len(s) - n + 1 + k] << 5 * (n - 1 - k) for k in range(n))
                codes.append(np.unique(code))
                of.append(np.full(len(codes[-1]), y[i], np.int8))
        if not codes:
            continue
        codes, of = np.concatenate(codes), np.concatenate(of)
        # sorted by code: the documents of a code are a stretch
        order = np.argsort(codes, kind="stable")
        codes, of = codes[order], of[order]
        del order
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        keys, total = codes[start], np.diff(np.append(start, len(codes)))
        pos = np.add.reduceat(of == 1, start, dtype=np.int32).astype(float)
        neg = total - pos
        n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
        p = (pos + neg + 0.5) / (n1 + n0 + 1)
        z = (pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        order = np.argsort(-z, kind="stable")
        found += [(z[k], int(keys[k]), n) for k in order[: 40 * count]]
        found += [(-z[k] / 2, int(keys[k]), n) for k in order[::-1][: count // 8]]
    found.sort(key=lambda x: (-x[0], x[1], x[2]))
    # substrings of one frequent insult would take all places: each four letters count a few times
    out, seen = [], Counter()
    for z, code, n in found:
        fours = {code >> 5 * k & 0xFFFFF for k in range(n - 3)}
        if z >= LEAST_CONTRAST and max(seen[f] for f in fours) < PER_CORE:
            seen.update(fours)
            out.append((code, n))
            if len(out) == count:
                break
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and equal weight of both labels, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    w, reg = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x1 @ w) < 1
        xs, cs = x1[on], c[on]
        new = np.linalg.solve(reg + 2 * (xs * cs[:, None]).T @ xs, 2 * xs.T @ (cs * y[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _widen(window: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The window with one symbol put in between, or with gaps between all of its letters."""
    if rng.random() < 0.5:
        at = int(rng.integers(1, len(window)))
        return np.insert(window, at, rng.integers(0, 27))
    letters = window[window > 0]
    out = np.zeros(2 * len(letters) + 1, np.uint8)
    out[1::2] = letters
    return out[: len(window) + 6]


def train(texts: list[str], toxic: list[int], share: float | None = None, landmarks: int = 160, rounds: int = 3, seed: int = 7) -> Model:
    """Fit on documents with labels 0 and 1. share: that of label 1 among all labels, by which
    scores are calibrated (else that among the given ones)."""
    y = np.array(toxic, int)
    if len(y) == 0 or y.min() == y.max():
        logit = 20.0 if len(y) and y[0] == 1 else -20.0
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), 0.0, logit, [])
    rng = np.random.default_rng(seed)
    docs = [encode([t])[0] for t in texts]
    marks = _landmarks(docs, y, landmarks)
    parts = []
    for code, n in marks:
        s = np.array([code >> 5 * (n - 1 - i) & 31 for i in range(n)], np.int64)
        idx, val = subsequences(s)
        parts.append((idx, val / max(np.linalg.norm(val), 1e-12)))
    keys = np.unique(np.concatenate([p[0] for p in parts]))
    row = np.full(SYMBOLS**ORDER, len(keys), np.int32)
    row[keys] = np.arange(len(keys))
    phi = np.zeros((len(marks), len(keys) + 1))
    for j, (idx, val) in enumerate(parts):
        np.add.at(phi[j], row[idx], val)
    gram = phi @ phi.T
    value, vector = np.linalg.eigh(gram)
    good = value > value.max() * 1e-6
    root = vector[:, good] / np.sqrt(value[good])  # k @ root are the Nystroem features
    fold = root.T @ phi

    def features(windows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(windows), fold.shape[0]))
        for lo in range(0, len(windows), 512):
            some = windows[lo : lo + 512]
            dense = np.zeros((len(some), len(keys) + 1))
            for i, s in enumerate(some):
                idx, val = subsequences(s)
                dense[i] += np.bincount(row[idx], weights=val, minlength=len(keys) + 1)
            dense[:, -1] = 0
            out[lo : lo + 512] = dense @ fold.T
        return out

    def folded(v: np.ndarray) -> np.ndarray:
        w = np.zeros(SYMBOLS**ORDER, np.float32)
        w[keys] = (v @ fold)[:-1]
        return w

    def top(s: np.ndarray, weights: np.ndarray, count: int) -> list[np.ndarray]:
        score = window_scores(s, weights)
        out = []
        for _ in range(count):
            if not len(score):
                break
            at = int(score.argmax())
            out.append(s[at : at + WINDOW + SPAN - 1])
            score[max(0, at - WINDOW) : at + WINDOW] = -np.inf
            if not np.isfinite(score).any():
                break
        return out

    has = np.zeros((2, len(marks)))
    for i, s in enumerate(docs):
        text = "".join("_abcdefghijklmnopqrstuvwxyz01234"[k] for k in s)
        for j, (code, n) in enumerate(marks):
            has[y[i], j] += _spell(code, n) in text
    rate = (has + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    w = np.zeros(SYMBOLS**ORDER, np.float32)
    w[keys] = (np.log(rate[1] / rate[0]) @ phi)[:-1]
    for _ in range(rounds):
        windows, sign = [], []
        for i, s in enumerate(docs):
            if y[i]:
                some = top(s, w, 2)[: 1 + (i % 2)]
                some += [_widen(x, rng) for x in some[:1]]
            else:
                some = top(s, w, 3)
                if len(s) > 2 * SPAN + WINDOW:
                    at = int(rng.integers(0, len(s) - SPAN - WINDOW))
                    some.append(s[at : at + WINDOW + SPAN - 1])
            windows += some
            sign += [1 if y[i] else -1] * len(some)
        v, bias = _svm(features(windows), np.array(sign, float), cost=1000.0)
        w = folded(v)
    raw = best_windows(list(texts), w)
    slope, bias = _platt(raw, y, float(y.mean()) if share is None else share)
    return Model(w, slope, bias, [_spell(c, n) for c, n in marks])


def _platt(raw: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression of the label on one score, weighted to the share of label 1 among all."""
    mean, dev = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - mean) / dev, np.ones(len(raw))], 1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.where(y == 1, share / n1, (1 - share) / n0)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - goal)) + 1e-4 * w
        hess = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0], 0.0) / dev
    return float(slope), float(w[1] - slope * mean)


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_chars: int = 100_000, held_out=None) -> tuple[DataFrame, float]:
    """((id, text, toxic) of at most max_docs labelled documents of each label, the share of
    label 1 among all labels).

    The bound is taken on distinct ids alone, so that only the chosen texts move; of the rows of
    one id the least text counts, and texts beyond max_chars are not fitted on. Rows without an
    id or with a label other than 0 and 1 take no part.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    rows = rows.where(~held_out(F.col("_id"))) if held_out else rows
    some = None
    for y in (0, 1):
        part = rows.where(F.col("_y") == y).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        some = part if some is None else some.unionByName(part)
    share = rows.agg(F.avg("_y").alias("share")).first()["share"] or 0.0
    found = docs.select(F.col("doc_id").alias("_id"), text_of(F.col("text")).alias("text")).where(F.length("text") <= max_chars)
    # at most 2 * max_docs short rows
    return found.join(F.broadcast(some), "_id").groupBy("_id", F.col("_y").alias("toxic")).agg(F.min("text").alias("text")), share


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, held_out=None) -> Model:
    chosen, share = training_rows(docs, labels, max_docs, held_out=held_out)
    rows = chosen.collect()  # 2 * max_docs texts of at most max_chars
    rows.sort(key=lambda r: (r["_id"], r["toxic"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def scorer(spark, model: Model):
    """A column function: text to score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for texts in batches:
            parts = [own.score(texts.slice(lo, SLICE).to_pylist()) for lo in range(0, len(texts), SLICE)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return toxicity


def in_held_out_fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; false for ids that are null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=in_held_out_fold)
    score = scorer(spark, model)
    out = docs.select("doc_id", in_held_out_fold(F.col("doc_id")).alias("held_out"), score(text_of(F.col("text"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    score = scorer(spark, fit(docs, table(spark, sf_dir, "labels"), held_out=in_held_out_fold))
    return docs.where(score(text_of(F.col("text"))) < 0.5)
