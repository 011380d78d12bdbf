"""Text quality by a generalised additive model with pairwise interactions.

Each text becomes a row of numeric features; each feature is cut into quantile bins.  Boosting goes round
the features in turn, and every visit adds a small tree over the bins of that one feature to the feature's
lookup table.  The pairs whose joint bins explain most of what is left then get two-dimensional tables the
same way.  A score is the logistic of the intercept and the bin entries of all tables, added as vectors.

The model is fitted on a bounded sample of labelled training rows (about ``MAX_LABELLED``, chosen by a hash
of doc_id); a share of it, also by hash, tells when to stop.  Its size is fixed: features x bins and
pairs x bins^2.  Scoring reads every whole text.

Defined results: null or empty texts have all features 0 and get the score of that row; a null label is no
label, of repeated labels the highest counts; with labels of one class only (or none) every score is 1 and
nothing is rejected; repeated rows are scored alike; other columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, drawn, stored
from .toxic_passages import training_labels

#: Upper bound, in expectation, on the labelled documents a model is fitted on.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 300, 150, 0.1, 3
MIN_LEAF = 8
THRESHOLD = 0.7

FEATURES = ("log_chars", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_pair", "upper",
            "capital_words", "digit", "punctuation", "symbol", "space", "non_ascii", "lines", "mean_line", "repeated_line",
            "ends_sentence", "short_words", "symbol_words", "bar", "exclamation", "compressed", "top_char")

_CLASS = np.zeros(256, np.int64)                       # of a byte: 0 other, 1 upper, 2 digit, 3 punctuation, 4 symbol, 5 space, 6 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (6 if _b > 127 else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in ".,;:!?'\"()-" else
                  5 if _c.isspace() else 4 if 32 < _b < 127 and not _c.isalnum() else 0)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    n = len(raw)
    words = text.split()
    nw = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    ends = sum(x.rstrip()[-1:] in ".!?…" for x in lines)
    joined = "".join(w[-1] for w in words).encode("ascii", "replace")
    last = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=7) if joined else np.zeros(7)
    return [np.log1p(n), np.log1p(len(words)), sizes.mean(), np.log1p(sizes.max()), len(tally) / nw,
            max(tally.values(), default=0) / nw, same / nw, kinds[1] / n, sum(map(str.istitle, words)) / nw, kinds[2] / n,
            kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, np.log1p(len(lines)), np.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines), ends / len(lines), float((sizes <= 3).mean()), last[4] / nw,
            counts[124] / n, counts[33] / n, len(zlib.compress(raw, 1)) / n, counts.max() / n]


class Model:
    """Bin edges, an intercept, one table per feature and one per chosen pair."""

    def __init__(self, edges, pair_edges, intercept, tables, pairs, pair_tables, fitted=True):
        self.edges, self.pair_edges, self.intercept, self.fitted = edges, pair_edges, intercept, fitted
        self.tables, self.pairs, self.pair_tables = tables, pairs, pair_tables

    def bins(self, x: np.ndarray, edges) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.pair_edges)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[:, a], coarse[:, b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x)) if self.fitted else np.ones(len(x))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values of a small tree over ordered bins with gradient and hessian sums g, h and counts n."""
    cuts = [0, len(g)]
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            at = np.arange(lo + 1, hi)
            at = at[(cn[at] - cn[lo] >= MIN_LEAF) & (cn[hi] - cn[at] >= MIN_LEAF)]
            if len(at):
                gains = (_gain(cg[at] - cg[lo], ch[at] - ch[lo]) + _gain(cg[hi] - cg[at], ch[hi] - ch[at])
                         - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo]))
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    values = np.zeros(len(g))
    if len(cuts) > 2:
        for lo, hi in zip(cuts, cuts[1:]):
            values[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two axes: one cut of the first axis and one of the second on either side; values and gain."""
    best = (1e-9, None)
    for flip in (False, True):
        a, b, c = (v.T if flip else v for v in (g, h, n))
        ga, ha, na = (np.concatenate([np.zeros((1, v.shape[1])), v.cumsum(0)]) for v in (a, b, c))
        for i in range(1, a.shape[0]):
            gain, parts = -_gain(ga[-1].sum(), ha[-1].sum()), []
            for sg, sh, sn in ((ga[i], ha[i], na[i]), (ga[-1] - ga[i], ha[-1] - ha[i], na[-1] - na[i])):
                cg, ch, cn = sg.cumsum(), sh.cumsum(), sn.cumsum()
                cut = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
                cut = np.where((cn[:-1] >= MIN_LEAF) & (cn[-1] - cn[:-1] >= MIN_LEAF), cut, -1.0)
                k = int(cut.argmax()) if len(cut) else -1
                if k < 0 or cut[k] < 0:
                    gain = -1.0
                    break
                gain += cut[k]
                parts.append((k + 1, cg[k] / (ch[k] + 1), (cg[-1] - cg[k]) / (ch[-1] - ch[k] + 1)))
            if gain > best[0] and len(parts) == 2:
                best = (gain, (flip, i, parts))
    values = np.zeros(g.shape)
    if best[1]:
        flip, i, parts = best[1]
        view = values.T if flip else values
        for rows, (k, low, high) in zip((slice(0, i), slice(i, None)), parts):
            view[rows, :k], view[rows, k:] = low, high
    return values, best[0]


def boost(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Model:
    """Cyclic boosting on the rows outside ``check``; the rows of ``check`` choose the number of rounds."""
    edges, pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    rate = float(np.clip(y[~check].mean(), 1e-3, 1 - 1e-3))
    model = Model(edges, pair_edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    fine, coarse = model.bins(x, edges), model.bins(x, pair_edges)
    margin = np.full(len(x), model.intercept)

    def loss():
        p = np.clip(_sigmoid(margin[check]), 1e-9, 1 - 1e-9)
        return float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()) if check.any() else 0.0

    def sums(key, size):
        p = _sigmoid(margin)
        out = [np.bincount(key[~check], weights=w[~check], minlength=size) for w in (y - p, p * (1 - p))]
        return *out, np.bincount(key[~check], minlength=size).astype(float)

    def rounds(count, visit, state):
        best, kept, since = loss(), [t.copy() for t in state()], 0
        for _ in range(count):
            visit()
            now = loss()
            if now < best - 1e-5 or not check.any():
                best, kept, since = now, [t.copy() for t in state()], 0
            elif (since := since + 1) >= 20:
                break
        return kept

    def singles():
        for j, table in enumerate(model.tables):
            step = RATE * _tree(*sums(fine[:, j], len(table)), LEAVES)
            table += step
            margin[:] += step[fine[:, j]]

    model.tables = rounds(ROUNDS, singles, lambda: model.tables)
    margin[:] = model.margin(x)

    def grid(a, b):
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return [v.reshape(shape) for v in sums(coarse[:, a] * shape[1] + coarse[:, b], shape[0] * shape[1])]

    count = x.shape[1]
    ranked = sorted(((_pair_tree(*grid(a, b))[1], a, b) for a in range(count) for b in range(a + 1, count)
                     if len(pair_edges[a]) and len(pair_edges[b])), reverse=True)[:PAIRS]
    model.pairs = [(a, b) for gain, a, b in ranked if gain > 1e-6]
    model.pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in model.pairs]

    def doubles():
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = RATE * _pair_tree(*grid(a, b))[0]
            table += step
            margin[:] += step[coarse[:, a], coarse[:, b]]

    if model.pairs:
        model.pair_tables = rounds(PAIR_ROUNDS, doubles, lambda: model.pair_tables)
    return model


def _matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def feature_column():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()


def score_column(model: Model):
    """Column function text -> score."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(texts.to_pylist())), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, train, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``labels.quality`` of the rows where the condition ``train`` (on doc_id) holds."""
    known = stored(training_labels(labels, "quality", train), "quality-labels")
    share = min(1.0, max_labelled / max(1, known.count()))
    sample = known.filter(drawn(share, "fit"))                                     # bounded
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(sample), "doc_id")
            .select("doc_id", "_label", feature_column()("text").alias("x")).collect())
    rows.sort(key=lambda r: (r.doc_id, r.x))
    y = np.array([r._label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model([], [], 0.0, [], [], [], fitted=False)
    check = np.array([zlib.crc32(b"stop%d" % r.doc_id) % 5 == 0 for r in rows])
    return boost(np.array([r.x for r in rows]), y, check)


def train_rows():
    return doc_remainder(F.col("doc_id"), 4) != 2


def op5_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_rows())
    rows = docs.select("doc_id", (doc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score_column(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` of good quality, with all their columns (the pipeline stage)."""
    model = fit(docs, labels, train_rows())
    return docs.filter(score_column(model)(F.col("text")) >= THRESHOLD)
