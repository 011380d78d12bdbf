"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors.

Fit.  The number of documents with each token gives an informative Dirichlet prior; the numbers of labelled toxic and
clean training documents with it give each token a shrunk log-odds ratio and its z-score.  Tokens beyond ``Z_CUT`` score
their log-odds (a token without a sure score falls back on its longest beginning that has one, unless ``SEEN`` clean documents and no
toxic one hold it), all others nothing; every token pays ``DRIFT``, so that clean text drifts down.  The scale lambda of the extreme-value law of such
scores solves sum p(w) exp(lambda s(w)) = 1 under the clean token frequencies.

Score.  One linear scan finds every maximal segment.  A segment of score S among n tokens is expected
n exp(-lambda S) times by chance (the law's upper bound); segments expected at most ``MAX_E`` times are the
passages.  A document's evidence is the sum statistic of its segments' normalised scores lambda S - ln n,
and a logistic curve fitted on training documents turns evidence into a score.

Only labels of training rows are read, at most about ``MAX_LABELLED`` of them, chosen by a hash of doc_id;
the model holds tokens of those documents only, which bounds what is broadcast.  The prior counts all
documents.

Defined results: null or empty texts have no passages and no tokens; a null label is no label, of repeated
labels the highest counts; without labels of both classes every score is 0; repeated rows are scored alike;
other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, drawn, stored

#: Upper bound, in expectation, on the labelled documents a model is fitted on, and on those its curve is fitted on.
MAX_LABELLED = 200_000
MAX_CALIBRATION = 20_000
#: Weight of the prior against the labelled tokens.
PRIOR = 0.1
Z_CUT = 4.0
DRIFT = 0.5
MAX_E = 0.05
#: Lengths of the word beginnings that stand in for a word without a score of its own, longest first.
STEMS = (8, 7, 6, 5, 4, 3)
#: Clean labelled documents in which a word without toxic ones is known well enough to speak for itself.
SEEN = 3
#: Words whose score a worker remembers.
MAX_MEMO = 500_000
#: Evidence of a document without any positive segment: below that of every segment worth a token.
NO_SEGMENT = -16.0

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; the rare token of over 64 letters is named by its hash."""
    found = _TOKEN.findall((text or "").lower())
    return [w if len(w) <= 64 else "#" + blake2b(w.encode("utf-8", "replace"), digest_size=12).hexdigest() for w in found]


def maximal_segments(scores) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence, in order, in linear time."""
    found: list[tuple[float, float, int, int, int]] = []       # sum before, sum after, first, last, nearest lower start
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        low, first, j = before, i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((low, total, first, i, j))
                break
            low, _, first, _, below = found[j]
            del found[j:]
            j = below
    return [(after - before, first, last) for before, after, first, last, _ in found]


class Model:
    """Token scores, the extreme-value scale and the calibration curve."""

    def __init__(self, scores: dict[str, float], stems: dict[str, float], lam: float, curve=(0.0, 0.0), fitted=True):
        self.scores, self.stems, self.lam, self.curve, self.fitted = scores, stems, lam, curve, fitted
        self._memo: dict[str, float] = {}

    def token(self, word: str) -> float:
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) >= MAX_MEMO:
                self._memo.clear()
            known = self.scores.get(word)
            if known is None:
                known = next((self.stems[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems), 0.0)
            self._memo[word] = known
        return known

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def segments(self, words: list[str]) -> list[tuple[float, int, int]]:
        """Maximal segments over token positions; runs of unscored tokens are summed before the scan."""
        known, token = self._memo.get, self.token
        hits = [(i, v) for i, w in enumerate(words) if (v := x if (x := known(w)) is not None else token(w))]
        if not hits:
            return []
        steps, at, end = [], [], -1
        for i, v in hits:
            steps += (-DRIFT * (i - end - 1), v - DRIFT)
            at += (i, i)
            end = i
        return [(s, at[a], at[b]) for s, a, b in maximal_segments(steps)]

    def passages(self, words: list[str]) -> tuple[list[tuple[float, int, int, float]], float]:
        """Significant segments with their expected number, and the evidence of the whole document."""
        n = max(1, len(words))
        found = self.segments(words)
        if not found:
            return [], NO_SEGMENT
        sure = [(s, a, b, n * math.exp(-self.lam * s)) for s, a, b in found]
        kept = [x for x in sure if x[3] <= MAX_E]
        return kept, sum_statistic(sorted((self.lam * x[0] - math.log(n) for x in sure), reverse=True))

    def score(self, evidence: float) -> float:
        if not self.fitted:
            return 0.0
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a + b * evidence))))


def sum_statistic(normed: list[float]) -> float:
    """Evidence of several segments: -ln of the chance of their best sum, the best number of them taken.

    The sum t of the r highest normalised scores exceeds t by chance with probability about
    exp(-t) t^(r-1) / (r! (r-1)!); trying every r costs ln r."""
    best, t = normed[0], 0.0
    for r, x in enumerate(normed, 1):
        t += x
        if t <= 0 or r > 1 and x <= -1:                 # further segments are below what chance brings
            break
        best = max(best, t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r))
    return best


def _count_batches(batches):
    """(token, all, toxic, clean) of each batch: the number of texts that hold a token, so that one text that
    repeats a word, or a long one, weighs no more than another; texts with a label carry 0 or 1, others null."""
    for batch in batches:
        every, toxic, clean = Counter(), Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(tokens(text))
            every.update(words)
            if label is not None:
                (toxic if label else clean).update(words)
        words = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.encode("utf-8", "replace").decode() for w in words], pa.string())]
            + [pa.array([c[w] for w in words], pa.int64()) for c in (every, toxic, clean)], ["token", "n", "toxic", "clean"])


def _sample(labels: DataFrame, bound: int, salt: str) -> DataFrame:
    """Training labels, about ``bound`` of them at most, by a hash of the id: the same ids in every run."""
    return labels.filter(drawn(min(1.0, bound / max(1, labels.count())), salt))


def training_labels(labels: DataFrame, column: str, train) -> DataFrame:
    return (labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & train)
            .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("_label")))


def fit(docs: DataFrame, labels: DataFrame, train, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``labels.toxic`` of the rows where the condition ``train`` (on doc_id) holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(_sample(training_labels(labels, "toxic", train), max_labelled, "fit"), "toxic-labels")     # bounded
    rows = docs.join(F.broadcast(sample), "doc_id", "left").select("text", "_label")
    counts = stored(rows.mapInArrow(_count_batches, "token string, n long, toxic long, clean long")
                    .groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean"))), "token-counts")
    n, n1, n0 = (int(x or 0) for x in counts.agg(F.sum("n"), F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return Model({}, {}, 1.0, fitted=False)
    lengths = F.array(*(F.lit(k) for k in STEMS))
    begins = F.transform(F.filter(lengths, lambda k: k < F.length("token")), lambda k: F.substring(F.col("token"), F.lit(1), k))
    stems = (counts.select(F.explode(begins).alias("token"), "n", "toxic", "clean").groupBy("token")
             .agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean"))))
    a0 = PRIOR * (n0 + n1)

    def scored(frame):
        y1, y0 = (F.col(c) + F.col("n") / n * a0 for c in ("toxic", "clean"))
        odds = F.log(y1 / (n1 + a0 - y1)) - F.log(y0 / (n0 + a0 - y0))
        return (frame.filter("toxic > 0").select("token", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"),
                                                 (y0 / (n0 + a0)).alias("p"))
                .filter(F.abs("z") >= Z_CUT).orderBy("token").collect())         # tokens of the bounded sample only

    words, parts = scored(counts), scored(stems)
    # a word that clean documents know well must not take the score of a toxic word's beginning: it says nothing
    known = counts.filter((F.col("toxic") == 0) & (F.col("clean") >= SEEN)).select(F.col("token").alias("word"), F.explode(begins).alias("token"))
    starts = docs.sparkSession.createDataFrame([(r.token,) for r in parts], "token string")          # bounded: see scored
    plain = {r.word: 0.0 for r in known.join(F.broadcast(starts), "token", "left_semi").select("word").distinct().collect()}
    steps = np.array([r.odds - DRIFT for r in words] + [-DRIFT])
    share = np.array([r.p for r in words] + [max(0.0, 1.0 - sum(r.p for r in words))])
    model = Model(plain | {r.token: r.odds for r in words}, {r.token: r.odds for r in parts}, extreme_value_scale(steps, share))
    seen = (docs.join(F.broadcast(_sample(sample, MAX_CALIBRATION, "calibrate")), "doc_id")
            .select("_label", score_column(model)(F.col("text"))["evidence"].alias("evidence")).collect())
    model.curve = logistic(np.array([r.evidence for r in seen]), np.array([r._label for r in seen], float))
    return model


def extreme_value_scale(steps: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(x step) = 1; the expected step must be negative, else a small scale."""
    if steps.max() <= 0:
        return 1.0
    law = lambda x: float(share @ np.exp(np.minimum(x * steps, 700))) - 1.0
    low, high = 1e-3, 1.0
    if law(low) >= 0:
        return low
    while law(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if law(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps for one variable, lightly penalised so that separable samples end too."""
    if not len(x) or y.min() == y.max():
        return (-20.0 if not len(y) or y.max() == 0 else 20.0), 0.0
    design = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


_RESULT = pa.struct([("score", pa.float64()), ("evidence", pa.float64()), ("passages", pa.list_(pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])))])
RESULT = "score double, evidence double, passages array<struct<start:bigint,end:bigint,score:double,expected:double>>"


def judge(model: Model, text: str | None) -> dict:
    words = tokens(text)
    kept, evidence = model.passages(words)
    spans = []
    if kept:
        places = [m.span() for m in _TOKEN.finditer(text.lower() if len(text.lower()) == len(text) else text)]
        if len(places) == len(words):
            spans = [{"start": places[a][0], "end": places[b][1], "score": s, "expected": e} for s, a, b, e in kept]
        else:                                           # lower-casing changed the number of letters: token positions
            spans = [{"start": a, "end": b + 1, "score": s, "expected": e} for s, a, b, e in kept]
    return {"score": model.score(evidence), "evidence": evidence, "passages": spans}


def score_column(model: Model):
    """Column function text -> score, evidence, passages (character spans)."""
    def run(texts):
        return pa.array([judge(model, t) for t in texts.to_pylist()], _RESULT)

    return F.arrow_udf(run, RESULT).asNondeterministic()


def train_rows():
    return doc_remainder(F.col("doc_id"), 5) != 0


def op4_toxic_passages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_rows())
    rows = docs.select("doc_id", (doc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(model)("text").alias("r"))
    return rows.select("doc_id", "held_out", F.col("r.score").alias("score"),
                       (F.col("r.score") >= 0.5).cast("int").alias("predicted"), F.col("r.passages").alias("passages"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns (the pipeline stage)."""
    model = fit(docs, labels, train_rows())
    return docs.filter(score_column(model)(F.col("text"))["score"] < 0.5)
