import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import toxic_passages as tp


def brute_segments(scores):
    """Recursive definition: take the best segment, then the same to its left and right."""
    def best(lo, hi):
        found = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        a, b = -found[2], -found[2] - found[1]
        return best(lo, a) + [(found[0], a, b - 1)] + best(b, hi)
    return best(0, len(scores))


def test_segments_match_definition():
    rng = random.Random(5)
    for _ in range(400):
        scores = [rng.choice([-3.1, -2.2, -1.3, -.7, .9, 1.7, 2.3, 4.1]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        got = tp.maximal_segments(scores)
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(got, want))


def test_compressed_scan_equals_plain_scan():
    model = tp.Model({"bad": 3.0, "awful": 2.0, "nice": -1.0}, {"slim": 2.5}, 1.0)
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.choice(["a", "b", "bad", "awful", "nice", "slimy"]) for _ in range(rng.randint(0, 40))]
        plain = tp.maximal_segments([model.token(w) - tp.DRIFT for w in words])
        assert [(a, b) for _, a, b in model.segments(words)] == [(a, b) for _, a, b in plain]


def test_learns_and_generalises(spark, make_docs):
    rng = random.Random(1)
    plain = ["".join(p) for p in itertools.product("bdfg", "aeio", "lmnr", "aeiu")]
    pairs, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "moronic", "scummy"]))
        pairs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    pairs += [(9001, None), (9002, ""), (9003, "idiotic " * 60_000), (0, pairs[0][1]), (None, "bala")]
    docs = make_docs(pairs, extra=True)
    frame = spark.createDataFrame(labels + [(9001, None, None)], "doc_id long, quality int, toxic int")
    model = tp.fit(docs, frame, tp.train_rows())
    out = {r.doc_id: r for r in docs.select("doc_id", tp.score_column(model)("text").alias("r")).collect()}
    wrong = [i for i in range(1500) if (out[i].r.score >= .5) != (i % 8 == 0)]
    assert len(wrong) <= 5
    assert out[9001].r.score == out[9002].r.score < .5 and out[9003].r.score > .9
    p = out[8].r.passages[0]
    assert any(w in pairs[8][1][p.start:p.end] for w in ("idiotic", "moronic", "scummy")) and p.expected <= tp.MAX_E
    kept = tp.reject(make_docs(pairs), frame)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.filter("doc_id is null or doc_id in (9001, 9002, 1)").count() == 4 and kept.filter("doc_id = 9003").count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)]])
def test_without_labels_nothing_is_rejected(spark, make_docs, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b"), (2, "c"), (3, None)])
    assert tp.reject(docs, frame).count() == 3
    assert tp.reject(make_docs([]), frame).count() == 0


def test_words_of_clean_documents_do_not_take_a_toxic_beginning(spark, make_docs):
    """A frequent clean word that begins like a toxic one must not take that beginning's score."""
    rng = random.Random(2)
    fill = [f"f{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    pairs, labels = [], []
    for i in range(1200):
        words = [rng.choice(fill) for _ in range(30)]
        words += [rng.choice(["slimeball", "slimebag", "slimeface"])] * 2 if i % 4 == 0 else ["slimecot", "slimecot"]
        pairs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tp.fit(make_docs(pairs), frame, tp.train_rows())
    assert model.token("slimecot") <= 0 < model.token("slimeball")
    assert tp.judge(model, "slimecot " * 50)["score"] < 0.5


def test_rejecting_keeps_every_column(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)], extra=True)
    frame = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = tp.reject(docs, frame)
    assert out.columns == docs.columns and all(r["_toxic"] == "x" for r in out.collect()) and out.count() == 2
