"""Collocations: whole result against plain Python, the Misra-Gries guarantee, keys, odd input."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations as C


def grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", text):
        words = [w for w in re.split("[\x20\x09]+", piece) if w]
        for n in range(1, 6):
            for i in range(len(words) - n + 1):
                yield tuple(words[i:i + n])


def expected(docs, least, top):
    counts = {}
    for lang, text in docs:
        counts.setdefault(lang or "und", Counter()).update(grams(text))
    out = set()
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        covered = {g[i:j]: max(c, 0) for g, c in ()}
        for g, c in cand.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        covered[g[i:j]] = max(covered.get(g[i:j], 0), c)
        rows = []
        for g, a in cand.items():
            if g in covered and 100 * covered[g] >= 100 * a:
                continue
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), " ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        for rank, row in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank) + row[3:])
    return out


def corpus(seed=3, docs=300):
    rng = random.Random(seed)
    vocab = ["The", "of", "RED", "fox", "ünd", "Ärger", "new", "york", "city", "hall", "it's", "a b", "x"]
    phrases = ["New York City Hall", "red fox", "the of the of the of", "x x x x x x x", "single"]
    out = []
    for i in range(docs):
        parts = [rng.choice(phrases) if rng.random() < .3 else rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", ";!", "\x0b"]) for p in parts)
        out.append((rng.choice(["en", "en", "en", "de", None]), text))
    return out + [("en", None), ("fr", ""), (None, " ., \n"), ("en", "new york " * 5000)] + out[:20]


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(C, "FLUSH_WORDS", 700)
    monkeypatch.setattr(C, "PARTITION_MASS", 2000)


@pytest.mark.parametrize("least,top", [(3, 2000), (20, 7), (100, 2000)])
def test_whole_result_against_plain_python(spark, small_chunks, least, top):
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(6)
    assert rows_of(C.mine(df, min_count=least, top=top)) == expected(docs, least, top)


def test_empty_table_clashing_columns_and_other_ids(spark):
    assert C.mine(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    docs = corpus(5, 60)
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("doc_id", F.lit(None).cast("long"))
    for c in ("phrase", "word", "f", "key", "part", "a", "SCORE", "rank", "n"):
        df = df.withColumn(c, F.lit("x"))
    assert rows_of(C.mine(df, min_count=5)) == expected(docs, 5, 2000)


def test_no_frequent_key_is_lost_when_summaries_overflow():
    """Far more keys than counters, frequent ones spread thinly over many summaries, in several orders."""
    rng = np.random.default_rng(1)
    least = 100
    frequent = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    stream = np.concatenate([np.repeat(frequent, least), rng.integers(1, 2 ** 63, 30_000).astype(np.uint64),
                             np.repeat(rng.integers(1, 2 ** 63, 500).astype(np.uint64), 60)])
    capacity = len(stream) // least + 1
    assert capacity < 700
    for seed in range(3):
        np.random.default_rng(seed).shuffle(stream)
        one, two = C.Summary(capacity), C.Summary(capacity)
        for i, piece in enumerate(np.array_split(stream, 50)):
            (one if i % 2 else two).merge(*np.unique(piece, return_counts=True))
        one.merge(two.keys, two.counts)                       # summaries merge; what both subtracted adds up
        one.subtracted += two.subtracted
        assert one.subtracted > 0 and len(one.keys) <= capacity
        assert set(frequent) <= set(one.survivors(least))
        assert len(one.survivors(least)) < 5000


def test_word_keys_are_sparks_hash(spark):
    words = [("en", "the"), ("und", "ünd"), ("de", "x" * 70), ("en", "a b")]
    got = spark.createDataFrame(words, "lang string, word string").select("lang", "word", F.xxhash64("lang", "word").alias("h")).collect()
    import xxhash
    for r in got:
        seed = xxhash.xxh64_intdigest(r["lang"].encode(), seed=42)
        assert C.word_key(r["word"].encode(), seed) == r["h"] % 2 ** 64


def test_bitmap_holds_every_key(spark):
    keys = [0, 1, -1, 2 ** 62, -2 ** 63, 123456789 << 30, -987654321 << 20]
    bits = np.frombuffer(C.bitmap(spark.createDataFrame([(k,) for k in keys], "key long")), np.uint8)
    assert len(bits) == 1 << (C.FILTER_BITS - 3)
    assert C.holds(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert np.unpackbits(bits).sum() == len({k % 2 ** 64 >> 64 - C.FILTER_BITS for k in keys})


def test_score_is_exact_beyond_64_bits(spark):
    big = 3_000_000_007
    words = spark.createDataFrame([("en", "p", big), ("en", "q", big + 2), ("en", "z", 10 ** 12)], "lang string, word string, f long")
    phrases = spark.createDataFrame([("en", "p q", 2, big - 5)], "lang string, phrase string, words int, f long")
    n = big + big + 2 + 10 ** 12
    row = C.scored(words, phrases).first()
    assert row["score"] == 1000 * (big - 5) * n // (big * (big + 2)) and row["n"] == n


def test_partial_counts_are_merged_over_many_splits(spark):
    docs = spark.range(400).select(F.lit("en").alias("lang"), F.lit("new york city").alias("text")).repartition(40)
    sc = spark.sparkContext
    every = [sc.broadcast(b"\xff" * (1 << (C.FILTER_BITS - 3)))] * 3
    counted = C.exact_counts(docs, *every, 5)
    assert {(r.phrase.decode(), r.words, r.f) for r in counted.collect()} == {
        ("new york", 2, 400), ("york city", 2, 400), ("new york city", 3, 400)}
    assert C.few_tasks(docs).rdd.getNumPartitions() == max(sc.defaultParallelism, 40 // C.SPLITS) < 40
