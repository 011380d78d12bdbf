"""Phrase collocations by mergeable Misra-Gries summaries, then one exact count.

A phrase of 2 to 5 words can only reach ``min_count`` if all its words do, and then if all its word pairs do.  So:

1. words are counted exactly (they are needed for the scores);
2. tasks turn the pairs of frequent words into local summaries, one per hash partition; the summaries of a partition are
   merged with a capacity above its mass / min_count, so no pair that occurs min_count times is lost;
3. the same for 3 to 5 words, over places where every pair survived;
4. a second reading counts every surviving phrase exactly, by its words, never by a hash;
5. cuts, scores, the containment rule and the ranking are DataFrame operations on the counted phrases.

Merging subtracts the (capacity + 1)-th largest counter from all; each unit subtracted removes capacity + 1 units of
mass, so a counter is at most mass / (capacity + 1) < min_count / ROOM too low.  Whatever a task counts min_count times by
itself survives at once and adds no mass, so that a very common phrase does not fill its partition.  A survivor must
still be able to reach min_count: counter plus all that was subtracted.

Tasks know frequent words and survivors through a bitmap of ``2 ** FILTER_BITS`` bits (16 MB whatever the corpus): a bit
set by another entry lets a rare phrase through to the exact count, which drops it; none is lost.

Defined results: a null text is empty, a null lang is ``und``; empty tables and texts give no phrases; repeated rows
count as often as they stand; doc_id and other columns are not read.  Ties: see ``ranked``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: least count, longest phrase, phrases reported per language.
MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bits of the filter sent to every task (2 ** 27 bits are 16 MB).
FILTER_BITS = 27
#: Words a task holds before it turns them into summaries; bounds its memory.
FLUSH_WORDS = 1_500_000
#: Occurrences one hash partition is meant to take; the number of partitions grows with the corpus.
PARTITION_MASS = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")

SUMMARY = "part long, mass long, sure binary, keys binary, counts binary"


# ---- words -------------------------------------------------------------------------------------------------

def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: exact, over all documents."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), r"[\x20\x09.,;:!?\x0A-\x0D]+")
    return (docs.select(language(F.col("lang")).alias("lang"), F.explode(words).alias("word"))
            .filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f")))


def bitmap(keys: DataFrame) -> bytes:
    """Bit (key >> (64 - FILTER_BITS)) set for every ``key``: FILTER_BITS bound it, not the number of keys."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1
    rows = (keys.select(place.alias("place"))
            .groupBy(F.bitmap_bucket_number("place").alias("nr"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in rows:
        start = (r["nr"] - 1) * 4096
        out[start:start + 4096] = r["bits"]
    return bytes(out)


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_key(word: bytes, seed: int) -> int:
    """Equals Spark's xxhash64(lang, word) for seed = xxh64(lang, 42)."""
    return xxhash.xxh64_intdigest(word, seed=seed)


class Vocabulary(dict):
    """Word -> small number; 0 for a break and for words that cannot be frequent."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__({b"": -1, b"\n": 0})
        self.seed, self.bits = xxhash.xxh64_intdigest(lang.encode(), seed=42), bits
        self.words, self.keys = [b"\n"], [0]

    def __missing__(self, word: bytes) -> int:
        key = word_key(word, self.seed)
        place = key >> (64 - FILTER_BITS)
        nr = 0
        if self.bits[place >> 3] >> (place & 7) & 1:
            nr = len(self.words)
            self.words.append(word)
            self.keys.append(key)
        self[word] = nr
        return nr

    def encode(self, text: bytes) -> np.ndarray:
        """Numbers of the words of ``text``, a 0 at every break and at both ends."""
        tokens = text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        return np.concatenate(([0], out[out >= 0], [0])).astype(np.int32)


def chunks(batches, bits: np.ndarray):
    """[(lang, vocabulary, numbers)] of about FLUSH_WORDS words at a time."""
    held, size = {}, 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, pc.cast(batch.column(1), pa.binary())):
            text = text.as_py()
            if not text:
                continue
            if lang not in held:
                held[lang] = (Vocabulary(lang, bits), [])
            vocabulary, parts = held[lang]
            parts.append(vocabulary.encode(text))
            size += len(parts[-1])
            if size >= FLUSH_WORDS:
                yield [(k, v, np.concatenate(p)) for k, (v, p) in held.items()]
                held, size = {}, 0
    if held:
        yield [(k, v, np.concatenate(p)) for k, (v, p) in held.items()]


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


# ---- keys of phrases ---------------------------------------------------------------------------------------

def extend(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit key of a phrase from the key of all but its last word and the key of that word."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pairs_at(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two words that may be frequent follow each other, and the keys of those pairs."""
    at = np.flatnonzero((keys[:-1] != 0) & (keys[1:] != 0))
    return at, extend(keys[at], keys[at + 1])


def longer_at(keys: np.ndarray, pair_bits: np.ndarray, longest: int):
    """(n, places, keys) for n = 3 .. longest, where every pair inside survived."""
    at, key = pairs_at(keys)
    alive = holds(pair_bits, key)
    at, key = at[alive], key[alive]
    paired = np.zeros(len(keys), dtype=bool)
    paired[at] = True
    for n in range(3, longest + 1):
        go = paired[at + n - 2]                     # the pair of the last two words
        at, key = at[go], key[go]
        key = extend(key, keys[at + n - 1])
        yield n, at, key


# ---- Misra-Gries summaries ---------------------------------------------------------------------------------

def local_summaries(key_sets, parts: int, min_count: int):
    """One row per hash partition from one chunk's phrase keys.  ``sure`` keys reach min_count here already."""
    keys = np.concatenate(key_sets) if key_sets else np.empty(0, np.uint64)
    if not len(keys):
        return None
    keys, counts = np.unique(keys, return_counts=True)
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows = {"part": [], "mass": [], "sure": [], "keys": [], "counts": []}
    for nr, k, c in zip(part[np.concatenate(([0], cuts))], np.split(keys, cuts), np.split(counts, cuts)):
        rest = c < min_count
        rows["part"].append(int(nr))
        rows["mass"].append(int(c[rest].sum()))
        rows["sure"].append(k[~rest].tobytes())
        rows["keys"].append(k[rest].tobytes())
        rows["counts"].append(c[rest].astype(np.uint8 if min_count <= 256 else np.uint32).tobytes())
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([
        ("part", pa.int64()), ("mass", pa.int64()), ("sure", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]))


class Summary:
    """Misra-Gries counters of one hash partition; ``merge`` takes another summary's counters."""

    def __init__(self, capacity: int):
        self.capacity, self.subtracted = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate((self.keys, keys))
        self.keys, where = np.unique(both, return_inverse=True)
        self.counts = np.bincount(where, weights=np.concatenate((self.counts, counts)),
                                  minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            nr = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, nr)[nr])             # the (capacity + 1)-th largest
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut
            self.subtracted += cut

    def survivors(self, min_count: int) -> np.ndarray:
        return self.keys[self.counts + self.subtracted >= min_count]


#: Counters per partition, in units of mass / min_count.  Above 1 nothing is lost; what is subtracted stays below
#: min_count / ROOM, so that few phrases survive that do not reach min_count.
ROOM = 16
#: Counters gathered before a merge: fewer sorts, bounded memory.
GATHER = 1 << 20


def merge_partitions(batches, capacity: int, min_count: int):
    """Rows of SUMMARY ordered by part -> surviving keys.  Holds one partition's counters at a time."""
    width = np.uint8 if min_count <= 256 else np.uint32
    out = pa.schema([("key", pa.int64())])

    def emit(keys):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], schema=out)

    now, summary, wait, size = None, None, [], 0

    def settle():
        nonlocal wait, size
        if wait:
            summary.merge(np.concatenate([k for k, _ in wait]), np.concatenate([c for _, c in wait]).astype(np.int64))
        wait, size = [], 0

    for batch in batches:
        for part, sure, keys, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
            if part != now:
                if summary is not None:
                    settle()
                    yield emit(summary.survivors(min_count))
                now, summary = part, Summary(capacity)
            if len(sure.as_py()):
                yield emit(np.frombuffer(sure.as_py(), np.uint64))
            wait.append((np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), width)))
            size += len(wait[-1][0])
            if size >= GATHER:
                settle()
    if summary is not None:
        settle()
        yield emit(summary.survivors(min_count))


def survivors(summaries: DataFrame, min_count: int, name: str) -> DataFrame:
    """key: every phrase that may occur min_count times; none that does is missing."""
    summaries = stored(summaries, f"{name}-summaries", codec="uncompressed")
    mass = summaries.groupBy("part").agg(F.sum("mass").alias("mass")).agg(F.max("mass")).first()[0] or 0
    capacity = ROOM * mass // min_count + 1                         # above mass / min_count in every partition
    ordered = summaries.repartition(F.col("part")).sortWithinPartitions("part")
    return stored(ordered.mapInArrow(lambda b: merge_partitions(b, capacity, min_count), "key long"), f"{name}-survivors")


# ---- the exact count ---------------------------------------------------------------------------------------

def exact_rows(lang: str, vocabulary: Vocabulary, numbers: np.ndarray, pair_bits, long_bits, longest: int):
    """(lang, phrase, words, f) of one chunk, grouped by the words themselves."""
    keys = np.array(vocabulary.keys, dtype=np.uint64)[numbers]
    at, key = pairs_at(keys)
    alive = holds(pair_bits, key)
    at, key = at[alive], key[alive]
    exact = numbers[at].astype(np.int64) << 32 | numbers[at + 1]
    paired = np.zeros(len(keys), dtype=bool)
    paired[at] = True
    for n in range(2, longest + 1):
        if n > 2:
            go = paired[at + n - 2]
            at, key, rank = at[go], key[go], rank[go]  # noqa: F821 - set by the round before
            key = extend(key, keys[at + n - 1])
            exact = rank << 32 | numbers[at + n - 1]
        found, first, rank, count = np.unique(exact, return_index=True, return_inverse=True, return_counts=True)
        rank = rank.astype(np.int64)
        wanted = np.ones(len(found), bool) if n == 2 else holds(long_bits, key[first])
        for place, f in zip(at[first[wanted]], count[wanted]):
            yield lang, b" ".join([vocabulary.words[i] for i in numbers[place:place + n]]), n, int(f)


#: Phrases a task counts before it sends its counts on; bounds its memory.
HELD_PHRASES = 400_000


#: Splits of the input that one task may count, where there are more splits than cores.
SPLITS = 8


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` read by one task a core, or by one task for SPLITS splits if those are more.  Every task sends its own
    counts of nearly all survivors, whose number grows with the input as the number of splits does."""
    splits = rows.rdd.getNumPartitions()
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS)))


def exact_counts(docs: DataFrame, word_bits, pair_bits, long_bits, longest: int) -> DataFrame:
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("f", pa.int64())])

    def run(batches):
        words, pairs, long = (np.frombuffer(b.value, np.uint8) for b in (word_bits, pair_bits, long_bits))
        held = {}

        def rows():
            columns = list(zip(*((*k, f) for k, f in held.items())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for chunk in chunks(batches, words):
            for part in chunk:
                for lang, phrase, n, f in exact_rows(*part, pairs, long, longest):
                    held[lang, phrase, n] = held.get((lang, phrase, n), 0) + f
            if len(held) >= HELD_PHRASES:
                yield rows()
                held.clear()
        if held:
            yield rows()

    local = few_tasks(texts(docs)).mapInArrow(run, "lang string, phrase binary, words int, f long")
    return local.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words(lang, word, f) of all words, phrases(lang, phrase, words, f) with f >= min_count."""
    sc = docs.sparkSession.sparkContext
    words = stored(word_counts(docs), "collocation-words")
    known = words.filter(F.col("f") >= min_count)
    word_bits = sc.broadcast(bitmap(known.select(F.xxhash64("lang", "word").alias("key"))))
    parts = int(known.agg(F.sum("f")).first()[0] or 0) // PARTITION_MASS + 1

    def pair_rows(batches):
        bits = np.frombuffer(word_bits.value, np.uint8)
        for chunk in chunks(batches, bits):
            row = local_summaries([pairs_at(np.array(v.keys, np.uint64)[x])[1] for _, v, x in chunk], parts, min_count)
            if row is not None:
                yield row

    pair_bits = sc.broadcast(bitmap(survivors(texts(docs).mapInArrow(pair_rows, SUMMARY), min_count, "pairs")))

    def longer_rows(batches):
        bits, pairs = np.frombuffer(word_bits.value, np.uint8), np.frombuffer(pair_bits.value, np.uint8)
        for chunk in chunks(batches, bits):
            sets = [key for _, v, x in chunk for _, _, key in longer_at(np.array(v.keys, np.uint64)[x], pairs, longest)]
            row = local_summaries(sets, parts, min_count)
            if row is not None:
                yield row

    long_bits = sc.broadcast(bitmap(survivors(texts(docs).mapInArrow(longer_rows, SUMMARY), min_count, "longer")))
    counted = exact_counts(docs, word_bits, pair_bits, long_bits, longest).filter(F.col("f") >= min_count)
    phrases = stored(counted.withColumn("phrase", F.col("phrase").cast("string")), "collocation-phrases")
    return words, phrases


# ---- scores ------------------------------------------------------------------------------------------------

def scored(words: DataFrame, phrases: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, words, a, n, l, r, score of every candidate at its lowest-scoring cut (ties: shortest first part)."""
    known = words.filter(F.col("f") >= min_count)
    parts = known.select("lang", F.col("word").alias("part"), "f").unionByName(
        phrases.select("lang", F.col("phrase").alias("part"), "f"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    said = F.split("phrase", " ")
    cuts = (phrases.select("lang", "phrase", "words", F.col("f").alias("a"), said.alias("said"),
                           F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .select("lang", "phrase", "words", "a", "k",
                    F.array_join(F.slice("said", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("said", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")))
    both = (cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(totals, "lang"))
    # decimal(38) holds 1000 * a * n and l * r up to counts of 1e17; div is exact integer division
    whole = "cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))"
    score = F.expr(f"cast(({whole}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    best = (both.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    return best.select("lang", "phrase", "words", "a", "n", "cut.l", "cut.r", "cut.score")


def standing(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate contains with 100 * f(longer) >= 100 * a."""
    said = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(said, i, m), " "))))
    inside = (candidates.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    return (candidates.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(100) * F.col("a"))).drop("longer"))


#: Tasks that choose their own first rows of a language before one task ranks the winners.
RANK_SALTS = 16


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` per language by score and count descending, then phrase in UTF-8 byte order."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    near = (salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("place") <= top))
    final = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return final.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    words, phrases = frequent_phrases(docs.select("lang", "text"), min_count, longest)
    return ranked(standing(scored(words, phrases, min_count)), top)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5], lambda m:
           list_transform(range(1, len(ws) - m + 2), lambda i: struct_pack(m := m, phrase := array_to_string(ws[i:i + m - 1], ' ')))))) AS g
  FROM w WHERE len(ws) > 0
), f AS (SELECT lang, g.m AS m, g.phrase AS phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 100),
cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)
), s AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, h.f AS l, r.f AS r, t.n,
         ((1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (h.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head AND h.m = c.k
       JOIN f r ON r.lang = c.lang AND r.phrase = c.rest AND r.m = c.m - c.k JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nr FROM s) WHERE nr = 1
), inner_spans AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda w: list_transform(range(1, m - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))))) AS phrase
  FROM cand WHERE m > 2
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_spans GROUP BY ALL)
SELECT * FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase)::BIGINT AS rank,
         b.phrase, b.a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, b.n::BIGINT AS n, b.score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < 100 * b.a
) WHERE rank <= 2000
"""
