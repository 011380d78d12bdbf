"""N-gram Jaccard self-join with Bayesian candidate pruning.

Links are pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1.  Every text becomes its shingle set (64-bit hashes) and ``BANDS`` x ``ROWS`` MinHash values.  Documents with
    one set form a class; one representative goes on.  A pair at the threshold shares no band with probability
    (1 - 0.8^ROWS)^BANDS, about 2e-8.
2.  Representatives meet in band buckets.  Small buckets give candidate pairs.  Large ones (more than ``DENSE``
    members, as groups of near copies make) give only a star; the groups they join are compared block against
    block inside tasks, so no list of all their pairs is ever made.
3.  MinHash values of a candidate pair are compared ``STEP`` at a time; the pair is dropped once the posterior
    probability that its similarity reaches the threshold falls below ``TOLERANCE``.  What remains is verified
    on whole shingle sets.
4.  Links are counted per class, weighted by the number of documents, and connected components give the class
    ids.

Work and shuffled rows inside one group of near copies grow with the square of its different texts; the memory of
a task does not.
Band keys that hold a large share of all rows are salted before their star is drawn.

Defined results: words are runs of non-white-space; a text of one to four words is one shingle; null, empty
and blank texts have none and link to nothing, not even to each other; repeated rows are copies of one another;
a null doc_id is a document like any other, and a class of null ids only has a null id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, packed, stored
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 96, 8
#: MinHash values (16 bits of each) kept for the incremental comparison, compared so many at a time.
SIGNATURE, STEP, TOLERANCE = 128, 16, 1e-6
#: Members of a bucket up to which it gives pairs; documents of a block.
DENSE, BLOCK = 4, 256
#: Band keys with this share of a sample's rows are salted (so at most 1 / HOT_KEYS keys), over so many salts.
HOT_KEYS, SAMPLE, SALTS = 1e-5, 64, 64
#: Word hashes remembered per worker.
MAX_MEMO = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[str, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    import xxhash

    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_memo) > MAX_MEMO:
        _memo.clear()
    get, digest, out = _memo.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = _memo[w] = digest(w.encode("utf-8", "replace"))
        out.append(h)
    h = np.array(out, np.uint64)
    width = min(WORDS, len(h))
    s = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        s = s * _P + h[j:len(h) - width + 1 + j]
    if width < WORDS:
        s += np.uint64(width)
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_07)
    a = rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def minhash(s: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each hash function over a shingle set, in bounded memory for any length."""
    a, b = (x[:count] for x in _functions())
    x = ((s >> np.uint64(32)) ^ s).astype(np.uint32)
    out = np.full(count, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        part = a * x[None, i:i + 512]
        part += b
        np.minimum(out, part.min(1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _P
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signature(m: np.ndarray) -> np.ndarray:
    return (m[:SIGNATURE] >> np.uint32(16)).astype(np.uint16)


def set_digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= t | m of k match) = P(Binomial(k + 1, t) <= m)."""
    out = []
    for k in range(STEP, SIGNATURE + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(k + 1, m) * threshold ** m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of two aligned signature matrices that the incremental comparison keeps."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches()):
        at = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (left[alive, at] == right[alive, at]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def is_link(common, na, nb):
    """common / union >= THRESHOLD in whole numbers, for integers or arrays."""
    return common * 10 >= (na + nb - common) * int(THRESHOLD * 10)


# 1. shingle sets ---------------------------------------------------------------------------------------------

def _sketch(batches):
    for batch in batches:
        digests, sizes, bands, marks = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            m = minhash(s)
            digests.append(set_digest(s))
            sizes.append(len(s))
            bands.append(band_keys(m) if len(s) else None)
            marks.append(signature(m).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), batch.column(2)],
            ["doc_id", "digest", "n", "bands", "mark", "sha"])


# 2. buckets --------------------------------------------------------------------------------------------------

def _bucket_edges(batches):
    """Rows sorted by key and rep: pairs of small buckets (dense = false), stars of the others.  Holds DENSE rows."""
    key, members, star = None, [], False
    out: list[tuple] = []

    def end():
        if not star:
            out.extend((x, y, False) for i, x in enumerate(members) for y in members[i + 1:])

    def batch_of():
        a, b, d = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.bool_())], ["a", "b", "dense"])

    for batch in batches:
        for k, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                end()
                key, members, star = k, [rep], False
            elif star:
                out.append((members[0], rep, True))
            else:
                members.append(rep)
                if len(members) > DENSE:
                    star = True
                    out.extend((members[0], x, True) for x in members[1:])
            if len(out) > 50_000:
                yield batch_of()
                out.clear()
    end()
    yield batch_of()


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of small buckets, and star edges of large ones."""
    keyed = reps.select(F.explode("bands").alias("key"), "rep")
    sample = stored(reps.filter(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select(F.explode("bands").alias("key"))
                    .groupBy("key").count().filter("count >= 16"), "key-sample")
    floor = int((sample.agg(F.sum("count")).first()[0] or 0) * HOT_KEYS)
    hot = F.broadcast(sample.filter(F.col("count") > floor).orderBy(F.desc("count"), "key").limit(int(1 / HOT_KEYS)).select("key"))
    cold = keyed.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "rep")
    edges = stored(cold.mapInArrow(_bucket_edges, "a long, b long, dense boolean"), "bucket-edges")
    salted = stored(keyed.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))), "hot-keys")
    heads = salted.groupBy("key", "salt").agg(F.min("rep").alias("head"))               # partial sums per task
    tops = heads.groupBy("key").agg(F.min("head").alias("top"))
    star = (salted.join(F.broadcast(heads), ["key", "salt"]).select(F.col("head").alias("a"), F.col("rep").alias("b"))
            .unionByName(heads.join(F.broadcast(tops), "key").select(F.col("top").alias("a"), F.col("head").alias("b"))))
    pairs = stored(edges.filter("NOT dense").select("a", "b").distinct(), "pairs")
    return pairs, edges.filter("dense").select("a", "b").unionByName(star)


# 3. pruning and verification ---------------------------------------------------------------------------------

def _prune(batches):
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for i in (2, 3))
            kept = survivors(left, right)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(kept)) for i in (0, 1)], ["a", "b"])


def _verify_pairs(batches):
    """Exact similarity of pairs; both ends get the other's weight."""
    last, known = None, None
    for batch in batches:
        out = []
        for a, b, wa, wb, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
            if a != last:
                last, known = a, shingles(ta)
            other = shingles(tb)
            common = len(np.intersect1d(known, other, assume_unique=True))
            if is_link(common, len(known), len(other)):
                out += [(a, wb, 1, b), (b, wa, 1, b)]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "texts", "to"])


_LINKS = "rep long, links long, texts long, to long"


def block_links(sets: list[np.ndarray], marks: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Matrix of links between the documents ``first`` and ``second`` (index arrays): signatures compared step by
    step, then whole sets; shared shingles are counted by matrix products over slices of the vocabulary."""
    x, y = (v.ravel() for v in np.meshgrid(first, second, indexing="ij"))
    kept = survivors(marks[x], marks[y])
    alive = np.zeros((len(first), len(second)), bool)
    alive.ravel()[kept] = True
    if not len(kept):
        return alive
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(first), len(second)))
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part[first] @ part[second].T
    return alive & is_link(np.rint(common).astype(np.int64), sizes[first][:, None], sizes[second][None, :])


def _verify_blocks(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One block against another (or itself): links counted per document, joined by a spanning forest."""
    _, lo, hi = (int(k) for k in key)
    frame = frame.sort_values("rep", ignore_index=True)
    sets = [shingles(t) for t in frame["text"]]
    marks = np.stack([signature(minhash(s, SIGNATURE)) for s in sets])
    reps, weight, block = (frame[c].to_numpy(np.int64) for c in ("rep", "weight", "block"))
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    if not len(first) or not len(second):
        return pd.DataFrame(columns=["rep", "links", "texts", "to"])
    link = np.zeros((len(sets), len(sets)), bool)
    link[np.ix_(first, second)] = block_links(sets, marks, first, second)
    link |= link.T
    np.fill_diagonal(link, False)
    root = np.arange(len(sets))
    while True:                                         # smallest index among the linked, until nothing changes
        low = np.where(link, root[None, :], len(sets)).min(1, initial=len(sets))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    texts = link.sum(1)
    held = texts > 0
    return pd.DataFrame({"rep": reps[held], "links": (link @ weight)[held], "texts": texts[held], "to": reps[root[held]]})


def _block_rows(dense: DataFrame, n: int) -> DataFrame:
    """rep, grp, block, blocks of the members of dense groups."""
    sizes = dense.groupBy("grp").agg(F.count("*").alias("size"))
    rows = attach_groups(dense, stored(sizes, "dense-sizes"), "grp", "size", n)
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    return rows.select("rep", "grp", F.pmod(F.xxhash64("rep"), blocks).alias("block"), blocks.alias("blocks"))


# the join ----------------------------------------------------------------------------------------------------

def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_linked_texts and n_copies of every document; see ``_classes``."""
    return _classes(docs).drop("root", "sha")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the connected documents), n_links (other documents that are linked to
    this one, copies included), n_linked_texts (different shingle sets among them), n_copies (documents with its
    own set, itself included); beside them root (a number of the class) and sha (digest of the text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")
    sketch = stored(docs.select("doc_id", "text", sha)
                    .mapInArrow(_sketch, "doc_id long, digest binary, n long, bands array<long>, mark binary, sha binary")
                    .withColumn("row", F.monotonically_increasing_id()), "sketch")
    lone = sketch.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                         F.lit(0).cast("long").alias("n_linked_texts"), F.lit(1).cast("long").alias("n_copies"),
                                         (-1 - F.col("row")).alias("root"), "sha")
    known = sketch.filter("n > 0")
    first = F.min(F.struct("row", "doc_id", "bands", "mark", "sha"))
    reps = stored(known.groupBy("digest").agg(first.alias("f"), F.count("*").alias("weight"), F.min("doc_id").alias("least"))
                  .select("digest", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("doc_id"), "weight", "least",
                          F.col("f.bands").alias("bands"), F.col("f.mark").alias("mark"), F.col("f.sha").alias("sha")), "reps")
    n = reps.count()
    pairs, star = candidates(reps)
    groups = components(star)
    dense = stored(groups.select(F.col("node").alias("rep"), F.col("root").alias("grp"))
                   .unionByName(groups.select(F.col("root").alias("rep"), F.col("root").alias("grp")).distinct()), "dense")
    grp = lambda c: dense.select(F.col("rep").alias(c), F.col("grp").alias(f"grp_{c}"))
    mark = lambda c: reps.select(F.col("rep").alias(c), F.col("mark").alias(f"mark_{c}"))
    apart = (pairs.join(grp("a"), "a", "left").join(grp("b"), "b", "left")
             .filter("grp_a IS NULL OR grp_b IS NULL OR grp_a <> grp_b").select("a", "b"))
    kept = stored(apart.join(mark("a"), "a").join(mark("b"), "b").select("a", "b", "mark_a", "mark_b")
                  .mapInArrow(_prune, "a long, b long"), "kept-pairs")
    wanted = (kept.select(F.col("a").alias("rep")).unionByName(kept.select(F.col("b").alias("rep")))
              .unionByName(dense.select("rep")).distinct()
              .join(reps.select("rep", "weight", F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")), "rep"))
    given = docs.select("doc_id", "text", sha)            # by id and text: many texts may come with one id, or with none
    texts = stored(given.join(wanted, given["doc_id"].eqNullSafe(wanted["_id"]) & (given["sha"] == wanted["_sha"]))
                   .groupBy("rep").agg(F.min("weight").alias("weight"), F.min("text").alias("text")), "texts")
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("weight").alias(f"w_{c}"), F.col("text").alias(f"t_{c}"))
    loose = (kept.join(side("b"), "b").join(side("a"), "a").sortWithinPartitions("a").select("a", "b", "w_a", "w_b", "t_a", "t_b")
             .mapInArrow(_verify_pairs, _LINKS))
    members = stored(_block_rows(dense, n), "blocks")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocks = (members.join(texts, "rep").withColumn("_other", each)
              .groupBy("grp", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"))
              .applyInPandas(_verify_blocks, _LINKS))
    links = stored(loose.unionByName(blocks), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per = (reps.select("rep", "digest", "weight", "least").join(counts, "rep", "left")
           .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
           .select("digest", "weight", "least", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"),
                   F.coalesce("texts", F.lit(0)).alias("texts")))
    per = stored(per, "per-class")
    ids = stored(per.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("size")), "class-ids")
    named = stored(attach_groups(per, ids, "root", "size", n).drop("size"), "named")
    rows = attach_groups(known.select("doc_id", "digest", "sha"), named, "digest", "weight", n)
    return rows.select("doc_id", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"),
                       F.col("texts").alias("n_linked_texts"), F.col("weight").alias("n_copies"), "root", "sha").unionByName(lone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id (of several texts with that id the one with the
    smallest digest), with all its columns (the pipeline stage).  Equal rows stay once; a document without any
    word is a class of its own."""
    held = (_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .groupBy("root").agg(F.min(F.struct("sha", "doc_id")).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.sha").alias("_held")))
    rows = packed(docs, id=F.col("doc_id"), sha=F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    one = rows.join(held, rows["id"].eqNullSafe(held["_id"]) & (rows["sha"] == held["_held"]), "left_semi")
    return one.dropDuplicates(["id", "sha"]).select("row.*")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
