"""Spot signatures: localized fingerprints of texts, and their Jaccard likeness to the edited text and to the next.

A spot is a common word (an anchor) with the chain of content words that follow it; a text's fingerprint is
the set of its spots, each hashed to 32 bits.  Common words are spread evenly over running text and rare in
lists and menus, so the set describes the prose of a page.

The query compares a document with its edited text and with the next document, by plain Jaccard, and counts its near
copies in the whole table (``spot_links``: inverted lists of rare spots, length partitions, pruned Jaccard).

Defined results: a null text is empty, its fingerprint is the empty string, and two empty fingerprints have
likeness 1; a text without any anchor has one spot, the chain of all its words; words are lower-cased runs of
letters and digits; a null doc_id comes after all others; equal ids are ordered by text; repeated rows are
documents like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.llm.spot_links import BROADCAST_ROWS, near_copies, pruned_jaccard, with_near_copies

#: Content words of a chain.
CHAIN = 2
#: Rows of a bucket of neighbouring ids, about, and the largest number of buckets (boundaries are broadcast).
BUCKET, MAX_BUCKETS = 2_000, 20_000
#: Rows that a worker turns into Python objects and sends on at a time; bounds its memory.
ROWS_AT_ONCE = 256

# Frequent function words, by language (English, German, French, Spanish).
ANCHORS = frozenset((
    "a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was "
    "were which with you "
    "aber als auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie "
    "sind und von war werden wie zu zum zur "
    "au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses "
    "son sont sur un une vous "
    "al como con del el ella era esta las lo los más no para pero por sin su sus también te todo una y ya").split())

#: Checksum of every anchor and a space; a spot's checksum goes on from there.
_START = {a.encode(): zlib.crc32(f"{a} ".encode()) for a in ANCHORS}
_WORD = re.compile(r"[^\W_]+")
#: Of ASCII text all but letters and digits becomes a space.
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits, in UTF-8."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII).split()
    return [w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())]


def spots(text: str | None, chain: int = CHAIN) -> frozenset[int]:
    """Hashed spots of a text."""
    words = words_of(text or "")
    marks = [i for i, w in enumerate(words) if w in _START]
    content = [w for w in words if w not in _START]
    crc = zlib.crc32
    found = {crc(b" ".join(content[i - j:i - j + chain]), _START[words[i]])                   # i - j content words before
             for j, i in enumerate(marks) if i - j < len(content)}
    if not found and words:
        found = {crc(b"\x00" + b" ".join(words))}
    return frozenset(found)


def encoded(found: frozenset[int]) -> str:
    """The set as text: its sorted 32-bit numbers, little-endian, in base64."""
    return base64.b64encode(np.sort(np.fromiter(found, "<u4", len(found))).tobytes()).decode()


def decoded(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(base64.b64decode(fingerprint), "<u4").tolist())


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id and fingerprint of every text."""
    def run(batches):
        for batch in batches:
            for rows in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([encoded(spots(t, chain)) for t in rows.column(1).to_pylist()], pa.string())],
                    ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def _packed(texts: pa.Array) -> pa.Array:
    """Texts compressed for the way to their bucket; nulls stay null."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.binary())], pa.binary())


def with_ties(rows: DataFrame) -> DataFrame:
    """``rows`` and ``tied``: whether another row may have the same key.  Where more keys than may be broadcast stand for
    several rows, all rows count as tied."""
    several = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("tied")), "spot-ties")
    if several.count() > BROADCAST_ROWS:
        return rows.withColumn("tied", F.lit(True))
    return rows.join(F.broadcast(several), "key", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text, packed, borrowed: rows dealt by ranges of doc_id, each bucket followed by a borrowed copy
    of the document that comes after its last one (descending ids; after the very last the first).  A text travels
    compressed in ``packed`` and is unpacked where it is read; only rows of equal ids, which are ordered by text, have it
    in ``text``."""
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = docs.count()
    buckets = min(MAX_BUCKETS, max(1, -(-count // BUCKET)))
    cuts = np.zeros(0, np.int64)
    if buckets > 1:
        at = [float(i / buckets) for i in range(1, buckets)]
        cuts = np.unique(np.array(rows.agg(F.percentile_approx("key", at, 100_000).alias("q")).first()["q"], np.int64))

    def bucket_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), side="right"), pa.int64())

    bucket = F.arrow_udf(bucket_of, "long")
    heads = (rows.select("key", bucket("key").alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key"))
             .orderBy(F.desc("bucket")).collect())                                     # at most MAX_BUCKETS rows
    after = [(h["bucket"], heads[(i + 1) % len(heads)]["key"]) for i, h in enumerate(heads)]
    borrowed = docs.sparkSession.createDataFrame(after, "bucket long, key long")
    rows = with_ties(rows)
    packed = F.arrow_udf(_packed, "binary")(F.when(~F.col("tied"), F.col("text")))
    columns = ["bucket", "borrowed", "key", "doc_id", F.when(F.col("tied"), F.col("text")).alias("text"), "packed"]
    own = rows.withColumns({"bucket": bucket("key"), "packed": packed}).withColumn("borrowed", F.lit(False)).select(*columns)
    lent = rows.join(F.broadcast(borrowed), "key").withColumn("packed", packed).withColumn("borrowed", F.lit(True)).select(*columns)
    return (own.unionByName(lent).repartition("bucket").sortWithinPartitions("bucket", "borrowed", F.desc("key"), "text")
            .select("bucket", "doc_id", "text", "packed", "borrowed"))


_COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
             "near_next double")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches):
    """Streams sorted rows: a row waits for its successor, one document at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    waiting = None
    for rows in (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
        out = []
        for bucket, doc_id, text, packed, borrowed in zip(*(c.to_pylist() for c in rows.columns)):
            text = unpack(packed).decode() if text is None else text
            now = (bucket, doc_id, text, spots(text), borrowed)
            if waiting is not None and not waiting[4] and waiting[0] == bucket:
                changed = edited(waiting[2], text)
                other = spots(changed)
                out.append((waiting[1], len(waiting[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
                            encoded(waiting[3]), encoded(other), pruned_jaccard(waiting[3], other),
                            pruned_jaccard(waiting[3], now[3])))
            waiting = now
        columns = list(zip(*out)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op1_spot_signatures(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = near_copies(fingerprints(docs).select(F.unbase64("fingerprint").alias("spots")))
    return with_near_copies(with_next(docs).mapInArrow(_compare, _COMPARED), near, docs.count())
