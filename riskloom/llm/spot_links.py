"""Near copies among spot sets: all pairs of different sets with Jaccard likeness of at least ``THRESHOLD``.

1. Spot frequencies: every task counts its sets' spots in a sketch of 2^24 counters; the sketches are added slice by
   slice and travel as 2^24 bytes (counts on a logarithmic scale), whatever the corpus.  They only order spots, rarest
   first: the result does not depend on them.
2. Inverted lists: two sets that reach the threshold share one of the first n - ceil(threshold * n) + 1 spots of each.
   Lists of one set go.  Lists with the same smallest member are joined, so near copies, which share many rare
   spots, are sent about once and not once a spot.  Before they are shuffled, spots of one set and sets without a
   list are dropped by bitmaps of 16 MB whatever the corpus; what passes them by chance finds no partner in the join.
3. A list of more than ``BLOCK`` sets is cut by length partition and then by hash into blocks; a pair of blocks is one
   task's work, and only blocks of the same or of neighbouring length partitions meet.  No group, however hot, is
   held by one task, and no pair of texts is sent anywhere: blocks return sums per set.
4. In a block, sets of neighbouring length partitions are compared by pruned Jaccard, rarest spots first.

Defined results: empty sets are equal to each other and have no other link; a table without sets gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.collocations import bitmap, holds
from riskloom.llm.common import attach_groups, hot_floor, stored

#: Two sets are near copies from this Jaccard likeness on.
THRESHOLD = 0.8
#: Counters of the frequency sketch (2^SKETCH_BITS) and the slices in which sketches are added.
SKETCH_BITS, SLICES = 24, 64
#: Sets of a block, about.
BLOCK = 256
#: Rows of at most 64 bytes that may be broadcast (32 MB); longer tables are joined by shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(table: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast of a stored table of narrow rows if its counted rows are few."""
    return F.broadcast(table) if n_rows <= BROADCAST_ROWS else table


# spot frequencies --------------------------------------------------------------------------------------------

def _sketch(batches):
    """Slices of the task's spot counts, compressed."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for found in batch.column(0):
            np.add.at(counts, np.frombuffer(found.as_buffer(), "<u4") >> (32 - SKETCH_BITS), 1)
    pack = zstandard.ZstdCompressor(level=1).compress
    for k, part in enumerate(np.split(counts, SLICES)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], ["slice", "counts"])


def _add(batches):
    """Slices of one number come one after the other; holds one sum at a time."""
    def row(k, total):
        level = np.minimum(np.round(8 * np.log2(1 + total)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "level"])

    unpack = zstandard.ZstdDecompressor().decompress
    now, total = None, None
    for batch in batches:
        for k, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if k != now:
                if now is not None:
                    yield row(now, total)
                now, total = k, np.zeros((1 << SKETCH_BITS) // SLICES, np.float64)
            total += np.frombuffer(unpack(counts), np.uint32)
    if now is not None:
        yield row(now, total)


def spot_levels(sets: DataFrame) -> np.ndarray:
    """Frequency of every spot on a logarithmic scale, by the leading bits of the spot: 2^SKETCH_BITS bytes."""
    added = (sets.select("spots").mapInArrow(_sketch, "slice int, counts binary").repartition("slice")
             .sortWithinPartitions("slice").mapInArrow(_add, "slice int, level binary"))
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for k, level in added.collect():                                                  # at most SLICES rows, 16 MB
        out[k] = np.frombuffer(level, np.uint8)
    return out.ravel()


def ordered(spots: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Spots, rarest first; one order for all sets."""
    return spots[np.lexsort((spots, levels[spots >> (32 - SKETCH_BITS)]))]


def prefix_length(n: int, threshold: float) -> int:
    """So many of its rarest spots a set of n spots must list."""
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def pruned_jaccard(a: frozenset[int], b: frozenset[int], threshold: float = 0.0, order=None) -> float:
    """Jaccard likeness, or 0.0 as soon as it cannot reach ``threshold``.  ``order``: the spots of ``a``, rarest first;
    it is used where ``a`` is no larger than ``b``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not large:
        return 1.0
    if threshold <= 0:
        common = len(small & large)
        return common / (len(a) + len(b) - common)
    if len(small) < threshold * len(large):             # the length partitions already exclude most of these
        return 0.0
    may_miss = int(len(small) - threshold * (len(a) + len(b)) / (1 + threshold) + 1e-9)
    missed = 0
    for x in order if order is not None and small is a else small:
        if x not in large:
            missed += 1
            if missed > may_miss:
                return 0.0
    common = len(small) - missed
    likeness = common / (len(a) + len(b) - common)
    return likeness if likeness >= threshold else 0.0


def length_partition(length: int, threshold: float) -> int:
    """Sets whose lengths differ by a factor of at most 1 / threshold lie in the same or neighbouring partitions."""
    k, bound = 0, 1
    while length > bound:
        bound = max(bound + 1, int(bound / threshold))
        k += 1
    return k


# comparison --------------------------------------------------------------------------------------------------

def compare(rows: pa.Table, home: int, lo: int, hi: int, threshold: float, levels: np.ndarray) -> dict[int, list[int]]:
    """sid -> [copies linked, sets linked] of the pairs that this pair of blocks answers for: a pair that meets in
    several lists counts in the least of them."""
    n = rows["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    rows, n = rows.take(pa.array(order)), n[order]
    sids, copies, blocks = (rows[c].to_pylist() for c in ("sid", "copies", "block"))
    lines = [ordered(np.frombuffer(s, "<u4"), levels).tolist() for s in rows["spots"].to_pylist()]
    sets, homes = [frozenset(x) for x in lines], [frozenset(x) for x in rows["homes"].to_pylist()]
    parts = [length_partition(k, threshold) for k in n.tolist()]
    found: dict[int, list[int]] = {}
    first = 0
    for j in range(len(sids)):
        while parts[first] < parts[j] - 1 or n[first] < threshold * n[j] - 1e-9:
            first += 1
        for i in range(first, j):
            if lo != hi and blocks[i] == blocks[j]:
                continue
            if min(homes[i] & homes[j]) != home or not pruned_jaccard(sets[i], sets[j], threshold, order=lines[i]):
                continue
            for a, b in ((i, j), (j, i)):
                got = found.setdefault(sids[a], [0, 0])
                got[0] += copies[b]
                got[1] += 1
    return found


def _compare_blocks(threshold: float, levels):
    def run(key, rows):
        found = compare(rows, *(k.as_py() for k in key), threshold, levels.value)
        columns = list(found), [v[0] for v in found.values()], [v[1] for v in found.values()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sid", "near", "texts"])
    return run


def _block_pairs(blocks_of: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """block -> pairs of blocks it takes part in, for a list with so many blocks in each length partition."""
    numbered, at = {}, 0
    for part in sorted(blocks_of):
        numbered[part] = range(at, at + blocks_of[part])
        at += blocks_of[part]
    pairs: dict[int, list[tuple[int, int]]] = {b: [(b, b)] for r in numbered.values() for b in r}
    for part, own in numbered.items():
        for a, b in [*combinations(own, 2), *((a, b) for a in own for b in numbered.get(part + 1, ()))]:
            pairs[a].append((a, b))
            pairs[b].append((a, b))
    return pairs


def _dealt(rows: DataFrame) -> DataFrame:
    """home, sid, lo, hi, block: every member of a list of several blocks beside the pairs of blocks it meets in."""
    def run(batches):
        for batch in batches:
            out = []
            for home, sid, part, layout in zip(*(c.to_pylist() for c in batch.columns)):
                blocks_of = {p["part"]: -(-p["size"] // BLOCK) for p in layout}
                before = sum(k for p, k in blocks_of.items() if p < part)
                block = before + (sid * 0x9E3779B97F4A7C15 >> 20) % blocks_of[part]
                out += [(home, sid, lo, hi, block) for lo, hi in _block_pairs(blocks_of)[block]]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["home", "sid", "lo", "hi", "block"])

    return rows.select("home", "sid", "part", "layout").mapInArrow(run, "home long, sid long, lo long, hi long, block long")


def _held_by(bits):
    """Condition on 64-bit keys: false only for keys that are not in the bitmap."""
    def among(keys: pa.Array) -> pa.Array:
        return pa.array(holds(np.frombuffer(bits.value, np.uint8), keys.to_numpy(zero_copy_only=False).view(np.uint64)))
    return F.arrow_udf(among, "boolean")


# the join ----------------------------------------------------------------------------------------------------

def near_copies(fingerprints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest (md5 of the fingerprint), copies (documents with that fingerprint), near_copies (other documents that
    reach the threshold, copies included), near_texts (other fingerprints among theirs), for every fingerprint that
    has a copy or a link.  ``fingerprints`` holds one row per document with its set as sorted 32-bit numbers in
    ``spots``."""
    given = stored(fingerprints.select(F.unhex(F.md5("spots")).alias("digest"), "spots")
                   .withColumn("sid", F.monotonically_increasing_id()), "spot-rows")
    same = stored(given.groupBy("digest").agg(F.min("sid").alias("sid"), F.count("*").alias("copies")), "spot-digests")
    n = max(1, same.count())
    sets = given.join(broadcast_if_small(same.select("sid", "copies"), n), "sid")        # one row of every set
    sc = fingerprints.sparkSession.sparkContext
    levels = sc.broadcast(spot_levels(given))

    def postings(bits=None):
        """sid, spot, part of the spots that sets list; with ``bits`` only of spots that several sets may list."""
        def listed(batches):
            shared = None if bits is None else np.frombuffer(bits.value, np.uint8)
            for batch in batches:
                sid, spot, part = [], [], []
                for s, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rare = ordered(np.frombuffer(found.as_buffer(), "<u4"), levels.value)
                    listing = rare[:prefix_length(len(rare), threshold)]
                    if shared is not None:
                        listing = listing[holds(shared, listing.astype(np.uint64) << np.uint64(32))]
                    sid += [s] * len(listing)
                    spot += listing.tolist()
                    part += [length_partition(len(rare), threshold)] * len(listing)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(np.array(spot, np.uint32).view(np.int32), pa.int32()),
                                                  pa.array(part, pa.int32())], ["sid", "spot", "part"])

        return sets.filter(F.length("spots") > 0).select("sid", "spots").mapInArrow(listed, "sid long, spot int, part int")

    lists = stored(postings().groupBy("spot").agg(F.min("sid").alias("home"), F.count("*").alias("size")).filter("size > 1"), "spot-lists")
    bits = sc.broadcast(bitmap(lists.select(F.shiftleft(F.col("spot").cast("long"), 32).alias("key"))))
    homes = attach_groups(postings(bits), lists, "spot", "size", n).select("home", "sid", "part").distinct()
    homes = stored(homes, "spot-homes")
    bits.destroy()                                                                       # its files on every machine go
    layout = (homes.groupBy("home", "part").agg(F.count("*").alias("size"))
              .groupBy("home").agg(F.sum("size").alias("members"), F.collect_list(F.struct("part", "size")).alias("layout")))
    members = stored(attach_groups(homes, stored(layout, "spot-layouts"), "home", "members", n), "spot-members")
    whole = members.filter(F.col("members") <= BLOCK).select("home", "sid", *[F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "block")])
    meetings = whole.unionByName(_dealt(members.filter(F.col("members") > BLOCK)))
    per = meetings.groupBy("sid").agg(F.collect_list(F.struct("home", "lo", "hi", "block")).alias("at"))
    members_of = sc.broadcast(bitmap(homes.select(F.xxhash64("sid").alias("key"))))
    rows = (sets.select("sid", "spots", "copies").filter(_held_by(members_of)(F.xxhash64("sid"))).join(per, "sid")
            .select("sid", "copies", "spots", (F.length("spots") / 4).cast("long").alias("n"),
                    F.array_distinct(F.col("at.home")).alias("homes"), F.explode("at").alias("a"))
            .select("sid", "copies", "spots", "n", "homes", "a.*"))
    linked = (rows.groupBy("home", "lo", "hi").applyInArrow(_compare_blocks(threshold, levels), "sid long, near long, texts long")
              .groupBy("sid").agg(F.sum("near").alias("near"), F.sum("texts").alias("texts")))
    none = F.lit(0).cast("long")
    links = stored(same.join(linked, "sid", "left").filter("copies > 1 OR texts > 0")
                  .select("digest", "copies", (F.coalesce("near", none) + F.col("copies") - 1).alias("near_copies"),
                          F.coalesce("texts", none).alias("near_texts")), "spot-links")
    levels.destroy()
    members_of.destroy()
    return links


def with_near_copies(rows: DataFrame, near: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (with column fingerprint) and its copies, near_copies and near_texts.  Fingerprints of at least
    ``hot_floor`` documents are looked up by broadcast (at most 10,000), and their rows take no part in the shuffle's keys."""
    hot = F.broadcast(near.filter(F.col("copies") >= hot_floor(n_rows)).select("digest", F.struct("copies", "near_copies", "near_texts").alias("hot")))
    cold = near.filter(F.col("copies") < hot_floor(n_rows)).select(F.col("digest").alias("key"), F.struct("copies", "near_copies", "near_texts").alias("cold"))
    cold = broadcast_if_small(cold, near.count())
    keyed = rows.withColumn("digest", F.unhex(F.md5(F.unbase64("fingerprint")))).join(hot, "digest", "left")
    spread = F.unhex(F.md5(F.concat(F.lit("hot "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread)).join(cold, "key", "left")
    get = lambda c, absent: F.coalesce(F.col(f"hot.{c}"), F.col(f"cold.{c}"), F.lit(absent).cast("long")).alias(c)
    return keyed.select(*rows.columns, get("copies", 1), get("near_copies", 0), get("near_texts", 0))
