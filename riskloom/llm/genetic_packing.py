"""Best-fit packing of tokenised documents into sequences, improved by a grouping genetic algorithm.

Pieces.  A document is its ids and a closing id 0.  One of more than ``CAPACITY`` ids is cut from its end into
full pieces, so that only its first piece may be shorter.  Full pieces are sequences of their own.

Packing.  The other pieces are dealt by hash into blocks of about ``BLOCK``.  Each block is packed on several
islands: a population starts from best-fit orders; crossover injects well-filled bins of one parent into another,
bins with duplicates are removed and the displaced pieces are best-fitted again; mutation empties the worst bins
and as many others and fills new ones exactly where pieces allow it.  After every epoch each island's elite moves to
the next island, through Spark's shuffle.  An island rests once it meets the lower bound on bins.  The best solution
of a block's islands is the block's packing.

No more than one block is ever in one task, and a block's population is a few numbers per piece.

Ids are those of the ``tokenizers`` file; texts without its special token are encoded by the equal rank table,
which is several times faster (a test compares both).

Defined results: a null text is empty: its one id is 0; repeated rows are documents like any other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: Pieces packed together, about; islands of a block, members of an island, epochs, generations of an epoch.
BLOCK, ISLANDS, MEMBERS, EPOCHS, GENERATIONS = 16_384, 3, 4, 2, 40
#: Share of a parent's bins that crossover injects, share of children that mutate, and range of the share of bins that a
#: mutation empties (the worst ones, and as many others).
INJECTED, MUTATED, EMPTIED = 0.04, 0.8, (0.01, 0.4)
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 0

_ENCODERS: dict[tuple, object] = {}


def encoder(vocabulary: str, ranks: str | None):
    """text -> ids as the tokenizers file encodes it, made once in each worker process."""
    key = (vocabulary, ranks)
    if key not in _ENCODERS:
        import json

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        slow = lambda text: whole.encode(text, add_special_tokens=False).ids
        if ranks is None:
            _ENCODERS[key] = slow
        else:
            import public_tokenizers
            import tiktoken

            with open(vocabulary, encoding="utf-8") as f:
                special = [t["content"] for t in json.load(f).get("added_tokens", [])]
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            _ENCODERS[key] = lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)
    return _ENCODERS[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter."""
    first = n % capacity if n > capacity and n % capacity else min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = "default") -> DataFrame:
    """One row per piece; ``row`` numbers the documents."""
    def run(batches):
        import public_tokenizers

        names = [vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS) if ranks == "default" else ranks]
        encode = encoder(*names)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text), END] if text else [END], "<u4")
                out += [(row, doc_id, k, start, length, zlib.crc32(ids[start:start + length].tobytes()))
                        for k, (start, length) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _PIECES)


class _Open:
    """Bins by free room: the tightest that takes a piece is found with bit operations."""

    def __init__(self, room: np.ndarray):
        self.room, self.mask, self.by = room.tolist(), 0, {}
        for b, r in enumerate(self.room):
            if r:
                self._put(b, r)

    def _put(self, b: int, r: int) -> None:
        held = self.by.get(r)
        if held:
            held.append(b)
        else:
            self.by[r] = [b]
            self.mask |= 1 << r

    def place(self, length: int, capacity: int) -> int:
        above = self.mask >> length
        if above:
            r = length + (above & -above).bit_length() - 1
            held = self.by[r]
            b = held.pop()
            if not held:
                self.mask ^= 1 << r
            left = r - length
            self.room[b] = left
        else:
            b, left = len(self.room), capacity - length
            self.room.append(left)
        if left:
            self._put(b, left)
        return b


def best_fit(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """``bins`` (-1: not placed) with the pieces ``loose`` best-fitted in the given order; bins renumbered."""
    used, packed = np.unique(bins, return_inverse=True)
    out = packed - (1 if len(used) and used[0] == -1 else 0)
    held = out >= 0
    load = np.bincount(out[held], weights=lengths[held]).astype(np.int64) if held.any() else np.zeros(0, np.int64)
    room = _Open(capacity - load)
    for i, n in zip(loose.tolist(), lengths[loose].tolist()):
        out[i] = room.place(n, capacity)
    return out


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins: larger is better."""
    load = np.bincount(bins, weights=lengths)
    return -len(load), float(((load / capacity) ** 2).mean()) if len(load) else 0.0


def crossover(lengths, into: np.ndarray, source: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Well-filled bins of ``source`` enter ``into`` whole; bins that hold one of their pieces are removed."""
    load = np.bincount(source, weights=lengths)
    good = np.argsort(-load, kind="stable")[:max(1, len(load) // 2)]
    chosen = rng.choice(good, max(1, int(len(load) * INJECTED)), replace=False) if len(good) > 1 else good
    injected = np.isin(source, chosen)
    broken = np.zeros(into.max() + 1, bool)
    broken[into[injected]] = True
    child = np.where(injected, into.max() + 1 + source, np.where(broken[into], -1, into))
    return best_fit(lengths, child, np.flatnonzero(child < 0), capacity)


def exact_fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin by bin: the longest piece left, then the piece or the pair that fills the bin exactly, else the
    longest that fits.  Lengths are bits of one number, mirrored in another, so a pair is found by one AND."""
    left: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        left.setdefault(n, []).append(i)
    have = sum(1 << n for n in left)
    mirror = sum(1 << (capacity - n) for n in left)
    out = np.full(len(lengths), -1)
    b = 0
    while have:
        room, take = capacity, [have.bit_length() - 1]
        while take:
            for n in take:
                out[left[n].pop()] = b
                room -= n
                if not left[n]:
                    del left[n]
                    have ^= 1 << n
                    mirror ^= 1 << (capacity - n)
            fits = have & ((1 << (room + 1)) - 1)
            if not fits:
                break
            if fits >> room & 1:
                take = [room]
                continue
            pairs = have & (mirror >> (capacity - room)) & ((1 << room) - 1)
            if room % 2 == 0 and pairs >> (room // 2) & 1 and len(left[room // 2]) < 2:
                pairs ^= 1 << (room // 2)
            longest = fits.bit_length() - 1
            take = [n := pairs.bit_length() - 1, room - n] if pairs else [longest]
        b += 1
    return out


def mutate(lengths, bins: np.ndarray, capacity: int, rng) -> np.ndarray:
    """The emptiest bins and as many others are emptied; their pieces fill new bins exactly where they can."""
    load = np.bincount(bins, weights=lengths)
    k = max(1, int(len(load) * rng.uniform(*EMPTIED)))
    gone = np.zeros(len(load), bool)
    gone[np.argsort(load, kind="stable")[:k]] = True
    gone[rng.choice(len(load), k, replace=False)] = True
    loose = np.flatnonzero(gone[bins])
    child = (np.cumsum(~gone) - 1)[bins]
    child[loose] = int((~gone).sum()) + exact_fill(lengths[loose], capacity)
    return child


def first_members(lengths: np.ndarray, members: int, capacity: int, rng) -> list[np.ndarray]:
    """Best fit in decreasing order (``lengths`` come so) and in disturbed orders."""
    none = np.full(len(lengths), -1)
    orders = [np.arange(len(lengths))] + [np.argsort(-lengths * rng.uniform(1, 1.2, len(lengths)), kind="stable")
                                          for _ in range(members - 1)]
    return [best_fit(lengths, none, o, capacity) for o in orders]


def evolve(lengths: np.ndarray, population: list[np.ndarray], generations: int, capacity: int, rng, bound: int,
           log: list[int] | None = None) -> list[np.ndarray]:
    """Steady state: a child of two members replaces the worst when it is better, until the lower bound is met.  The
    number of children made is appended to ``log``."""
    scored = sorted(((fitness(lengths, m, capacity), m) for m in population), key=lambda x: x[0], reverse=True)
    made = 0
    while made < generations * len(scored) and -scored[0][0][0] > bound and len(scored) > 1:
        made += 1
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(lengths, scored[min(a, b)][1], scored[max(a, b)][1], capacity, rng)
        if rng.random() < MUTATED:
            child = mutate(lengths, child, capacity, rng)
        value = fitness(lengths, child, capacity)
        if value > scored[-1][0] and all(value != v for v, _ in scored):
            scored[-1] = (value, child)
            scored.sort(key=lambda x: x[0], reverse=True)
    if log is not None:
        log.append(made)
    return [m for _, m in scored]


_STATE = "block long, island int, member int, bins int, fullness double, children int, genes binary"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def _canonical(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)


def _epoch(epoch: int, capacity: int, members: int, generations: int, islands: int):
    def run(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        lengths = _canonical(items)["length"].to_numpy(np.int64)
        if not len(lengths):
            return pd.DataFrame(columns=_FIELDS)
        rng = np.random.default_rng([block, island, epoch])
        bound = -(-int(lengths.sum()) // capacity)
        if len(state):
            state = state.sort_values(["bins", "fullness", "member"], ascending=[True, False, True]).head(members)
            population = [np.frombuffer(g, "<i4").astype(np.int64) for g in state["genes"]]
        else:
            population = first_members(lengths, members, capacity, rng)
        earlier = int(state.loc[state["member"] < members, "children"].max()) if len(state) else 0
        out, log = [], []
        evolved = evolve(lengths, population, generations, capacity, rng, bound, log)
        for k, m in enumerate(evolved):
            bins, full = fitness(lengths, m, capacity)
            out.append((block, island, k, -bins, full, earlier + log[0], m.astype("<i4").tobytes()))
        if islands > 1:
            out.append((block, (island + 1) % islands, members, *out[0][3:]))        # the elite migrates
        return pd.DataFrame(out, columns=_FIELDS)
    return run


def _decode(key: tuple, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    items = _canonical(items)
    bins = np.frombuffer(best["genes"].iloc[0], "<i4").astype(np.int64)
    order = np.argsort(bins, kind="stable")
    length = items["length"].to_numpy(np.int64)[order]
    start = np.cumsum(length) - length
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = np.empty(len(items), np.int64)
    offset[order] = start - np.maximum.accumulate(np.where(first, start, 0))
    return pd.DataFrame({"row": items["row"], "piece": items["piece"], "sequence_id": (int(key[0]) << 24) + bins, "offset": offset})


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, members: int = MEMBERS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, **names) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cuts = stored(pieces(docs, capacity, **names), "pieces")
    full = cuts.filter(F.col("length") == capacity)
    loose = cuts.filter(F.col("length") < capacity).select("row", "piece", "length")
    blocks = max(1, -(-loose.count() // block))
    items = loose.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    everywhere = items.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands)))))
    spark = docs.sparkSession
    state = spark.createDataFrame([], _STATE)
    for epoch in range(epochs):
        run = _epoch(epoch, capacity, members, generations, islands)
        state = stored(everywhere.groupBy("block", "island").cogroup(state.groupBy("block", "island")).applyInPandas(run, _STATE),
                       f"packing-{epoch}")
    rank = F.struct(-F.col("bins"), F.col("fullness"), -F.col("island"), -F.col("member"))
    best = state.groupBy("block").agg(F.max_by("genes", rank).alias("genes"))
    placed = (items.groupBy("block").cogroup(best.groupBy("block"))
              .applyInPandas(_decode, "row long, piece int, sequence_id long, offset long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return cuts.filter(F.col("length") < capacity).join(placed, ["row", "piece"]).select(columns).unionByName(alone.select(columns))


def op10_genetic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
