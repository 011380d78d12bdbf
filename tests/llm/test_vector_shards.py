import random
import zlib
from collections import defaultdict

import numpy as np

from riskloom.llm import vector_shards as vs


def test_pack_follows_the_dot_product():
    rng = np.random.default_rng(1)
    items, capacity = rng.random((60, 3)), np.tile([10.0, 11.0, 9.0], (4, 1))
    got = vs.pack(items, capacity)
    mean, residual = capacity.mean(0), [c / capacity.mean(0) for c in capacity.copy()]
    for i in sorted(range(60), key=lambda i: ((items[i] / mean).max(), (items[i] / mean).sum()), reverse=True):
        scores = [float(r @ (vs.WEIGHTS * items[i] / mean)) for r in residual]
        assert scores[got[i]] >= max(scores) - 1e-12
        residual[got[i]] = residual[got[i]] - items[i] / mean


def check(rows, pairs, shards):
    assert len(rows) == len(pairs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_balance_groups_and_slots(make_docs):
    rng = random.Random(2)
    pairs = [(i, " ".join("w" * rng.randint(1, 9) + str(rng.random()) for _ in range(rng.randint(5, 60)))) for i in range(3000)]
    pairs += [(5000 + i, pairs[i % 40][1]) for i in range(200)]                     # copies
    pairs += [(6000 + i, "hot copy of one text " * 10) for i in range(1600)]        # a third of all rows
    pairs += [(9000, None), (9001, ""), (9002, "x" * 30_000), (7, pairs[7][1]), (None, "no id")]
    rows = vs.shard(make_docs(pairs, extra=True), shards=6, part=400).collect()
    check(rows, pairs, 6)
    for of, most in (("size", 1.05), ("tokens", 1.15)):
        sums = defaultdict(int)
        for r in rows:
            sums[r.shard] += getattr(r, of)
        assert max(sums.values()) <= most * min(sums.values()), (of, sums)
    counts = np.bincount([r.shard for r in rows])
    assert counts.max() <= 1.1 * counts.min()
    homes = defaultdict(set)
    text = dict((i, t) for i, t in pairs)
    for r in rows:
        homes[text[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for t, h in homes.items() if t is None or not t.startswith("hot"))
    assert len(homes["hot copy of one text " * 10]) > 1


def test_small_and_empty(make_docs):
    assert vs.shard(make_docs([])).count() == 0
    for pairs in ([(1, None)], [(1, "a"), (1, "a")], [(i, "") for i in range(50)]):
        check(vs.shard(make_docs(pairs)).collect(), pairs, vs.SHARDS)


def test_repeated_rows_and_null_ids_spread_like_distinct_ones(make_docs):
    rng = random.Random(3)
    rest = [(i, " ".join(str(rng.random()) for _ in range(rng.randint(5, 40)))) for i in range(1500)]
    spread = []
    for repeated in ([(7, "one text " * 100)] * 600, [(None, "one text " * 100)] * 600, [(9000 + i, "one text " * 100) for i in range(600)]):
        rows = vs.shard(make_docs(rest + repeated), shards=6, part=300).collect()
        check(rows, rest + repeated, 6)
        sums = np.bincount([r.shard for r in rows], [r.size for r in rows])
        spread.append(sums.max() / sums.min())
    assert max(spread) <= 1.05, spread
