import hashlib
import random

import pytest

from riskloom.llm import spot_links as sl
from riskloom.llm import spot_signatures as ss


def test_spots():
    assert ss.spots("At a rally to kick off the weekend") == {
        ss.zlib.crc32(x) for x in (b"at rally kick", b"a rally kick", b"to kick off", b"the weekend")}
    assert ss.spots(None) == ss.spots("") == ss.spots(" !! ") == frozenset()
    assert len(ss.spots("kein ankerwort hier")) == 1 and ss.spots("kein ankerwort hier") != ss.spots("kein ankerwort dort")
    assert ss.decoded(ss.encoded(ss.spots("the cat of the house"))) == ss.spots("the cat of the house")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95])
def test_pruned_jaccard_and_partitions(threshold):
    rng = random.Random(8)
    for _ in range(3000):
        a = frozenset(rng.sample(range(60), rng.randint(0, 40)))
        b = frozenset(x for x in a if rng.random() < .9) | frozenset(rng.sample(range(60), rng.randint(0, 3)))
        plain = len(a & b) / len(a | b) if a | b else 1.0
        assert ss.pruned_jaccard(a, b) == plain
        assert ss.pruned_jaccard(a, b, threshold) == (plain if plain >= threshold else 0.0)
        if plain >= threshold and a and b:
            assert abs(sl.length_partition(len(a), threshold) - sl.length_partition(len(b), threshold)) <= 1


def brute(pairs):
    order = sorted(pairs, key=lambda p: (-(p[0] if p[0] is not None else -(1 << 63)), p[1] or ""))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[:len(t) - half] + u[:half]
        sets = [ss.spots(x) for x in (t, e, u)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), ss.encoded(sets[0]), ss.encoded(sets[1]), *like))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 7, 2000])
def test_query_against_brute_force(spark, make_docs, monkeypatch, tmp_path, bucket):
    monkeypatch.setattr(ss, "BUCKET", bucket)
    rng = random.Random(1)
    words = "the of and house der und maison le stone river 日本 é x".split()
    pairs = [(rng.choice([i, i * 1000, -i]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    pairs += [(7, "the same id"), (7, "and another text"), (50_000_000, None), (None, "no id at all"), (None, None), (9, "x" * 100_000)]
    pairs += [(-10 ** 12, pairs[3][1]), pairs[5], pairs[5]]
    make_docs(pairs, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = ss.op1_spot_signatures(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got) == brute(pairs)


def test_single_and_empty(spark, make_docs, tmp_path):
    make_docs([(1, "the one text of all")]).write.parquet(f"{tmp_path}/a/documents.parquet")
    row = ss.op1_spot_signatures(spark, f"{tmp_path}/a").first()
    assert row.near_next == 1.0 and row.n_chars == 19
    make_docs([]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert ss.op1_spot_signatures(spark, f"{tmp_path}/b").count() == 0
    assert ss.fingerprints(make_docs([(1, None), (2, "the cat")])).count() == 2


def near_by_brute_force(texts):
    sets = [ss.spots(t) for t in texts]
    out = []
    for a in sets:
        linked = [b for b in sets if (len(a & b) >= 0.8 * len(a | b) - 1e-9 if a | b else True)]
        out.append((sum(a == b for b in sets), len(linked) - 1, len({b for b in linked if b != a})))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_near_copies_against_all_pairs(spark, make_docs, monkeypatch, tmp_path, block):
    monkeypatch.setattr(sl, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    anchors = "the of and a in".split()

    def text(n):
        return [x for _ in range(n) for x in (rng.choice(anchors), rng.choice(words), rng.choice(words))]

    texts = [" ".join(text(rng.randint(1, 40))) for _ in range(60)]
    for size in (2, 5, 70):                              # groups of near copies; their edits chain beyond the threshold
        base = text(30)
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[:rng.choice([len(copy), len(copy), rng.randint(60, 90)])]))
    texts += texts[-3:] + [texts[0]] * 40 + [None, "", "no anchors here", "the end", "the end"]
    pairs = list(enumerate(texts))
    make_docs(pairs, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.copies, r.near_copies, r.near_texts) for r in ss.op1_spot_signatures(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(near_by_brute_force(texts)))
    assert max(v[2] for v in got.values()) > 20


def test_blocks_meet_once():
    pairs = sl._block_pairs({3: 2, 4: 1, 6: 3})
    met = {p for ps in pairs.values() for p in ps}
    assert met == {(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2), (3, 3), (4, 4), (5, 5), (3, 4), (3, 5), (4, 5)}
    assert all(b in p and len(set(ps)) == len(ps) for b, ps in pairs.items() for p in ps)


def test_prefixes_of_near_copies_meet():
    rng = random.Random(3)
    levels = sl.np.zeros(1 << sl.SKETCH_BITS, sl.np.uint8)
    for _ in range(2000):
        a = rng.sample(range(1 << 32), rng.randint(1, 30))
        b = [x for x in a if rng.random() < .95] + rng.sample(range(1 << 32), rng.randint(0, 3))
        like = len(set(a) & set(b)) / len(set(a) | set(b))
        rare = [set(sl.ordered(sl.np.array(s, sl.np.uint32), levels)[:sl.prefix_length(len(s), .8)].tolist()) for s in (a, b)]
        assert like < .8 or rare[0] & rare[1]


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_only_rows_of_equal_ids_travel_with_their_plain_text(spark, make_docs, monkeypatch, tmp_path, broadcast_rows):
    """Texts are unpacked by the worker that compares them: no second Python step, and few rows in Python at a time."""
    monkeypatch.setattr(ss, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(ss, "BUCKET", 40)
    monkeypatch.setattr(ss, "ROWS_AT_ONCE", 7)
    rng = random.Random(2)
    pairs = [(i, f"the text of {i} and the é {rng.random()}") for i in range(200)]
    pairs += [(7, "a second text of the id"), (7, None), (None, "the last"), (None, "and the very last"), (199, "the first of all")]
    docs = make_docs(pairs)
    rows = ss.with_next(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan.split("RepartitionByExpression")[0]
    texts = {r.doc_id for r in rows.collect() if r.text is not None}
    assert texts == ({7, 199, None} if broadcast_rows else {i for i, _ in pairs})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = ss.op1_spot_signatures(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got) == brute(pairs)


def test_sets_without_a_list_are_dropped_before_the_join(spark):
    keys = sl.np.array([3 << 40, -5 << 41, 7 << 42], sl.np.int64)
    bits = sl.bitmap(spark.createDataFrame([(int(k),) for k in keys[:2]], "key long"))
    held = sl._held_by(spark.sparkContext.broadcast(bits))
    got = spark.createDataFrame([(int(k),) for k in keys], "key long").filter(held(sl.F.col("key"))).collect()
    assert [r.key for r in got] == keys[:2].tolist()
