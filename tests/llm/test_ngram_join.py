import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ngram_join as nj
from riskloom.llm.components import components


def brute(pairs):
    def grams(t):
        w = (t or "").split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [grams(t) for _, t in pairs]
    n = len(pairs)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i].append(j)
                links[j].append(i)
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in links[i]:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i in range(n):
        ids = [pairs[i][0]] if pairs[i][0] is not None else []
        least.setdefault(find(i), []).extend(ids)
    return sorted((str(pairs[i][0]), str(min(least[find(i)], default=None)), len(links[i]),
                   len({sets[j] for j in links[i]} - {sets[i]}), max(1, sum(s == sets[i] for s in sets) if sets[i] else 1)) for i in range(n))


def edit(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        texts.append([word() for _ in range(rng.randint(1, 120))])
    for _ in range(60):                                                   # share a passage, not similar as a whole
        texts.append(passage + [word() for _ in range(rng.randint(20, 100))])
    for base in range(12):                                                # near copies on both sides of the threshold
        words = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(2, 5)):
            texts.append(edit(rng, words, rng.randint(0, 5)))
    big = [word() for _ in range(150)]
    texts += [edit(rng, big, rng.randint(0, 3)) for _ in range(90)]       # a large group of near copies
    pairs = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    pairs += [(10_000 + i, pairs[200][1]) for i in range(30)]             # exact copies of one of them
    pairs += [(20_000, None), (20_001, ""), (20_002, "  "), (20_003, "two words"), (20_004, "two  words"), (None, pairs[130][1]),
              (None, "no id here at all really"), (3, pairs[1][1]), (20_005, "a " * 30_000), (20_006, "a " * 29_000)]
    return pairs


@pytest.mark.parametrize("dense,block", [(4, 256), (2, 16), (1000, 256)])
def test_matches_brute_force(make_docs, monkeypatch, dense, block):
    monkeypatch.setattr(nj, "DENSE", dense)
    monkeypatch.setattr(nj, "BLOCK", block)
    pairs = corpus()
    got = nj.similarity_classes(make_docs(pairs, extra=True)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_linked_texts, r.n_copies) for r in got) == brute(pairs)


def test_salted_keys_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(nj, "SAMPLE", 1)
    pairs = corpus(2)
    got = nj.similarity_classes(make_docs(pairs)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_linked_texts, r.n_copies) for r in got) == brute(pairs)


def test_pruning_keeps_pairs_at_the_threshold():
    least = nj.least_matches()
    assert list(least) == sorted(least) and 70 < least[-1] < 102
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 16, (4000, nj.SIGNATURE)).astype(np.uint16)
    right = np.where(rng.random(left.shape) < .8, left, left + 1).astype(np.uint16)
    assert len(nj.survivors(left, right)) >= 3999
    far = np.where(rng.random(left.shape) < .3, left, left + 1).astype(np.uint16)
    assert len(nj.survivors(left, far)) == 0


def test_block_links_equal_pairwise():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(230, 300), replace=False), rng.integers(0, 1 << 60, 20).astype(np.uint64)]))
            for _ in range(40)]
    marks = np.stack([nj.signature(nj.minhash(s, nj.SIGNATURE)) for s in sets])
    got = nj.block_links(sets, marks, np.arange(20), np.arange(20, 40))
    want = np.array([[nj.jaccard(sets[i], sets[j]) >= .8 for j in range(20, 40)] for i in range(20)])
    assert (got == want).all() and want.any() and not want.all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert {x: got.get(x, x) for x in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_and_empty(make_docs):
    pairs = corpus()
    classes = {}
    for row in brute(pairs):
        classes.setdefault(row[1] if row[0] not in ("20000", "20001", "20002") else row[0], []).append(row[0])
    kept = nj.keep_one(make_docs(pairs))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(classes)
    assert nj.similarity_classes(make_docs([])).count() == 0
    assert nj.keep_one(make_docs([]).withColumn("rep", F.lit(1))).count() == 0


def test_null_ids_link_like_distinct_ids(make_docs):
    rng = random.Random(12)
    texts = []
    for _ in range(250):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words[:-1] + ["changed"])]
    def shape(ids):
        rows = nj.similarity_classes(make_docs(list(zip(ids, texts)))).collect()
        return sorted((r.n_links, r.n_linked_texts, r.n_copies) for r in rows)
    assert shape([None] * len(texts)) == shape(range(len(texts)))
    assert shape([3] * len(texts)) == shape(range(len(texts)))


def test_all_columns_of_the_input_stay(make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "")], extra=True)
    out = nj.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
