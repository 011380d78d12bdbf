"""Shapley values against all coalitions; forests on a share of the rows against plain Python."""
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import forest as FO
from riskloom.operators import levels, shapley


def random_tree(rng, n_features, depth):
    feature, threshold, left, right, size, value = [], [], [], [], [], []

    def grow(n, level):
        i = len(feature)
        for part, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (size, n), (value, float(rng.normal()))):
            part.append(v)
        if level < depth and n > 1 and rng.random() < 0.9:
            share = int(rng.integers(0, n + 1)) if rng.random() < 0.1 else int(rng.integers(1, n))     # empty sides too
            feature[i], threshold[i] = int(rng.integers(n_features)), float(rng.normal())
            left[i], right[i] = grow(share, level + 1), grow(n - share, level + 1)
        return i

    grow(200, 0)
    return [np.array(a) for a in (feature, threshold, left, right, size, value)]


@pytest.mark.parametrize("n_features,depth,table_bits", [(1, 3, 9), (4, 5, 9), (6, 7, 9), (6, 7, 2), (7, 6, 0)])
def test_values_equal_all_coalitions(monkeypatch, n_features, depth, table_bits):
    monkeypatch.setattr(shapley, "TABLE_BITS", table_bits)
    rng = np.random.default_rng(n_features * 10 + depth)
    for _ in range(5):
        tree = random_tree(rng, n_features, depth)
        x = rng.normal(size=(4, n_features))
        x[0, 0] = np.nan                                              # a missing value goes right
        out = np.zeros((n_features, 4))
        shapley.add_tree(x, *tree, out)
        for i in range(4):
            np.testing.assert_allclose(out[:, i], shapley.brute_force(x[i], *tree, n_features), atol=1e-12)


@pytest.mark.parametrize("n_features,depth,bits", [(3, 7, 12), (5, 8, 12), (5, 8, 3), (9, 8, 12)])
def test_subtree_tables_equal_path_integrals(monkeypatch, n_features, depth, bits):
    monkeypatch.setattr(shapley, "ENTRY_BITS", bits)
    monkeypatch.setattr(shapley, "ROWS_AT_ONCE", 64)
    rng = np.random.default_rng(n_features)
    for _ in range(3):
        tree = random_tree(rng, n_features, depth)
        x = rng.normal(size=(150, n_features))
        got, exp = np.zeros((n_features, 150)), np.zeros((n_features, 150))
        shapley.add_tree(x, *tree, got)
        feature, threshold, left, right, size, value = tree
        shapley._add_tree_by_paths(x, feature, threshold, left, right, shapley.leaves_of(feature, left, right, size), value, exp)
        np.testing.assert_allclose(got, exp, atol=1e-12)


def test_batches_are_joined_for_attributions():
    parts = [pd.DataFrame({"a": range(i, i + 10)}) for i in range(0, 50, 10)]
    assert [len(p) for p in FO.gathered(parts, 20)] == [20, 20, 10]
    assert pd.concat(FO.gathered(parts, 20))["a"].tolist() == list(range(50))


def test_draws_and_rank_codes_are_exact():
    x = np.concatenate([np.random.default_rng(3).integers(0, 1 << 59, 1000), [0, levels.PRIME - 1, levels.PRIME, 2 * levels.PRIME]])
    assert (levels.remainder(x) == x % levels.PRIME).all()
    values = np.array([[2.0, np.nan], [-1.0, np.nan], [np.nan, np.nan], [2.0, np.nan], [0.5, np.nan]])
    cut = np.array([-1.0, 0.0, 2.0, 5.0])
    codes, known, cuts = levels.rank_codes(values, [cut, cut])
    for f in (0, 1):
        assert ((codes[f][:, None] < cuts[f]) == (values[:, f, None] < cut)).all()
    assert known[0].tolist() == [-1.0, 0.5, 2.0] and not len(known[1])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"id": [f"T{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float),
                        "c": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)), "flat": 1.0})
    pdf.loc[0, "a"] = 40.0
    return spark.createDataFrame(pdf), pdf


COLS = ["a", "b", "c", "flat"]


def test_fitted_forest_against_all_coalitions(rows):
    df, _ = rows
    model = FO.fit_forest(df, COLS, "id", n_trees=6, psi=0.6, seed=3, scale=False, max_depth=4)
    scored = FO.score_forest(df.limit(12), model, attributions=True).toPandas()
    trees = FO._pack(model["nodes"].toPandas(), 6)
    for _, r in scored.iterrows():
        want = -sum(shapley.brute_force(r[COLS].to_numpy(dtype=float), *t, 4) for t in trees) / 6
        np.testing.assert_allclose(r["attributions"], want, atol=1e-12)
        assert r["attributions"][3] == 0.0                            # the constant column is a dummy


def drawn(ids, seed, tree, samples):
    out = []
    for key in ids:
        digest = hashlib.md5(key.encode()).hexdigest()
        a, b, c = (int(hashlib.md5(f"{seed}:{tree}:{j}".encode()).hexdigest()[:7], 16) for j in range(3))
        out.append((int(digest[:7], 16) * a + int(digest[7:14], 16) * b + c) % (2 ** 31 - 1) < round(samples * (2 ** 31 - 1)))
    return np.array(out)


@pytest.mark.parametrize("samples,depth", [(0.5, 5), (0.884, 8), (1.0, 3)])
def test_level_trees_partition_their_rows(rows, samples, depth):
    """Every node's size and range is what walking its rows gives; both sides of a split keep a row."""
    df, pdf = rows
    model = FO.fit_forest(df, COLS, "id", n_trees=5, psi=samples, seed=11, scale=False, max_depth=depth, max_features=0.75)
    nodes = model["nodes"].toPandas()
    x = pdf[COLS].to_numpy()
    for tree, g in nodes.sort_values("node").groupby("tree"):
        feature, threshold, left, right, size = (g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size"))
        mine = x[drawn(pdf["id"], 11, tree, samples)]
        assert size[0] == len(mine) and g["depth"].max() <= depth
        at = levels.descend(mine, feature, threshold, left, right)
        counts = np.bincount(at, minlength=len(g))
        for node in range(len(g)):
            if feature[node] < 0:
                assert counts[node] == size[node]
            else:
                assert size[node] == size[left[node]] + size[right[node]] and min(size[left[node]], size[right[node]]) > 0
        assert set(feature[feature >= 0]) <= {0, 1, 2} and len(set(feature[feature >= 0])) <= 3
    share = nodes[nodes["node"] == 0]["size"].sum() / 5 / len(pdf)
    assert abs(share - samples) < 0.06


def test_level_forest_does_not_depend_on_partitions_and_finds_the_outlier(rows):
    df, _ = rows
    a = FO.fit_forest(df, COLS, "id", n_trees=30, psi=0.7, seed=5)
    b = FO.fit_forest(df.repartition(9), COLS, "id", n_trees=30, psi=0.7, seed=5)
    pd.testing.assert_frame_equal(a["nodes"].orderBy("tree", "node").toPandas().round(9),
                                  b["nodes"].orderBy("tree", "node").toPandas().round(9))
    top = FO.score_batch(df, a).orderBy(F.desc("risk_score")).first()
    assert top["id"] == "T0" and top["risk_score"] == 1.0


def test_empty_table_and_one_row(spark, rows):
    df, _ = rows
    for d in (df.limit(0), df.limit(1)):
        model = FO.fit_forest(d, COLS, "id", n_trees=3, psi=0.9)
        assert model["nodes"].where("feature >= 0").count() == 0
        assert FO.score_forest(df.limit(5), model, attributions=True).count() == 5


def test_forests_growing_together_equal_forests_growing_alone(rows):
    df, _ = rows
    first, second = levels.key_halves(F.col("id"))
    table = df.select(*COLS, first.alias("_first"), second.alias("_second"))
    both = levels.grow(table, COLS, 4, [0.5, 0.9, 0.5, 0.9], 1.0, 2, [3, 6, 3, 6], [0, 1000, 1, 1001])
    one = levels.grow(table, COLS, 2, 0.9, 1.0, 2, 6, [1000, 1001])
    together = both[both["tree"].isin([1, 3])].drop(columns="tree").reset_index(drop=True)
    pd.testing.assert_frame_equal(together, one.drop(columns="tree"))
