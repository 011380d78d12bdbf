"""Isolation trees on a fraction of all rows, built level by level.

Every tree sees ``samples`` of the rows, so no tree fits one task.  All trees grow together instead: one pass over the
rows per level reports, per open node, how many of its rows there are and the least and greatest value of every feature;
the passes' partial results are combined by an ordinary aggregate, and the bounded node table (trees x 2^depth) is
extended on the driver.  Rows are never shuffled and never grouped by tree, so no key can be hot; a task holds one batch
and one accumulator of trees x 2^level x features.

Whether a row belongs to a tree is drawn from its key alone (``draw``), by arithmetic that SQL can repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the draw: a Mersenne prime and the hexadecimal digits taken from md5 texts.
PRIME, DIGITS = 2 ** 31 - 1, 7

#: Deepest level of trees grown on a fraction.  Rows below an uncut node count by their expected further depth, as at
#: any depth limit; the node table stays below trees x 2^(MAX_DEPTH + 1).
MAX_DEPTH = 8


def key_halves(key: Column) -> list[Column]:
    """Two 28-bit numbers from the md5 of a key."""
    digest = F.md5(key.cast("string"))
    return [F.conv(F.substring(digest, 1 + i * DIGITS, DIGITS), 16, 10).cast("long") for i in range(2)]


def coefficients(seed: int, trees: int) -> np.ndarray:
    """[trees, 3] numbers per tree, from md5 texts ``seed:tree:place``."""
    return np.array([[int(hashlib.md5(f"{seed}:{t}:{j}".encode()).hexdigest()[:DIGITS], 16) for j in range(3)]
                     for t in range(trees)], dtype=np.int64)


def draw(first: np.ndarray, second: np.ndarray, coefficient: np.ndarray) -> np.ndarray:
    """One number below PRIME per row for one tree: pairwise independent over trees and rows."""
    a, b, c = coefficient
    return (first * a + second * b + c) % PRIME


def limit_of(samples: float) -> int:
    """A row is in a tree when its draw is below this."""
    return min(PRIME, int(round(samples * PRIME)))


class Forest:
    """Growing node arrays of all trees; node 0 is the root, children are appended in pairs."""

    def __init__(self, trees: int):
        self.feature = [[-1] for _ in range(trees)]
        self.threshold = [[0.0] for _ in range(trees)]
        self.left = [[-1] for _ in range(trees)]
        self.right = [[-1] for _ in range(trees)]
        self.depth = [[0] for _ in range(trees)]
        self.size = [[0] for _ in range(trees)]
        self.open = [[0] for _ in range(trees)]

    def arrays(self):
        """Per tree (feature, threshold, left, right, place of open nodes or -1)."""
        out = []
        for t in range(len(self.feature)):
            place = np.full(len(self.feature[t]), -1, dtype=np.int64)
            place[self.open[t]] = np.arange(len(self.open[t]))
            out.append((np.array(self.feature[t]), np.array(self.threshold[t]), np.array(self.left[t]),
                        np.array(self.right[t]), place))
        return out

    def split(self, tree: int, node: int, feature: int, threshold: float) -> list[int]:
        children = [len(self.feature[tree]), len(self.feature[tree]) + 1]
        self.feature[tree][node], self.threshold[tree][node] = feature, threshold
        self.left[tree][node], self.right[tree][node] = children
        for _ in children:
            self.feature[tree].append(-1)
            self.threshold[tree].append(0.0)
            self.left[tree].append(-1)
            self.right[tree].append(-1)
            self.size[tree].append(0)
            self.depth[tree].append(self.depth[tree][node] + 1)
        return children


def descend(x: np.ndarray, feature, threshold, left, right, rows: np.ndarray | None = None) -> np.ndarray:
    """Node where each row of ``x`` (or of ``x[rows]``) stands."""
    n = len(x) if rows is None else len(rows)
    node = np.zeros(n, dtype=np.int64)
    if not n or feature[0] < 0:
        return node
    flat, start = np.ascontiguousarray(x).ravel(), (np.arange(n) if rows is None else rows) * x.shape[1]
    here = np.arange(len(feature))
    leaf = feature < 0                                    # a leaf leads to itself
    at, lower, upper = np.where(leaf, 0, feature), np.where(leaf, here, left), np.where(leaf, here, right)
    while True:
        following = np.where(flat[start + at[node]] < threshold[node], lower[node], upper[node])
        if leaf[following].all():
            return following
        node = following


#: Rows coded together; their ranks fit 16 bits.
CODED_ROWS = 16384


def remainder(x: np.ndarray) -> np.ndarray:
    """x % PRIME for 0 <= x < 2^60, without a division."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def rank_codes(x: np.ndarray, thresholds: list[np.ndarray]):
    """Per column of ``x`` its distinct values in order, 16-bit codes (place among them, 1 the least; missing: above all
    others) and the codes of ``thresholds``: a row's code is below a threshold's exactly where its value is."""
    codes = np.empty(x.shape[::-1], dtype=np.uint16)
    known, cuts = [], []
    for f, cut in enumerate(thresholds):
        values, place = np.unique(x[:, f], return_inverse=True)         # missing values sort last
        values = values[:len(values) - np.isnan(values).any()]
        codes[f] = place + 1
        known.append(values)
        cuts.append((np.searchsorted(values, cut) + 1).astype(np.uint16))
    return codes, known, cuts


def _pass(width: int, columns: list[str], plan, with_ranges: bool):
    """mapInPandas function: per (tree, place) rows, and least and greatest value per feature, of a whole partition."""
    def run(batches):
        trees, coefficient, limits, allowed = plan.value
        count = np.zeros((len(trees), width), dtype=np.int64)
        low = np.full((len(trees), len(columns), width), np.inf)
        high = -low
        narrow = np.uint8 if width < 2 ** 8 else np.uint16 if width < 2 ** 16 else np.int64
        features = np.concatenate([feature for feature, *_ in trees])
        cut = np.concatenate([threshold for _, threshold, *_ in trees])
        tree_start = np.cumsum([0] + [len(feature) for feature, *_ in trees])
        own = [np.flatnonzero(features == f) for f in range(len(columns))]
        shapes = [steps_of(feature, left, right) for feature, _, left, right, _ in trees]
        for whole in batches:
            every = whole[columns].to_numpy(dtype=float)
            firsts, seconds = whole["_first"].to_numpy(np.int64), whole["_second"].to_numpy(np.int64)
            for begin in range(0, len(every), CODED_ROWS):
                x = every[begin:begin + CODED_ROWS]
                first, second = firsts[begin:begin + CODED_ROWS], seconds[begin:begin + CODED_ROWS]
                codes, known, cuts = rank_codes(x, [cut[o] for o in own])
                coded = np.zeros(len(cut), dtype=np.uint16)
                for o, c in zip(own, cuts):
                    coded[o] = c
                flat, rows = np.ascontiguousarray(codes).ravel(), np.arange(len(x))
                gaps = [bool(np.isnan(x[:, f]).any()) for f in range(len(columns))]
                for t, (_, _, _, _, place) in enumerate(trees):
                    a, b, c = coefficient[t]
                    drawn = remainder(first * a + second * b + c) < limits[t]
                    at = np.where(drawn, place.take(walk(flat, rows, coded[tree_start[t]:tree_start[t + 1]], *shapes[t])), -1)
                    at = np.where(at < 0, width, at)                      # last place: rows that take no part
                    n = np.bincount(at, minlength=width + 1)[:width]
                    count[t] += n
                    if not with_ranges or not n.any():
                        continue
                    order = np.argsort(at.astype(narrow), kind="stable")[:n.sum()]
                    found = np.flatnonzero(n)
                    start = np.cumsum(n[found]) - n[found]
                    for f in allowed[t]:
                        held, values = codes[f].take(order), known[f]
                        if not len(values):
                            continue
                        least = np.minimum.reduceat(held, start)
                        most = np.maximum.reduceat(np.where(held > len(values), 0, held) if gaps[f] else held, start)
                        some = most > 0                                    # else: all values are missing
                        nodes = found[some]
                        low[t, f, nodes] = np.minimum(low[t, f, nodes], values[least[some].astype(np.int64) - 1])
                        high[t, f, nodes] = np.maximum(high[t, f, nodes], values[most[some].astype(np.int64) - 1])
        tree, at = np.nonzero(count)
        yield pd.DataFrame({"tree": tree, "place": at, "rows": count[tree, at],
                            **{f"lo{j}": low[tree, j, at] for j in range(len(columns))},
                            **{f"hi{j}": high[tree, j, at] for j in range(len(columns))}})
    return run


def steps_of(feature: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(feature per node, children per node [left, right], number of steps from the root to the deepest leaf); a leaf leads to
    itself."""
    leaf, here = feature < 0, np.arange(len(feature))
    at, children = np.where(leaf, 0, feature), np.stack([np.where(leaf, here, left), np.where(leaf, here, right)], axis=1)
    steps, level = 0, np.array([0])
    while True:
        level = level[~leaf[level]]
        if not len(level):
            return at, children.ravel(), steps
        level, steps = children[level].ravel(), steps + 1


def walk(flat: np.ndarray, rows: np.ndarray, threshold: np.ndarray, at: np.ndarray, children: np.ndarray, steps: int) -> np.ndarray:
    """Node where each row stands; ``flat`` holds the columns one after the other."""
    node = np.zeros(len(rows), dtype=np.int64)
    base = at * len(rows)
    for _ in range(steps):
        here = base.take(node)
        here += rows
        goes_right = flat.take(here) >= threshold.take(node)
        node += node
        node += goes_right
        node = children.take(node)
    return node


def uniform(seed: int, tree_seed: np.ndarray, node: np.ndarray, use: int) -> np.ndarray:
    """A number in [0, 1) per (tree, node, use), by mixing 64-bit integers."""
    x = tree_seed.astype(np.uint64) * np.uint64(1 << 32) + node.astype(np.uint64) * np.uint64(4) + np.uint64(use)
    x ^= np.uint64((seed * 0x9E3779B97F4A7C15) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53


def choose_splits(low, high, allowed, seed, tree_seed, node):
    """(feature or -1, threshold) per open node: one of its varying features, a value above the least one."""
    varies = allowed & (high > low)
    n = varies.sum(axis=1)
    pick = np.floor(uniform(seed, tree_seed, node, 0) * n).astype(int)
    feature = np.argmax(np.cumsum(varies, axis=1) > pick[:, None], axis=1)
    rows = np.arange(len(feature))
    with np.errstate(invalid="ignore"):
        lo, hi = low[rows, feature], high[rows, feature]
        cut = np.maximum(hi - (hi - lo) * uniform(seed, tree_seed, node, 1), np.nextafter(lo, np.inf))
    return np.where(n > 0, feature, -1), cut              # the cut is above lo and not above hi: both sides keep a row


def _level(rows: DataFrame, columns: list[str], forest: Forest, coefficient, limits, allowed, with_ranges: bool) -> pd.DataFrame:
    width = max(max(len(o) for o in forest.open), 1)
    plan = rows.sparkSession.sparkContext.broadcast((forest.arrays(), coefficient, limits, allowed))
    n = len(columns)
    schema = "tree int, place int, rows long, " + ", ".join(f"lo{j} double" for j in range(n)) + ", " + \
             ", ".join(f"hi{j} double" for j in range(n))
    part = rows.mapInPandas(_pass(width, columns, plan, with_ranges), schema)
    ranges = [F.min(f"lo{j}").alias(f"lo{j}") for j in range(n)] + [F.max(f"hi{j}").alias(f"hi{j}") for j in range(n)]
    whole = part.groupBy("tree", "place").agg(F.sum("rows").alias("rows"), *(ranges if with_ranges else []))
    got = whole.toPandas().sort_values(["tree", "place"])            # at most trees x 2^level rows
    plan.unpersist()
    return got


def grow(rows: DataFrame, columns: list[str], trees: int, samples, max_features, seed: int, max_depth,
         tree_seeds=None) -> pd.DataFrame:
    """Node table of ``trees`` isolation trees over ``rows`` (columns, _first, _second).

    ``samples``, ``max_features`` and ``max_depth`` are one value or one per tree, so that several forests can grow in
    the same passes; ``tree_seeds`` (default 0, 1, ...) number the trees within their forest."""
    samples, max_features, max_depth = (np.broadcast_to(np.asarray(v), trees) for v in (samples, max_features, max_depth))
    tree_seeds = np.arange(trees) if tree_seeds is None else np.asarray(tree_seeds)
    coefficient = coefficients(seed, int(tree_seeds.max()) + 1)[tree_seeds]
    limits = np.array([limit_of(float(s)) for s in samples])
    forest, n = Forest(trees), len(columns)
    allowed = []
    for t in range(trees):
        k = max(1, int(round(float(max_features[t]) * n)))
        allowed.append(np.sort(np.random.default_rng([seed, int(tree_seeds[t])]).choice(n, size=k, replace=False)))
    mask = np.array([np.isin(np.arange(n), features) for features in allowed])
    for depth in range(int(max_depth.max()) + 1):
        splitting = depth < int(max_depth.max())
        got = _level(rows, columns, forest, coefficient, limits, allowed, splitting)
        tree, place, size = (got[c].to_numpy() for c in ("tree", "place", "rows"))
        node = np.array([forest.open[t][i] for t, i in zip(tree, place)], dtype=np.int64)
        for t, i, rows_there in zip(tree.tolist(), node.tolist(), size.tolist()):
            forest.size[t][i] = rows_there
        following = [[] for _ in range(trees)]
        if splitting and len(got):
            low, high = (got[[f"{side}{j}" for j in range(n)]].to_numpy() for side in ("lo", "hi"))
            feature, cut = choose_splits(low, high, mask[tree], seed, tree_seeds[tree], node)
            feature = np.where((depth < max_depth[tree]) & (size > 1), feature, -1)
            for t, i, f, c in zip(tree.tolist(), node.tolist(), feature.tolist(), cut.tolist()):
                if f >= 0:
                    following[t] += forest.split(t, i, f, c)
        forest.open = following
        if not any(following):
            break
    return table(forest)


def table(forest: Forest) -> pd.DataFrame:
    """Nodes with the expected path length below each (``value``), children before parents."""
    from riskloom.operators.forest import c_factor
    parts = []
    for t in range(len(forest.feature)):
        size, depth = np.array(forest.size[t], dtype=np.int64), np.array(forest.depth[t])
        left, right = np.array(forest.left[t]), np.array(forest.right[t])
        value = depth + c_factor(size)
        for node in range(len(size) - 1, -1, -1):
            if left[node] >= 0:
                a, b = size[left[node]], size[right[node]]
                value[node] = (a * value[left[node]] + b * value[right[node]]) / max(a + b, 1)
        parts.append(pd.DataFrame({"tree": t, "node": np.arange(len(size)), "feature": forest.feature[t],
                                   "threshold": forest.threshold[t], "left": left, "right": right, "size": size,
                                   "depth": depth, "value": value}))
    return pd.concat(parts, ignore_index=True)


def depth_of(rows_per_tree: float, max_depth: int = MAX_DEPTH) -> int:
    """Depth limit of a tree on so many rows: the height of a balanced tree, at most ``max_depth``."""
    return min(max_depth, max(1, math.ceil(math.log2(max(rows_per_tree, 2)))))
