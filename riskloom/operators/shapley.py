"""Exact Shapley values of tree ensembles, path-dependent, vectorised over the rows of a batch.

The game of a tree and a row: a coalition of features follows the row at its own splits; at the splits of all other
features both branches are taken, weighted by the training rows that went there.  The value of a leaf with value ``v``
is then a product over the distinct features of its path: 1 or 0 for a member (the row meets all its conditions on the
path or not), the product of branch shares ``r`` for a feature outside.  Its Shapley value is

    v * (o_j - r_j) * integral over t in [0, 1] of  prod_{k != j} (t * o_k + (1 - t) * r_k),

because the integral of t^s (1 - t)^(m - 1 - s) is the Shapley weight s! (m - 1 - s)! / m!.  The integrand is a
polynomial of degree m - 1, so Gauss-Legendre quadrature with ceil(m / 2) nodes is exact: no sampling, no 2^m sums.

Per leaf the row enters only through the m bits ``o``.  Up to ``TABLE_BITS`` features on a path, the values of all 2^m
bit patterns are tabulated per leaf.  The leaves of a small subtree share one table, by the pattern met above the subtree
and the conditions met inside (``ENTRY_BITS`` bits together), so a row looks up one entry a subtree; the tables of a tree
are built once for all rows of a call, which should be many.  Longer paths are integrated row by row.
"""

from __future__ import annotations

import numpy as np

#: Paths with more distinct features than this are not tabulated (2^m patterns per leaf).
TABLE_BITS = 9
#: Bits that find the entry of a subtree's table: features of the tree and conditions inside the subtree.
ENTRY_BITS = 12
#: Rows that go through a tree together: their columns stay in the processor's cache.
ROWS_AT_ONCE = 8192


def _quadrature(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [0, 1], exact up to degree m - 1."""
    x, w = np.polynomial.legendre.leggauss(max(1, (m + 1) // 2))
    return (x + 1) / 2, w / 2


def _others(factors: np.ndarray) -> np.ndarray:
    """Along the last axis: product of all entries but one (no division: shares may be zero)."""
    left = np.ones_like(factors)
    right = np.ones_like(factors)
    left[..., 1:] = np.cumprod(factors[..., :-1], axis=-1)
    right[..., :-1] = np.cumprod(factors[..., :0:-1], axis=-1)[..., ::-1]
    return left * right


def leaf_values(met: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of single leaves.  ``met`` (0/1) and ``share`` broadcast to [..., m], ``value`` to [...]."""
    total = 0.0
    for t, w in zip(*_quadrature(share.shape[-1])):
        total = total + w * _others(t * met + (1 - t) * share)
    return value[..., None] * (met - share) * total


def leaves_of(feature: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray):
    """(leaf, features of its path in ascending order, their branch shares) of every leaf of one tree."""
    out, todo = [], [(0, {})]
    while todo:
        node, shares = todo.pop()
        f = feature[node]
        if f < 0:
            names = sorted(shares)
            out.append((node, names, [shares[n] for n in names]))
            continue
        for child in (left[node], right[node]):
            part = size[child] / size[node] if size[node] else 0.0
            todo.append((child, {**shares, f: shares.get(f, 1.0) * part}))
    return out


def _tables(leaves, value: np.ndarray) -> dict[int, np.ndarray]:
    """leaf -> array [2^m, m]: the leaf's Shapley values for every pattern of met features (bit k: k-th feature)."""
    by_length: dict[int, list] = {}
    for leaf, names, shares in leaves:
        if 0 < len(names) <= TABLE_BITS:
            by_length.setdefault(len(names), []).append((leaf, shares))
    out = {}
    for m, group in by_length.items():
        met = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
        share = np.array([s for _, s in group])
        at = np.array([leaf for leaf, _ in group])
        table = leaf_values(met[None], share[:, None, :], np.broadcast_to(value[at][:, None], (len(at), 1 << m)))
        out.update(zip(at.tolist(), table))
    return out


def _subtree(node: int, depth: int, feature, left, right):
    """Conditions (nodes) of the subtree of ``depth`` levels and its ends: [(leaf or deeper node, [(place of a condition, met)])]."""
    conditions, ends, todo = [], [], [(node, depth, [])]
    while todo:
        at, levels_left, path = todo.pop()
        if feature[at] < 0 or not levels_left:
            ends.append((at, path))
            continue
        place = len(conditions)
        conditions.append(at)
        todo.append((left[at], levels_left - 1, path + [(place, True)]))
        todo.append((right[at], levels_left - 1, path + [(place, False)]))
    return conditions, ends


def _heights(feature, left, right) -> np.ndarray:
    height = np.zeros(len(feature), dtype=np.int64)
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        order.append(node)
        if feature[node] >= 0:
            todo += [left[node], right[node]]
    for node in reversed(order):
        if feature[node] >= 0:
            height[node] = 1 + max(height[left[node]], height[right[node]])
    return height


def _entries(conditions, ends, feature, bit, wide) -> np.ndarray:
    """Table [2^features * 2^conditions, features] of a subtree: the sum over its leaves, by the features met above it
    (high bits) and the conditions met inside (low bits)."""
    m, c = len(bit), len(conditions)
    inside, above = np.arange(1 << c), np.arange(1 << m)
    out = np.zeros((1 << m, 1 << c, m))
    for leaf, path in ends:
        if leaf not in wide:
            continue
        open_bits = np.full(1 << c, (1 << m) - 1)
        for place, met in path:
            holds = ((inside >> place) & 1) == met
            open_bits &= np.where(holds, (1 << m) - 1, ((1 << m) - 1) ^ (1 << bit[feature[conditions[place]]]))
        out += wide[leaf].take(above[:, None] & open_bits[None, :], axis=0)
    return out.reshape(-1, m)


def add_tree(x: np.ndarray, feature, threshold, left, right, size, value, out: np.ndarray) -> None:
    """Adds one tree's Shapley values for the rows of ``x`` to ``out`` [features, rows]."""
    leaves = leaves_of(feature, left, right, size)
    used = sorted({n for _, names, _ in leaves for n in names})
    if not used:
        return
    if len(used) > TABLE_BITS:
        return _add_tree_by_paths(x, feature, threshold, left, right, leaves, value, out)
    m = len(used)
    wide, bit = _tables(leaves, value), {f: k for k, f in enumerate(used)}
    every, full = np.arange(1 << m), (1 << m) - 1
    for leaf, names, _ in leaves:                           # tables over all features of the tree
        if names:
            own = sum(((every >> bit[f]) & 1) << k for k, f in enumerate(names))
            table = np.zeros((len(every), m))
            table[:, [bit[f] for f in names]] = wide[leaf][own]
            wide[leaf] = table
    depth = max(d for d in range(1, 4) if (1 << d) - 1 + m <= max(ENTRY_BITS, m + 1))
    height = _heights(feature, left, right)
    subtrees, upper, todo = {}, [], [0]                      # subtrees of at most ``depth`` levels; the nodes above them, parents first
    while todo:
        node = todo.pop()
        if height[node] <= depth:
            conditions, ends = _subtree(node, depth, feature, left, right)
            subtrees[node] = (conditions, _entries(conditions, ends, feature, bit, wide))
        else:
            upper.append(node)
            todo += [left[node], right[node]]
    columns = {f: np.ascontiguousarray(x[:, f]) for f in used}
    for start in range(0, len(x), ROWS_AT_ONCE):
        rows = slice(start, min(start + ROWS_AT_ONCE, len(x)))
        part = {f: c[rows] for f, c in columns.items()}
        n = rows.stop - rows.start
        met = {0: np.full(n, full, dtype=np.uint16)}
        for node in upper:                                   # bit per feature: all its conditions so far are met
            f, here = feature[node], met.pop(node)
            goes_left, own = part[f] < threshold[node], np.uint16(1 << bit[f])
            without = here & np.uint16(full ^ (1 << bit[f]))
            kept = here & own
            met[left[node]] = without | (kept * goes_left)
            met[right[node]] = without | (kept * ~goes_left)
        total, entry = np.zeros((n, m)), np.empty((n, m))
        for node, (conditions, table) in subtrees.items():
            at = met[node].astype(np.int64) << len(conditions)
            if conditions:
                bits = np.zeros(n, dtype=np.uint8)
                for k, c in enumerate(conditions):
                    bits |= (part[feature[c]] < threshold[c]).view(np.uint8) << np.uint8(k)
                at |= bits
            table.take(at, axis=0, out=entry, mode="clip")
            total += entry
        for f, k in bit.items():
            out[f, rows] += total[:, k]


def _add_tree_by_paths(x, feature, threshold, left, right, leaves, value, out) -> None:
    """The same for trees with many features: bits per path, longest paths integrated row by row."""
    by_leaf = {leaf: (names, np.array(shares)) for leaf, names, shares in leaves}
    tables = _tables(leaves, value)
    n = x.shape[0]
    todo = [(0, {})]
    while todo:
        node, met = todo.pop()
        f = feature[node]
        if f >= 0:
            goes_left = x[:, f] < threshold[node]
            before = met.get(f)
            for child, goes in ((left[node], goes_left), (right[node], ~goes_left)):
                todo.append((child, {**met, f: goes if before is None else before & goes}))
            continue
        names, shares = by_leaf[node]
        if not names:
            continue
        if node in tables:
            pattern = np.zeros(n, dtype=np.uint16)
            for k, name in enumerate(names):
                pattern |= met[name].astype(np.uint16) << np.uint16(k)
            got = tables[node].take(pattern, axis=0)
        else:
            bits = np.stack([met[name] for name in names], axis=1).astype(float)
            got = leaf_values(bits, shares[None, :], np.full(n, value[node]))
        for k, name in enumerate(names):
            out[name] += got[:, k]


def brute_force(row, feature, threshold, left, right, size, value, n_features: int) -> np.ndarray:
    """Shapley values of one row from all coalitions: the definition, for small tests."""
    from itertools import combinations
    from math import factorial

    def worth(members, node=0):
        f = feature[node]
        if f < 0:
            return value[node]
        if f in members:
            return worth(members, left[node] if row[f] < threshold[node] else right[node])
        return sum(size[c] / size[node] * worth(members, c) for c in (left[node], right[node]))

    out = np.zeros(n_features)
    everyone = range(n_features)
    for j in everyone:
        rest = [k for k in everyone if k != j]
        for s in range(n_features):
            weight = factorial(s) * factorial(n_features - 1 - s) / factorial(n_features)
            for group in combinations(rest, s):
                out[j] += weight * (worth({*group, j}) - worth(set(group)))
    return out
