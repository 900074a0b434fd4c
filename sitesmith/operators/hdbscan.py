"""HDBSCAN over six shape and position features, a scan at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesmith.operators.graph import shared_table, small

#: The hierarchy of a scan needs n^2 distances (never a matrix); larger scans are refused rather than sampled.
MAX_POINTS = 200_000


def vectors(points: DataFrame, features: DataFrame, weight: float = 1.0) -> DataFrame:
    """scan_id, idx, v: position scaled to 0..1 by the scan's box (a range of at least 1e-10) times weight, then planarity, linearity, sphericity."""
    box = points.groupBy("scan_id").agg(*[f(d).alias(f"{n}{d}") for d in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    j = points.join(features.select("scan_id", "idx", "planarity", "linearity", "sphericity"), ["scan_id", "idx"]).join(small(shared_table(box, "boxes")), "scan_id")
    pos = [(F.col(d) - F.col(f"lo{d}")) / F.greatest(F.col(f"hi{d}") - F.col(f"lo{d}"), F.lit(1e-10)) * weight for d in "xyz"]
    return j.select("scan_id", "idx", F.array(*pos, "planarity", "linearity", "sphericity").alias("v"))


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty(len(x))
    for i, p in enumerate(x):
        d = ((x - p) ** 2).sum(axis=1)
        out[i] = np.partition(d, min(k, len(x) - 1))[min(k, len(x) - 1)]
    return np.sqrt(out)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Prim's tree of mutual reachability: rows (a, b, distance), one row of distances at a time."""
    n = len(x)
    best, via, out = np.full(n, np.inf), np.zeros(n, np.int64), np.empty((max(n - 1, 0), 3))
    done, at = np.zeros(n, bool), 0
    done[0] = True
    for i in range(n - 1):
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        closer = ~done & (d < best)
        best[closer], via[closer] = d[closer], at
        nxt = int(np.argmin(np.where(done, np.inf, best)))
        out[i] = via[nxt], nxt, best[nxt]
        done[nxt], at = True, nxt
    return out[np.argsort(out[:, 2], kind="stable")]


def labels(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Cluster number of each point, -1 for noise: the condensed tree's most stable clusters. Fewer points than min_cluster_size are noise."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    if n > MAX_POINTS:
        raise ValueError(f"hdbscan: {n} points in one scan; the limit is {MAX_POINTS}")
    k = min(max(min_samples, 1), n - 1)
    tree = spanning_tree(x, core_distances(x, k))
    # single linkage: node n + i joins the nodes of its edge's ends
    parent, node, kids, size, height = list(range(n)), list(range(n)), {}, [1] * n, [0.0] * n

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b, d in tree:
        a, b = root(int(a)), root(int(b))
        kids[len(size)] = (node[a], node[b])
        size.append(size[node[a]] + size[node[b]])
        height.append(d)
        parent[b], node[a] = a, len(size) - 1
    top = len(size) - 1

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v]
        return out

    births, stability, members, below = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo, fresh = [(top, 0)], 1
    while todo:
        v, c = todo.pop()
        if v < n:
            members[c].append(v)
            continue
        rate = 1.0 / max(height[v], 1e-12)
        big = [w for w in kids[v] if size[w] >= min_cluster_size]
        if len(big) == 2:
            stability[c] += (rate - births[c]) * size[v]
            for w in big:
                births[fresh], stability[fresh], members[fresh], below[fresh] = rate, 0.0, [], []
                below[c].append(fresh)
                todo.append((w, fresh))
                fresh += 1
        else:
            for w in kids[v]:
                if w in big:
                    todo.append((w, c))
                else:
                    stability[c] += (rate - births[c]) * size[w]
                    members[c] += leaves(w)
    chosen: dict[int, bool] = {}
    for c in range(fresh - 1, -1, -1):
        inner = sum(stability[s] for s in below[c])
        chosen[c] = c != 0 and (not below[c] or stability[c] >= inner)
        stability[c] = stability[c] if chosen[c] else inner
    out, number, todo = np.full(n, -1), 0, [(0, None)]
    while todo:
        c, inside = todo.pop()
        if inside is None and chosen[c]:
            inside, number = number, number + 1
        if inside is not None:
            out[members[c]] = inside
        todo += [(s, inside) for s in below[c]]
    return out


def hdbscan(vecs: DataFrame, min_cluster_size: int = 200, min_samples: int = 10) -> DataFrame:
    """(scan_id, idx, v) -> scan_id, idx, cluster_id (null for noise), numbered by smallest idx in a scan. A scan is one task's work."""
    kind = dict(vecs.dtypes)["scan_id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        got = labels(np.array(g["v"].tolist(), float).reshape(len(g), -1), min_cluster_size, min_samples)
        order = {c: i for i, c in enumerate(dict.fromkeys(c for c in got if c >= 0))}
        return pd.DataFrame({"scan_id": g["scan_id"], "idx": g["idx"], "cluster_id": pd.array([order.get(c) for c in got], dtype="Int32")})

    return vecs.groupBy("scan_id").applyInPandas(run, f"scan_id {kind}, idx long, cluster_id int")
