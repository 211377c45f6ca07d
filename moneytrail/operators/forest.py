"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Each tree sees its own small random sample, drawn in one pass over the data and grown in one group per tree.
Scoring is a map over the table with the finished trees, whose size does not depend on the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.operators.trees import level_steps
from moneytrail.session import stable

TREE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"


def average_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` values."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            p = list(nodes[parent])
            p[4 if is_right else 3] = me
            nodes[parent] = tuple(p)
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((me, -1, 0.0, -1, -1, len(rows)))
            continue
        f = int(rng.choice(spread))
        low, high = part[:, f].min(), part[:, f].max()
        cut = float(rng.uniform(low, high))
        nodes.append((me, f, cut, -1, -1, len(rows)))
        goes_left = part[:, f] <= cut
        todo.append((rows[goes_left], depth + 1, me, False))
        todo.append((rows[~goes_left], depth + 1, me, True))
    return nodes


def fit_isolation_forest(df: DataFrame, columns: list[str], trees: int = 150, sample: int = 256,
                         seed: int = 42) -> DataFrame:
    """Node table of the forest.

    A row joins tree ``t`` when a hash of its id and ``t`` falls under a rate that yields about twice the sample;
    the smallest hashes win, so the draw is repeatable and uniform without sorting the table.
    """
    total = df.count()
    rate = min(1.0, 2.0 * sample / max(1, total))
    width = min(sample, total)
    bound = int(rate * (2 ** 31))
    # rows times trees never leave the task: only the drawn ones get their values
    h = F.pmod(F.xxhash64("id", "_tree", F.lit(seed)), F.lit(2 ** 31))
    drawn = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("_tree")).where(h < bound).select(
        F.col("_tree").alias("tree"), h.alias("h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    limit = max(1, math.ceil(math.log2(max(2, width))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h").head(sample)
        tree = int(rows["tree"].iloc[0])
        nodes = _grow(np.stack(rows["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes],
                            columns=["tree", "node", "feature", "split", "left", "right", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def score_isolation_forest(df: DataFrame, forest: list, columns: list[str], sample: int = 256) -> DataFrame:
    """``id`` and ``raw_score`` (0 to 1, larger is more unusual); ``forest`` is the collected node table.

    150 trees of at most 511 nodes: a fixed size whatever the table holds.
    """
    by_tree: dict[int, list] = {}
    for n in forest:
        by_tree.setdefault(n["tree"], []).append(n)
    packed, norm = [], 2
    for nodes in by_tree.values():
        nodes = sorted(nodes, key=lambda n: n["node"])
        feature, split, left, right, size = (np.array([n[k] for n in nodes]) for k in ("feature", "split", "left", "right", "size"))
        norm = max(norm, int(size[0])) if packed else int(size[0])
        depth = np.zeros(len(nodes))
        for i in np.flatnonzero(feature >= 0):  # a node comes before its children
            depth[left[i]] = depth[right[i]] = depth[i] + 1
        depth += [average_depth(s) for s in size]
        packed.append((*level_steps(feature, split, left, right), depth))
    norm = average_depth(min(sample, norm)) or 1.0

    def score(batches):
        for batch in batches:
            x = batch[columns].to_numpy(dtype="float64")
            first, flat = np.arange(len(x)) * x.shape[1], x.ravel()
            depth = np.zeros(len(x))
            for feature, split, child, levels, depths in packed:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(levels):
                    at = child.take(2 * at + (flat.take(first + feature.take(at)) <= split.take(at)))
                depth += depths.take(at)
            yield pd.DataFrame({"id": batch["id"], "raw_score": 2.0 ** (-depth / len(packed) / norm)})

    return df.select("id", *columns).mapInPandas(score, "id long, raw_score double")


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 150, contamination: float = 0.08,
                     seed: int = 42) -> DataFrame:
    """``id`` and ``anomaly``: negative for about the ``contamination`` share of rows, lower is more unusual."""
    df = stable(df.select("id", *columns))
    nodes = fit_isolation_forest(df, columns, trees, seed=seed).collect()
    scored = stable(score_isolation_forest(df, nodes, columns))  # read for the cut and for the answer; walked once
    cut = scored.agg(F.percentile_approx("raw_score", 1 - contamination, 10_000)).first()[0]
    return scored.select("id", (F.lit(cut) - F.col("raw_score")).alias("anomaly"))
