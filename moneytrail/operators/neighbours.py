"""Exact nearest neighbours within classes, in bounded blocks of rows that lie close together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.session import stable

MOST_CELLS = 2048
SAMPLE_PER_CELL = 64
ASKS = 32_768
NO_ID = 2 ** 63 - 1


def k_least(values: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` least of every row, the first ones of equals; without sorting rows that have no such equals."""
    if values.shape[1] <= k:
        return np.ones(values.shape, bool)
    least = values <= np.partition(values, k - 1, axis=1)[:, k - 1:k]
    for i in np.flatnonzero(least.sum(axis=1) > k):
        at = np.flatnonzero(least[i])
        least[i, at[np.argsort(values[i, at], kind="stable")[k:]]] = False
    return least


def cut_cells(x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(feature, cut, child)`` of a tree that halves the sample ``x`` by its widest feature until there are ``cells`` parts.

    Values up to the cut go to ``child[2 * node + 1]``, others to ``child[2 * node]``; a cell has feature -1 and its number as
    its cut.
    """
    feature, cut, child = [-1], [0.0], [0, 0]
    parts = [(len(x), 0, np.arange(len(x)))]
    done = []
    while parts and len(parts) + len(done) < cells:
        parts.sort(key=lambda p: p[0])
        _, node, rows = parts.pop()
        part = x[rows]
        wide = int(np.argmax(part.std(axis=0))) if len(rows) > 1 else 0
        values = part[:, wide]
        if len(rows) < 2 or values.min() == values.max():
            done.append(node)
            continue
        at = np.median(values)
        at = float(at if at < values.max() else values[values < values.max()].max())
        feature[node], cut[node] = wide, at
        for side, low in ((0, False), (1, True)):
            child[2 * node + side] = len(feature)
            mine = rows[(values <= at) == low]
            parts.append((len(mine), len(feature), mine))
            feature.append(-1)
            cut.append(0.0)
            child += [0, 0]
    for number, node in enumerate([*done, *[p[1] for p in parts]]):
        cut[node] = float(number)
    return np.array(feature), np.array(cut), np.array(child)


def cell_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    feature, cut, child = tree
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        split = feature[at]
        open_ = split >= 0
        if not open_.any():
            return cut[at].astype(np.int64)
        low = x[rows, np.maximum(split, 0)] <= cut[at]
        at = np.where(open_, child[2 * at + low], at)


def _distances(x: np.ndarray, own: np.ndarray, others: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> np.ndarray:
    dist = np.maximum((x * x).sum(1)[:, None] + squares - 2 * x @ others.T, 0)
    dist[own[:, None] == ids[None, :]] = np.inf
    return dist


def _per_row(found: np.ndarray, dist: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[list, list, list]:
    i, j = np.nonzero(found)
    ends = np.cumsum(np.bincount(i, minlength=len(found)))[:-1]
    return tuple(np.split(v, ends) for v in (dist[i, j], ids[j], keys[j]))


def _by_cell(df: DataFrame, columns: list[str], block_rows: int) -> tuple[DataFrame, list]:
    """Rows with the cell they lie in, and every cell with its class, rows and box.

    A sample of some rows a cell decides where classes are cut, and nothing else.
    """
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select("label", F.coalesce("id", F.lit(NO_ID)).alias("id"), *values)
    names = [f"x{i}" for i in range(len(columns))]
    for c in names:  # what has no distance has no neighbours
        rows = rows.where(F.abs(c) < float("inf"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = {c: min(MOST_CELLS, math.ceil(n / block_rows)) for c, n in sizes.items() if c is not None}
    share = {c: min(1.0, SAMPLE_PER_CELL * cells[c] / sizes[c]) if cells[c] > 1 else 0.0 for c in cells}
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2 ** 20)) < F.element_at(
        F.create_map(*[F.lit(v) for c, p in share.items() for v in (c, math.ceil(p * 2 ** 20))]), F.col("label"))
    sample = rows.where(F.col("label").isin([c for c in cells if cells[c] > 1])).where(drawn).toPandas() if max(
        cells.values(), default=0) > 1 else None
    trees, first = {}, 0
    for c in sorted(cells):
        mine = np.empty((0, len(names))) if sample is None else sample.loc[sample["label"] == c, names].to_numpy("float64")
        feature, cut, child = cut_cells(mine, cells[c])
        cut = np.where(feature < 0, cut + first, cut)
        trees[c], first = (feature, cut, child), first + int((feature < 0).sum())

    def place(batches):
        for batch in batches:
            x, cell = batch[names].to_numpy("float64"), np.zeros(len(batch), dtype=np.int64)
            for c in batch["label"].unique():
                at = np.flatnonzero(batch["label"] == c)
                cell[at] = cell_of(x[at], trees[c])
            yield batch.assign(cell=cell)

    kind = rows.schema["label"].dataType.simpleString()
    placed = stable(rows.where(F.col("label").isNotNull()).mapInPandas(
        place, f"label {kind}, id long, {', '.join(f'{c} double' for c in names)}, cell long"))
    boxes = placed.groupBy("label", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in names]).alias("low"),
        F.array(*[F.max(c) for c in names]).alias("high")).collect()  # at most MOST_CELLS a class
    return placed, sorted(boxes, key=lambda r: r["cell"])


def own_blocks(df: DataFrame, columns: list[str], k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``k`` nearest of their own block (``d``, ``n``, ``nk``), the distance of the last of them (``bound``) and
    the cells that begin no further away (``asked``); and the blocks of every cell."""
    placed, boxes = _by_cell(df, columns, block_rows)
    names = [f"x{i}" for i in range(len(columns))]
    kind = placed.schema["label"].dataType.simpleString()
    blocks = np.array([math.ceil(b["n"] / block_rows) for b in boxes], dtype=np.int64)
    begin = np.cumsum(blocks) - blocks
    low = np.array([b["low"] for b in boxes]).reshape(len(boxes), len(names))
    high = np.array([b["high"] for b in boxes]).reshape(len(boxes), len(names))
    numbers = np.array([b["cell"] for b in boxes], dtype=np.int64)
    labels = np.array([b["label"] for b in boxes], dtype=object)
    spark = placed.sparkSession
    spread = F.broadcast(spark.createDataFrame(  # one row per cell
        [(int(c), int(n), int(b)) for c, n, b in zip(numbers, blocks, begin)], "cell long, blocks long, begin long"))
    dealt = placed.join(spread, "cell").select(
        "label", "id", "cell", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"), *names)

    def inside(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable")
        x, ids, label, cell = block[names].to_numpy("float64"), block["id"].to_numpy(), block["label"].iloc[0], block["cell"].iloc[0]
        keys = (int(block["block"].iloc[0]) << 32) + np.arange(len(x))
        squares, out = (x * x).sum(1)[None, :], []
        near = np.flatnonzero(labels == label)
        # a distance is off by far less than this share of its terms
        spare, several = 1e-12, blocks[near] > 1
        for at in range(0, len(x), 256):
            part, own = x[at:at + 256], ids[at:at + 256]
            dist = _distances(part, own, x, ids, squares)
            found = k_least(dist, k) & np.isfinite(dist)
            bound = np.where(found.sum(axis=1) < k, np.inf, np.max(np.where(found, dist, 0), axis=1, initial=0))
            gap = np.zeros((len(part), len(near)))
            for f in range(x.shape[1]):
                v = part[:, f][:, None]
                gap += np.maximum(np.maximum(low[near, f] - v, v - high[near, f]), 0) ** 2
            with np.errstate(invalid="ignore"):
                most = bound + spare * ((part * part).sum(1) + bound)
            reach = (gap <= most[:, None]) & ((numbers[near] != cell) | several)
            d, n, nk = _per_row(found, dist, ids, keys)
            i, j = np.nonzero(reach)
            asked = np.split(numbers[near][j], np.cumsum(np.bincount(i, minlength=len(part)))[:-1])
            out.append(pd.DataFrame({"label": label, "id": own, "key": keys[at:at + 256], "block": block["block"].iloc[0],
                                     "x": list(part), "bound": bound, "d": d, "n": n, "nk": nk, "asked": asked}))
        return pd.concat(out)

    first = stable(dealt.groupBy("block").applyInPandas(
        inside, f"label {kind}, id long, key long, block long, x array<double>, bound double, d array<double>, n array<long>, "
                "nk array<long>, asked array<long>"))
    return first, spread


def neighbour_keys(df: DataFrame, columns: list[str], k: int, block_rows: int = 8192) -> tuple[DataFrame, DataFrame]:
    """``(label, id, near)``: the ``k`` nearest rows of the same class as structs ``(d, n, key)``, nearest first, of equally
    near ones those with the least ids; and ``(key, x)``: the values of every row.

    Exact. A class is cut into cells of rows that lie close together, a cell into blocks of about ``block_rows``. A row finds
    the ``k`` nearest of its own block first, then asks only the cells that begin no further away than the last of them, so it
    is copied as often as that and not to every block of its class.
    """
    first, spread = own_blocks(df, columns, k, block_rows)
    spark, kind = first.sparkSession, first.schema["label"].dataType.simpleString()
    asks = first.select("label", "id", "key", F.col("block").alias("home"), "x", "bound", F.explode("asked").alias("cell"))
    # one row per cell; as many slices as keep the rows that ask a block at once few
    load = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("slices")).join(spread, "cell")
    load = spark.createDataFrame(load.collect(), load.schema)
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    other = F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("blocks") - 1))
    asks = asks.join(F.broadcast(load), "cell").select(
        "label", F.col("id").alias("own"), F.col("x").alias("from"), "bound", "home", other.alias("block"),
        F.pmod(F.xxhash64("key"), F.col("slices")).alias("slice"))
    asks = asks.where("block <> home").drop("home")
    all_blocks = load.select(other.alias("block"), "slices")
    answers = first.select("block", "id", "key", "x").join(F.broadcast(all_blocks), "block").select(
        F.col("block").alias("to"), slices.alias("part"), "id", "key", "x")

    def across(asking: pd.DataFrame, answering: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: [] for c in ("label", "id", "d", "n", "nk")})
        if not len(asking) or not len(answering):
            return empty
        answering = answering.sort_values(["id", "key"])
        b, ids, keys = np.stack(answering["x"].to_numpy()), answering["id"].to_numpy(), answering["key"].to_numpy()
        squares, out = (b * b).sum(1)[None, :], [empty]
        for at in range(0, len(asking), 256):
            part = asking.iloc[at:at + 256]
            x, own, bound = np.stack(part["from"].to_numpy()), part["own"].to_numpy(), part["bound"].to_numpy("float64")
            dist = _distances(x, own, b, ids, squares)
            found = (dist <= bound[:, None]) & np.isfinite(dist)
            many = np.flatnonzero(found.sum(axis=1) > k)
            if len(many):
                found[many] &= k_least(dist[many], k)
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                d, n, nk = _per_row(found[some], dist[some], ids, keys)
                out.append(pd.DataFrame({"label": part["label"].to_numpy()[some], "id": own[some], "d": d, "n": n, "nk": nk}))
        return pd.concat(out)

    more = asks.groupBy("block", "slice").cogroup(answers.groupBy("to", "part")).applyInPandas(
        across, f"label {kind}, id long, d array<double>, n array<long>, nk array<long>")
    lists = first.select("label", "id", "d", "n", "nk").unionByName(more).select(
        "label", "id", F.arrays_zip("d", "n", F.col("nk").alias("key")).alias("near"))
    best = lists.groupBy("label", "id").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")).where(F.size("near") > 0)
    return best.withColumn("id", F.nullif("id", F.lit(NO_ID))), first.select("key", "x")


def nearest_neighbours(df: DataFrame, columns: list[str], k: int, block_rows: int = 8192) -> DataFrame:
    """``(label, id, neighbours)``: the ``k`` nearest rows of the same class, nearest first, with their values ``y``.

    Exact, see :func:`neighbour_keys`. Of equally near rows those with the least ids count.
    """
    best, values = neighbour_keys(df, columns, k, block_rows)
    long = best.select("label", "id", F.posexplode("near").alias("_rn", "near")).select(
        "label", "id", (F.col("_rn") + 1).alias("_rn"), F.nullif("near.n", F.lit(NO_ID)).alias("n"), "near.key")
    long = long.join(values.withColumnRenamed("x", "y"), "key")
    return long.groupBy("label", "id").agg(F.sort_array(F.collect_list(F.struct("_rn", "n", "y"))).alias("neighbours"))
