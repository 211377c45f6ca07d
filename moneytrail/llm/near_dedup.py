"""SimHash near-duplicates by tiled exact comparison (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import byte_values, written
from moneytrail.llm.components import components

BITS = 64
TILE = 1024
#: Fingerprints of a panel, the unit that is sent to a task: two panels are half a megabyte.
PANEL = 32_768
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of every run of ``size`` words of the lower-cased text, of the whole sequence if it is shorter."""
    tokens = text.lower().split()
    if len(tokens) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)] if tokens else []
    joined, ends, at = b" ".join(tokens), [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1:])]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit majority vote per run of ``counts[i]`` hashes; a run of none gives zero.

    Every vote is summed in the byte lanes of a word, at most 255 hashes to a lane, and the lanes are added up per run.
    """
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    sizes = counts[full].astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    pieces = -(-sizes // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cuts = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for b in range(8):
            result[full] |= (2 * votes[:, b] > sizes).astype(np.uint64) << np.uint64(8 * b + k)
    return result


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash (as a signed long) of the word shingles of every whole text.

    A null text is empty; a text without words has fingerprint zero. A null id is kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingle_hashes(x, shingle, seed) for x in byte_values(batch.column(1))]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority_bits(flat, counts).view(np.int64))],
                                             ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def _quarters(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of every fingerprint."""
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Side:
    """A panel sorted by population counts, with the range of the counts in every tile."""

    def __init__(self, values: np.ndarray):
        quarters = _quarters(values)
        order = np.lexsort(quarters.T)
        self.values, quarters = values[order], quarters[order]
        self.starts = np.arange(0, len(values), TILE)
        self.low = np.minimum.reduceat(quarters, self.starts, axis=0)
        self.high = np.maximum.reduceat(quarters, self.starts, axis=0)


def linked_roots(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one or two panels and, for each, one it is connected with through links between the panels.

    Every pair of tiles is compared by exclusive-or and bit count, but for those whose population counts differ by more
    than the radius: a bit that differs changes the count of its quarter by one at most. Links are merged as they are
    found, so that the result has a row for each fingerprint and not for each pair.
    """
    left = _Side(a)
    right = left if b is None else _Side(b)
    nodes = left.values if b is None else np.concatenate([left.values, right.values])
    shift = 0 if b is None else len(left.values)
    root = np.arange(len(nodes))
    for i, s in enumerate(left.starts):
        gap = np.maximum(left.low[i] - right.high, 0) + np.maximum(right.low - left.high[i], 0)
        near = np.flatnonzero(gap.sum(axis=1) <= radius)
        for j in near if b is not None else near[near >= i]:
            t = right.starts[j]
            x = left.values[s:s + TILE, None] ^ right.values[None, t:t + TILE]
            u, v = np.nonzero(np.bitwise_count(x) <= radius)
            u, v = u + s, v + t + shift
            while True:
                ru, rv = root[u], root[v]
                apart = ru != rv
                if not apart.any():
                    break
                u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
                np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    return nodes, nodes[root]


def links(distinct: DataFrame, radius: int = 2, panel: int = PANEL) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints ``fp`` whose connected components are those of all links at
    ``radius`` or fewer differing bits.

    Fingerprints are dealt to panels by the population counts of their halves, and within equal counts by hash, so that
    no panel outgrows ``panel`` by more than chance. Only pairs of panels whose counts can be within the radius meet.
    """
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = distinct.select(high.alias("high"), (F.bit_count("fp") - high).alias("low"), "fp")
    #: at most 33 x 33 rows
    known = written(cells.groupBy("high", "low").agg(F.ceil(F.count("*") / panel).cast("int").alias("parts")), "cells")
    panels = (cells.join(F.broadcast(known), ["high", "low"])
              .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
              .groupBy("high", "low", "part").agg(F.collect_list("fp").alias("fps"))
              .withColumn("id", F.struct("high", "low", "part")))
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(low).alias("l")) for h in range(-radius, radius + 1)
                      for low in range(-radius, radius + 1) if abs(h) + abs(low) <= radius])
    near = (panels.select("id", "fps", F.explode(steps).alias("step"))
            .select("id", "fps", (F.col("id.high") + F.col("step.h")).alias("high"),
                    (F.col("id.low") + F.col("step.l")).alias("low"))
            .join(F.broadcast(known), ["high", "low"])
            .select("id", "fps", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
                F.col("high").cast("int").alias("high"), F.col("low").cast("int").alias("low"),
                p.alias("part")))).alias("other")))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"),
                        (F.col("id") <= F.col("other")).alias("first"), "fps")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first", ascending=False)
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in rows["fps"]]
        nodes, root = linked_roots(sides[0], sides[1] if len(sides) > 1 else None, radius)
        found = nodes != root
        return pd.DataFrame({"u": nodes[found].view(np.int64), "v": root[found].view(np.int64)})

    return pairs.groupBy("a", "b").applyInPandas(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3,
                    seed: int = 42) -> DataFrame:
    """``(id, fp, component)`` for every row: component is the least id that links of at most ``radius`` differing
    fingerprint bits can reach, the row itself included.

    Equal fingerprints are compared once. Rows with a null id take part in the links and get the component, they never
    give it its name (null if there is no other). Repeated ids give a row each; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    root = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "rooted")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(named.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")
