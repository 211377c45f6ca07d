"""Conflict-constrained best-fit packing of documents into sequences (operator 1)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import words, written
from moneytrail.llm.mixing import mix

#: Pieces packed together; more would fill bins hardly better.
SHARD = 4096
#: Documents of a source that a slot of the mixture has.
BLOCK = 4


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """(bin, start) of every piece, in the given order.

    Open bins stand in the order of what is left of them. Each has a bitmap of its duplicate clusters and bitmaps of its
    sources: bit s of bitmap k says that it has more than k pieces of source s. A piece goes into the tightest bin that
    has room, none of its cluster and fewer than ``per_source`` of its source: the search begins at the least sufficient
    rest, tries the bins with that rest in order of their numbers, and goes on to the next larger rest until one is
    compatible; if there is none, a bin is opened. Bins only ever gain bits, so that a run of pieces that are equal in
    length, source and cluster goes on where the last search ended.
    """
    bins, starts = [], []
    rest: list[int] = []
    cluster_bits: list[int] = []
    source_bits: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    rests = 0
    last, cursor = None, (0, 0)
    for length, source, cluster in zip(lengths, sources, clusters):
        same = (length, source, cluster) == last
        level, number = cursor if same else (length, 0)
        last = (length, source, cluster)
        found = -1
        while found < 0:
            above = rests >> level
            if not above:
                break
            step = (above & -above).bit_length() - 1
            if step:
                level, number = level + step, 0
            row = by_rest[level]
            for b in row[bisect_left(row, number):]:
                if not cluster_bits[b] >> cluster & 1 and not source_bits[b][-1] >> source & 1:
                    found = b
                    break
            else:
                level, number = level + 1, 0
        if found < 0:
            found = len(rest)
            rest.append(capacity)
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
        else:
            row = by_rest[level]
            row.pop(bisect_left(row, found))
            if not row:
                del by_rest[level]
                rests &= ~(1 << level)
        cursor = (level, found + 1)
        bins.append(found)
        starts.append(capacity - rest[found])
        left = rest[found] = rest[found] - length
        cluster_bits[found] |= 1 << cluster
        bit = 1 << source
        for k in range(per_source):
            if not source_bits[found][k] & bit:
                source_bits[found][k] |= bit
                break
        if left in by_rest:
            insort(by_rest[left], found)
        else:
            by_rest[left] = [found]
            rests |= 1 << left
    return bins, starts


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Packs the pieces of a shard, longest first; of equal ones by cluster, source, id and piece. With a column ``turn``
    the bins are numbered in the order of the first turn in each."""
    rows = rows.sort_values(["length", "cluster", "source", "id", "piece"], ascending=[False, True, True, True, True],
                            na_position="last", kind="stable")
    sources, clusters = (pd.factorize(rows[c], use_na_sentinel=False)[0].tolist() for c in ("source", "cluster"))
    bins, starts = best_fit(rows["length"].tolist(), sources, clusters, capacity, per_source)
    if "turn" in rows:
        bins = pd.Series(rows["turn"].to_numpy()).groupby(np.array(bins, np.int64)).min().rank(method="first").astype("int64").to_numpy()[bins] - 1
    return rows.assign(bin=np.array(bins, np.int64) + (rows["shard"].to_numpy(np.int64) << 24), start=starts)[
        ["id", "piece", "length", "bin", "start"]]


def text_cluster(text: Column) -> Column:
    """Equal for texts that have the same words but for the case of letters."""
    return F.xxhash64(F.lower(F.array_join(words(text), " ")))


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", length: Column | None = None, source_col: str = "source",
         cluster: Column | None = None, text_col: str = "text", per_source: int = 4, shard: int = SHARD,
         mixed: bool = False) -> DataFrame:
    """``(id, piece, length, bin, start)`` of every piece of every document.

    ``length`` (by default the number of words) is cut into pieces of ``capacity``; full ones fill a bin, the rest is
    packed. No bin has two pieces of one duplicate ``cluster`` (by default texts of the same words) or more than
    ``per_source`` of one source. Pieces are dealt evenly to shards by their id, and each shard is packed on its own, so
    a source or cluster of any size is spread over all shards and takes as many bins as it needs.

    With ``mixed`` the bins follow the mixture of :func:`moneytrail.llm.mixing.mix` with its default weights: shards are
    consecutive ranges of its slots, and bins are numbered in the order of slots, so that in the order of bins the
    sources have their weights. Where sources have run out a range of slots has fewer pieces.

    A document without words takes no room: one row with length 0 and null bin and start. A null source is a source, a
    null text belongs to the cluster of empty ones; repeated rows share a cluster, so they never share a bin.
    """
    n = F.coalesce(length if length is not None else F.size(words(F.col(text_col))), F.lit(0)).cast("long")
    group = cluster if cluster is not None else text_cluster(F.col(text_col))
    narrow = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                 group.cast("string").alias("cluster"), n.alias("n")), "lengths")
    if mixed:
        slots = mix(narrow, id_col="id", source_col="source", block_docs=BLOCK)
        turn = (F.col("mixed.slot") * BLOCK + F.col("mixed.place")).alias("turn")
        narrow = written(slots.select("id", "source", "cluster", "n", turn), "turns")
    turns = ["turn"] if mixed else []
    pieces = narrow.where("n > 0").select("id", "source", "cluster", *turns, F.explode(F.sequence(
        F.lit(0), F.expr(f"CAST((n - 1) DIV {capacity} AS INT)"))).alias("piece"), "n").withColumn(
        "length", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int")).drop("n")
    total, docs_packed = narrow.agg(F.coalesce(F.expr(f"sum((n + {capacity} - 1) DIV {capacity})"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-int(total) // shard))
    kind = narrow.schema["id"].dataType.simpleString()
    # so many turns have a shard's pieces where no slot is empty
    width = max(1, shard * docs_packed // max(1, int(total)))
    place = F.expr(f"turn DIV {width}") if mixed else F.pmod(F.xxhash64("id", "piece"), F.lit(shards))
    dealt = pieces.withColumn("shard", place.cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity, per_source),
                                                  f"id {kind}, piece int, length int, bin bigint, start int")
    none = narrow.where("n = 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("length"),
                                        F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("start"))
    return packed.unionByName(none)
