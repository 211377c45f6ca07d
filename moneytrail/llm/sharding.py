"""Shards of nearly equal bytes for groups of rows that must stay together, by Karmarkar-Karp differencing.

Differencing is sequential, so it works on a bounded number of items whatever the size of the table: groups of at least one
``1 / GRAIN`` of all bytes are items of their own (there can be at most ``GRAIN``), the others are gathered into ``GRAIN``
pellets by the hash of their group. Which rule holds for a group depends on its share alone. The items' shards are then a
table of at most ``2 * GRAIN`` rows, and every row finds its own by a broadcast join of that size: texts are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.common import written

#: Items of differencing: so many pellets, and at most as many large groups.
GRAIN = 24_576
#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 8
#: Rows that one task numbers at about, where rows are not repeated.
SLOT_ROWS = 200_000
#: Repeated rows that one array holds.
COPIES = 65_536
#: Files of a shard.
SPREAD = 64


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The shard of every item. An item begins as a partial partition of its size and ``ways - 1`` zeros; the two partial
    partitions with the largest spread (largest less smallest sum) are combined in opposite order until one is left. Equal
    spreads go by position. Sums are kept less their smallest, in falling order."""
    if not sizes:
        return []
    # a partial partition: its sums; how it was made is (left, right, the slot of right that meets each slot of left)
    made: list[tuple] = [()] * len(sizes)
    heap = [(-size if ways > 1 else 0, k, (size,) + (0,) * (ways - 1)) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(ways), key=lambda i: (-sums[i], i))
        least = sums[order[-1]]
        made.append((a, b, order))
        heapq.heappush(heap, (least - sums[order[0]], len(made) - 1, tuple(sums[i] - least for i in order)))
    # from the last partition down: the shard of every slot of a partition
    shards, open_ = [0] * len(sizes), [(heap[0][1], list(range(ways)))]
    while open_:
        k, names = open_.pop()
        if k < len(sizes):
            shards[k] = names[0]
            continue
        a, b, order = made[k]
        lefts = [0] * ways
        for slot, i in enumerate(order):
            lefts[i] = names[slot]
        open_.append((a, lefts))
        open_.append((b, lefts[::-1]))
    return shards


def _digests(docs: DataFrame, text: str):
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.unhex(F.md5(value.cast("binary"))), (F.octet_length(value) + ROW_BYTES).cast("long"), F.crc32(value.cast("binary"))


def item_shards(groups: DataFrame, shards: int, grain: int = GRAIN) -> DataFrame:
    """``(large, pellet, shard)`` from ``groups`` (digest, bytes): of every group that is an item of its own its digest, of
    every pellet its number, the other null. At most ``2 * grain`` rows, which one task combines."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    large = F.col("bytes") * grain >= total
    items = groups.select(
        F.when(large, F.col("digest")).alias("large"),
        F.when(~large, F.pmod(F.xxhash64("digest"), F.lit(grain)).cast("int")).alias("pellet"), "bytes").groupBy("large", "pellet").agg(
        F.sum("bytes").alias("bytes"))

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"large": [], "pellet": [], "bytes": []}), *frames])
        keys = [(-int(b), x or b"", -1 if pd.isna(p) else int(p)) for x, p, b in zip(rows["large"], rows["pellet"], rows["bytes"])]
        keys.sort()
        found = differencing([-b for b, _, _ in keys], shards)
        yield pd.DataFrame({"large": [x or None for _, x, _ in keys],
                            "pellet": pd.array([None if p < 0 else p for _, _, p in keys], "Int32"),
                            "shard": pd.Series(found, dtype="int32")})

    return items.repartition(1).mapInPandas(combine, "large binary, pellet int, shard int")


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", name: str = "shard", grain: int = GRAIN) -> DataFrame:
    """``docs`` with the number of its shard as column ``name``, which must be new (``ValueError`` otherwise).

    Rows with equal texts are one group and share a shard, null counting as the empty text; a group is as large as all its
    rows, ``ROW_BYTES`` and the UTF-8 bytes of the text each. All rows come back, repeated ones too, and other columns are
    left alone. Shards differ by less than the smallest pellets where no group exceeds an even share; a group that does has
    a shard of its own. The assignment depends on the texts only, not on the layout of the table.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    digest, size, _ = _digests(docs, text)
    groups = written(docs.select(digest.alias("digest"), size.alias("bytes")).groupBy("digest").agg(F.sum("bytes").alias("bytes")), "groups")
    found = written(item_shards(groups, shards, grain), "items")
    # both sides are bounded by grain rows
    large = F.broadcast(found.where("large IS NOT NULL").select(F.col("large").alias("k"), F.col("shard").alias("s")))
    pellets = F.broadcast(found.where("pellet IS NOT NULL").select(F.col("pellet").alias("k"), F.col("shard").alias("s")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"))
    # a pellet whose groups are all large has no shard and is asked for by none of its rows
    row = row.join(large.withColumnRenamed("s", "own"), F.col("digest") == F.col("k"), "left").drop("k")
    row = row.join(pellets, F.pmod(F.xxhash64("digest"), F.lit(grain)).cast("int") == F.col("k"), "left")
    return row.select("row.*", F.coalesce("own", "s").alias(name))


def shard_index(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", grain: int = GRAIN) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row: its place in its shard, gapless from 0.

    Slots follow buckets of the hash of id and text, and the id inside, so that no task numbers a whole shard. Equal rows
    are counted before they meet and given consecutive slots, so neither a null id nor a repeated row is a hot key.
    """
    rows = assign_shards(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), shards, grain=grain)
    digest, size, crc = _digests(rows, "text")
    rows = written(rows.select("id", digest.alias("digest"), size.alias("size"), crc.alias("text_crc32"), "shard"), "sharded")
    buckets = rows.count() // (SLOT_ROWS * shards) + 1
    alike = rows.groupBy("id", "digest", "size", "text_crc32", "shard").agg(F.count("*").alias("n")).withColumn(
        "bucket", F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)).cast("int"))
    alike = written(alike, "alike")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("b")).select(
        "shard", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    # repeated rows come back one by one, in two steps so that no array is longer than their number over COPIES, or COPIES
    lots = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    each = lots.withColumn("i", F.explode(F.sequence("lot", F.least(F.col("lot") + COPIES, "n") - 1)))
    return each.select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("ahead") + F.col("i")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", grain: int = GRAIN) -> None:
    """Writes ``docs`` as Parquet with a folder ``shard=k`` for each shard; a null or repeated text, id or column is written
    as it is. Rows of a shard
    are dealt over ``SPREAD`` tasks by all their columns, so copies with ids of their own spread."""
    named = assign_shards(docs, shards, text, grain=grain)
    named.repartition("shard", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(SPREAD))).write.partitionBy(
        "shard").parquet(path)
