"""Mixing sources to target weights by proportionate-fair scheduling (operator 10)."""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from moneytrail.llm.common import written

#: Rows of a source that are numbered in one task.
NUMBERED = 50_000
#: Sources a mixture may have: a target weight is a setting, and the driver lays out one cycle of them.
MAX_SOURCES = 10_000


def edf_cycle(shares: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one cycle of ``T = sum(shares)`` slots.

    Block ``j`` of a source of share ``n`` is released at ``floor(j T / n)`` and due at ``ceil((j + 1) T / n)``. In each
    slot the released block that is due first goes (of equal ones, that of the first source by name, null last). All
    deadlines are met, so that after every slot each source has had less than one block more or less than its weight
    times the slots. The windows repeat every T slots, and so does the order.
    """
    total = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, s or ""))
    window = lambda i, j: (j * total // shares[names[i]], -(-(j + 1) * total // shares[names[i]]))
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    cycle = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, j)[1], i, j))
        due, i, j = heapq.heappop(ready)
        cycle.append((names[i], j, slot, window(i, j)[0], due))
        if j + 1 < shares[names[i]]:
            heapq.heappush(waiting, (window(i, j + 1)[0], i, j + 1))
    return cycle


def flattened(counts: dict[str | None, int], top: int = 100) -> dict[str | None, int]:
    """Whole shares in proportion to the square roots of the counts, ``top`` for the largest source and one at least."""
    most = max(counts.values(), default=1)
    return {s: max(1, math.ceil(top * math.sqrt(n / most))) for s, n in counts.items()}


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_docs: int = 4) -> DataFrame:
    """``docs`` with a struct column ``mixed``: block, place in it, slot, release and deadline.

    Documents of a source are put in a repeatable order that ignores their content (by the MD5 of their id) and cut into
    blocks of ``block_docs``; a block is given its slot, cycle after cycle. In the order of slots, places and sources the
    rows are the mixture. No row is left out: when a source has run out its slots stay empty, and the others keep their
    weights among themselves. ``shares`` are the target weights as whole numbers, by default :func:`flattened` counts;
    sources that are not named have a share of one.

    Rows are numbered in parts of a source of bounded size, by the number of rows in the parts before. A null source is a
    source like any other, a null id comes first, repeated ids are neighbours, texts are not looked at. ``mixed`` must
    not be a column of ``docs``; other names are free.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"),
                        key.alias("key"))
    by_source = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_source.limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"a mixture has {MAX_SOURCES} sources at most; map them to fewer first")
    shares = {s: (shares or {}).get(s, 1) for s in counts} if shares else flattened(counts)
    sources = _rows(docs, [(s, n, shares[s], -(-n // NUMBERED)) for s, n in counts.items()],
                    "source string, n bigint, share int, parts int")
    cycle = _rows(docs, edf_cycle(shares), "source string, j int, slot bigint, release bigint, deadline bigint")
    total = sum(shares.values())

    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")

    def parted(rows: DataFrame) -> DataFrame:
        known = sources.withColumnRenamed("source", "_source")
        return rows.join(known, F.expr("source <=> _source")).drop("_source").withColumn(
            "part", F.shiftright(first * F.col("parts"), 32).cast("int"))

    sizes = parted(docs.select(F.col(source_col).alias("source"), key.alias("key"))).groupBy("source", "part").agg(
        F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(F.col("source").alias("_source"), F.col("part").alias("_part"),
                                   F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("source", "part").orderBy("key")
    numbered = (parted(keyed).withColumn("at", F.row_number().over(within))
                .join(offsets, F.expr("source <=> _source AND part = _part"))
                .withColumn("rank", F.col("at") - 1 + F.col("offset")))
    blocks = numbered.select("row", F.col("source").alias("own"), "share", F.expr(f"rank DIV {block_docs}").alias("block"),
                             F.expr(f"CAST(rank % {block_docs} AS INT)").alias("place")).withColumn(
        "j_own", F.expr("CAST(block % share AS INT)"))
    placed = blocks.join(cycle, F.expr("own <=> source AND j_own = j"))
    start = F.expr("block DIV share") * total
    return placed.select("row.*", F.struct(
        "block", "place", (start + F.col("slot")).alias("slot"), (start + F.col("release")).alias("release"),
        (start + F.col("deadline")).alias("deadline")).alias("mixed"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with the rows in the order of :func:`mix`: files written from it hold, one after another,
    the mixture."""
    mixed = mix(docs, **options)
    source = options.get("source_col", "source")
    keys = ["mixed.slot", "mixed.place", source]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mixed")


def _rows(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver's values, as a constant of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ", ".join(": ".join(c.split()) for c in schema.split(", "))
    one = like.sparkSession.range(1)
    return one.select(F.explode(F.from_json(F.lit(data), f"array<struct<{fields}>>")).alias("r")).select("r.*")
