"""Near-duplicates at a Jaccard similarity of word shingles, every link checked on the shingle sets themselves.

1. Tiles of 256-bit SimHash fingerprints, as in :mod:`moneytrail.llm.near_dedup`, give the nearest links, a spanning
   forest per pair of panels. Those that are similar enough join most of a family cheaply; nothing is decided by those
   that are not.
2. Prefix filtering gives every other pair that can be similar: in one order of all shingles, rare ones first, two sets
   of at least the similarity have a shingle in common among the first ``size - ceil(similarity * size) + 1`` of each.
   Of these pairs of different groups, those stay whose sizes, and places of the common shingle, allow the similarity.
3. Before any set travels, a pair has to pass the :func:`parity` of its sets, about a bit for each shingle: every bit in
   which two sets differ holds at least one shingle that only one of them has. Sets are compared for what is left, so
   the groups are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import byte_values, fresh, release, written
from moneytrail.llm.components import components
from moneytrail.llm.near_dedup import PANEL, TILE, majority_bits, shingle_hashes

WORDS = 4
BITS = 64 * WORDS
#: How many standard deviations of a pair of just the wanted similarity the radius leaves room for.
SLACK = 2.5
#: Fixed odd multipliers that make further hashes of a shingle from its first.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Counters that shingles are folded into, to put rare shingles first. The order decides how many pairs are checked, not
#: which are found.
COUNTERS = 1 << 18
#: Bytes of a shingle's hash that are compared: of two sets of n shingles, two different ones meet with a chance of n * n
#: in 2**48.
KEPT = 6
_KEY = np.dtype([("fp", "<u8", WORDS), ("size", "<u4")])


def radius_for(similarity: float) -> int:
    """Differing bits that a pair of this Jaccard similarity has but for one in about 160 (``SLACK`` deviations)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p)))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = (hashes + np.uint64(k)) * _MIX[k]
    x = (x ^ (x >> np.uint64(31))) * _MIX[(k + 1) % WORDS]
    return x ^ (x >> np.uint64(29))


def frequencies(docs: DataFrame, text_col: str, shingle: int, seed: int) -> np.ndarray:
    """The logarithm, as a byte per counter, of how many shingles of documents fall there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in byte_values(batch.column(0)):
                own = set(shingle_hashes(x, shingle, seed))
                np.add.at(counts, (np.fromiter(own, np.uint64, len(own)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text"))
    # at most a row per counter, however large the table
    found = counted.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[np.asarray(found["at"], np.int64)] = np.asarray(found["n"], np.int64)
    return (4 * np.log2(1 + counts)).astype(np.uint8)


def prefix(hashes: np.ndarray, similarity: float, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of their ranks and hashes, as many as it takes for two sets of the
    similarity to have one in common."""
    if not len(hashes):
        return hashes
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    order = np.lexsort([hashes, ranks[(hashes % np.uint64(COUNTERS)).astype(np.int64)]])
    return hashes[order[:size]]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each of as many bins as the least power of two from the size of the set (64 or more): whether the bin
    holds an odd number of its shingles. Folding the upper half of the bins onto the lower gives the bits of half as many.
    """
    bins = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    at = (_mixed(hashes, 3) & np.uint64(bins - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bins) & 1).astype(np.uint8)).tobytes()


def apart_at_least(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For every pair of :func:`parity` bits, a number of shingles that at least are in only one of the two sets."""
    lengths = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    found = np.zeros(len(lengths), np.int64)
    for p, q in np.unique(lengths, axis=0):
        rows = np.flatnonzero((lengths == (p, q)).all(axis=1))
        least = min(p, q)
        sides = [np.bitwise_xor.reduce(np.frombuffer(b"".join(x[r] for r in rows), np.uint8).reshape(
            len(rows), -1, least), axis=1) for x in (a, b)]
        found[rows] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return found


def cut_set(hashes: np.ndarray) -> bytes:
    """The low :data:`KEPT` bytes of every hash, in ascending order."""
    low = np.unique(hashes & np.uint64((1 << 8 * KEPT) - 1))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def whole_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return wide.reshape(-1).view("<u8")


def node_sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(node, set)`` of the column ``text``: the :func:`cut_set` of every whole text, once per task for equal ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, len(whole), 256):
                texts = byte_values(whole.slice(at, 256).column(0))
                each = [np.fromiter(s, np.uint64, len(s)) for s in (set(shingle_hashes(x, shingle, seed)) for x in texts)]
                new = {k: x for k, x in zip(_keys(each), each) if k not in seen}
                seen |= new.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(
                    [cut_set(x) for x in new.values()], pa.binary())], ["key", "set"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "key binary, set binary").select(
        F.xxhash64("key").alias("node"), "set")


def _keys(sets: list[np.ndarray]) -> list[bytes]:
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    keys = np.zeros(len(sets), _KEY)
    for k in range(WORDS):
        keys["fp"][:, k] = majority_bits(_mixed(flat, k), counts)
    keys["size"] = counts
    return [x.tobytes() for x in keys]


def shingle_keys(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, similarity: float,
                 ranks: np.ndarray) -> DataFrame:
    """``(id, key, prefix, parity)`` of every whole text. ``key`` is the 256-bit fingerprint and the size of its set of
    shingle hashes; texts with equal sets have equal keys. Null and empty texts have no shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                each = [np.fromiter(s, np.uint64, len(s)) for s in
                        (set(shingle_hashes(x, shingle, seed)) for x in byte_values(batch.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_keys(each), pa.binary()),
                     pa.array([prefix(x, similarity, ranks).view(np.int64) for x in each], pa.list_(pa.int64())),
                     pa.array([parity(x) for x in each], pa.binary())], ["id", "key", "prefix", "parity"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key binary, prefix array<bigint>, parity binary")


def spanning_forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, nodes: int) -> np.ndarray:
    """Positions of links of a minimum spanning forest by the small whole numbers ``d``."""
    root, chosen = np.arange(nodes), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while True:
            ru, rv = root[u[at]], root[v[at]]
            apart = ru != rv
            at, ru, rv = at[apart], ru[apart], rv[apart]
            if not len(at):
                break
            high, first = np.unique(np.maximum(ru, rv), return_index=True)
            root[high] = np.minimum(ru, rv)[first]
            chosen.append(at[first])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


class _Side:
    """A panel sorted by the size of the sets, with the ranges of sizes and population counts of every tile."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys[np.argsort(keys["size"], kind="stable")]
        self.words = np.ascontiguousarray(self.keys["fp"].T)
        self.sizes = self.keys["size"].astype(np.float64)
        counts = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.starts = np.arange(0, len(keys), TILE)
        self.small, self.large = (f.reduceat(self.sizes, self.starts) for f in (np.minimum, np.maximum))
        self.low, self.high = (f.reduceat(counts, self.starts) for f in (np.minimum, np.maximum))


def candidate_links(a: np.ndarray, b: np.ndarray | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, u, v)``: a minimum spanning forest, by differing bits, of the links between one or two panels.

    Tile pairs whose population counts differ beyond the radius, or whose set sizes exclude the similarity, are skipped.
    Half of the bits are compared for all pairs of the others, the rest for those that are still within the radius. A
    tile pair leaves a forest of its own links, so a task holds two rows per fingerprint and tile at most.
    """
    left = _Side(a)
    right = left if b is None else _Side(b)
    keys = left.keys if b is None else np.concatenate([left.keys, right.keys])
    shift = 0 if b is None else len(left.keys)
    us, vs, ds = [], [], []
    for i, s in enumerate(left.starts):
        near = np.flatnonzero((left.low[i] - right.high <= radius) & (right.low - left.high[i] <= radius)
                              & (left.small[i] * similarity <= right.large) & (right.small * similarity <= left.large[i]))
        for j in near if b is not None else near[near >= i]:
            t = right.starts[j]
            x, y = left.words[:, s:s + TILE], right.words[:, t:t + TILE]
            half = np.bitwise_count(x[0, :, None] ^ y[0]) + np.bitwise_count(x[1, :, None] ^ y[1])
            u, v = np.nonzero(half <= radius)
            d = half[u, v].astype(np.int16) + np.bitwise_count(x[2:, u] ^ y[2:, v]).sum(axis=0, dtype=np.int16)
            p, q = left.sizes[u + s], right.sizes[v + t]
            hit = (d <= radius) & (np.minimum(p, q) >= similarity * np.maximum(p, q))
            if b is None and i == j:
                hit &= u < v
            u, v, d = u[hit], v[hit], d[hit]
            if len(u):
                kept = spanning_forest(u, v if b is None and i == j else v + TILE, d, 2 * TILE)
                us.append(u[kept] + s)
                vs.append(v[kept] + t + shift)
                ds.append(d[kept])
    if not us:
        none = np.zeros(0, np.int64)
        return keys, none, none
    u, v, d = map(np.concatenate, (us, vs, ds))
    kept = spanning_forest(u, v, d, len(keys))
    return keys, u[kept], v[kept]


def candidates(distinct: DataFrame, similarity: float, panel: int = PANEL) -> DataFrame:
    """Links (u, v) between the distinct keys ``key``, of spanning forests of all pairs of panels that can be similar.

    A panel holds keys whose sets have about the same size: sizes are cut into bands as wide as the similarity allows,
    so that a band meets itself and the next. Its keys are dealt by hash, so no panel outgrows ``panel`` by more than
    chance.
    """
    radius, width = radius_for(similarity), -math.log(similarity) * (1 + 1e-6)
    cells = distinct.select("key", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / width))
                            .otherwise(-1).cast("int").alias("band"))
    #: a band per quarter more shingles: about a hundred for the longest texts there can be
    known = written(cells.groupBy("band").agg(F.ceil(F.count("*") / panel).cast("int").alias("parts")), "bands")
    panels = (cells.join(F.broadcast(known), "band")
              .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
              .groupBy("band", "part").agg(F.collect_list("key").alias("keys"))
              .withColumn("id", F.struct("band", "part")))
    near = (panels.select("id", "keys", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("step"))
            .select("id", "keys", (F.col("id.band") + F.col("step")).alias("band"))
            .join(F.broadcast(known), "band")
            .select("id", "keys", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
                F.col("band").alias("band"), p.cast("int").alias("part")))).alias("other")))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"),
                        (F.col("id") <= F.col("other")).alias("first"), "keys")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(b"".join(x), _KEY) for x in rows.sort_values("first", ascending=False)["keys"]]
        keys, u, v = candidate_links(sides[0], sides[1] if len(sides) > 1 else None, radius, similarity)
        return pd.DataFrame({"u": [x.tobytes() for x in keys[u]], "v": [x.tobytes() for x in keys[v]]})

    return pairs.groupBy("a", "b").applyInPandas(compare, "u binary, v binary")


def open_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: all pairs of nodes of different groups that have a shingle of their prefixes in common, at places and
    with sizes that the similarity allows. ``rooted`` is ``(node, root, size, prefix)``, a row per node.

    The first shingle that two sets have in common leaves them no more than what follows it, so a pair that is similar
    passes at its first one."""
    # most shingles are of one node; the others are few, and those that one group has alone have nothing left to settle
    often = rooted.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
    entries = rooted.select("node", F.posexplode("prefix").alias("at", "s")).join(often, "s", "left_semi")
    shared = written(entries.join(rooted.select("node", "root", "size"), "node").select(
        "s", "node", "root", "size", (F.col("size") - F.col("at")).alias("rest")), "shared")
    several = shared.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("s")
    met = written(shared.join(several, "s", "left_semi"), "met")
    other = met.select("s", F.col("node").alias("v"), F.col("root").alias("_root"), F.col("size").alias("_size"),
                       F.col("rest").alias("_rest"))
    return met.withColumnRenamed("node", "u").join(other, "s").where(
        (F.col("u") < F.col("v")) & (F.col("root") != F.col("_root"))
        & (F.least("size", "_size") + 1e-6 >= similarity * F.greatest("size", "_size"))
        & (F.least("rest", "_rest") * (1 + similarity) + 1e-6 >= similarity * (F.col("size") + F.col("_size")))
    ).select("u", "v").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that the parities of their sets do not rule out. ``nodes`` is ``(node, size, parity)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (3, 4))
            total = batch.column(2).to_numpy(zero_copy_only=False)
            fits = apart_at_least(a, b) * (1 + similarity) <= total * (1 - similarity) + 1e-6
            yield batch.filter(pa.array(fits)).select([0, 1])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"_{c}"), F.col("parity").alias(f"parity_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select(
        "u", "v", (F.col("_u") + F.col("_v")).alias("total"), "parity_u", "parity_v")
    return both.mapInArrow(run, "u bigint, v bigint")


def similar_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose ``sets``, ``(node, set)`` rows, are similar. Both sets of a pair meet in one sorted
    run, and a task holds a batch and one set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, node, held, settled = None, None, b"", True
        for batch in batches:
            us, vs = [], []
            for u, v, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if pair != (u, v):
                    pair, node, held, settled = (u, v), n, data, False
                elif n != node and not settled:
                    settled = True
                    total = (len(held) + len(data)) // KEPT
                    common = len(np.intersect1d(whole_set(held), whole_set(data), assume_unique=True))
                    if common * (1 + similarity) >= total * similarity - 1e-9:
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    wanted = pairs.select("u", "v", F.col("u").alias("node")).union(pairs.select("u", "v", F.col("v").alias("node")))
    rows = wanted.join(sets, "node").select("u", "v", "node", "set")
    return rows.repartition("u", "v").sortWithinPartitions("u", "v", "node").mapInArrow(run, "u bigint, v bigint")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
                      shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(id, component)`` for every row: component is the least id that links between texts of at least this Jaccard
    similarity of their word shingles can reach, the row itself included.

    Every link is checked on 48 bits of each shingle, and every pair of different groups that can be similar is: see the
    module. Texts without words are alike, shorter ones than a shingle are one shingle. Rows with a null id take part but
    never name a component (null if there is no other); repeated ids give a row each, an empty table none.
    """
    ranks = frequencies(docs, text_col, shingle, seed)
    rows = written(shingle_keys(docs, id_col, text_col, shingle, seed, similarity, ranks).withColumn(
        "node", F.xxhash64("key")).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    ids = written(rows.select("id", "node"), "ids")
    distinct = written(rows.groupBy("key", "node").agg(F.min("id").alias("first"), F.min("row").alias("row")), "distinct")
    # the size is the last four bytes of a key, lowest first
    byte = lambda k: F.conv(F.hex(F.substring("key", 8 * WORDS + 1 + k, 1)), 16, 10).cast("long") * (1 << 8 * k)
    sized = distinct.withColumn("size", byte(0) + byte(1) + byte(2) + byte(3))
    # any row of a node has its prefix and parity
    nodes = written(rows.select("row", "prefix", "parity").join(sized.select("node", "size", "row"), "row").drop("row"), "nodes")
    release(rows)

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(possible(pairs, nodes, similarity), f"{name}-possible")
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        wanted = written(distinct.join(ends, "node", "left_semi").select(F.col("first").alias("_first")).distinct(), "wanted")
        own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
            wanted, F.expr("_id <=> _first"), "left_semi")
        return written(similar_sets(pairs, node_sets(own, shingle, seed), similarity), name)

    links = candidates(sized.select("key", "size"), similarity).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    near = alike(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    root = components(near)
    rooted = nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "prefix")
    late = alike(open_pairs(rooted, similarity), "late")
    release(nodes)
    roots = components(near.union(late))
    named = written(distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return ids.join(named.join(least, "root").select("node", "component"), "node").select("id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **options) -> DataFrame:
    """Exactly one row of every group of :func:`similar_documents`, with the columns of ``docs``.

    Rows are told apart by id and text, so rows that share an id but are of different groups all stay. Of a group the row
    with the least id stays, before those without an id; of equal ids the one with the lesser hash of id and text; of
    wholly repeated id and text the least row. Columns may have any names; of an empty table nothing is left.
    """
    key = fresh(docs.columns, "_key")
    row_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumn(key, F.md5(F.concat_ws(":", F.when(row_id.isNull(), "-").otherwise(F.concat(F.lit("+"), row_id.cast("string"))),
                                                   F.md5(text.cast("binary")))))
    groups = similar_documents(keyed.select(F.col(f"`{key}`").alias("k"), text.alias("t")), "k", "t", similarity, **options)
    ids = keyed.select(F.col(f"`{key}`").alias("id"), row_id.alias("own")).groupBy("id").agg(F.first("own").alias("own"), F.count("*").alias("n"))
    best = written(groups.distinct().join(ids, "id").groupBy("component").agg(
        F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id", "n")).alias("b")).select(
        F.col("b.id").alias("_kept"), (F.col("b.n") > 1).alias("_several")), "kept")
    once, often = best.where("NOT _several").select("_kept"), best.where("_several").select("_kept")
    single = keyed.join(once, F.col(f"`{key}`") == F.col("_kept"), "left_semi").drop(key)
    # repeated rows are counted as they are found, so no task holds a group of them
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = keyed.join(often, F.col(f"`{key}`") == F.col("_kept"), "left_semi").groupBy(key).agg(F.min(row).alias("row"))
    return single.unionByName(least.select("row.*"))
