"""SimHash fingerprints of documents and permuted block tables (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import byte_values, written

BITS = 128
SHINGLE = 2
#: Fingerprints of one block key that are compared at once.
TILE = 2048
_LEAST = -(1 << 63)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """128 bits: every distinct run of ``shingle`` words votes with the signed bits of its hash, weighted by one plus the
    logarithm of how often it occurs; a bit is 1 if its votes are above zero. White space and the case of A-Z do not
    matter; a text without words has no votes, and so zero."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_128_digest
    terms = [digest(b" ".join(tokens[i:i + shingle])) for i in range(max(1, len(tokens) - shingle + 1))]
    raw = np.frombuffer(b"".join(terms), np.uint8).reshape(-1, BITS // 8)
    _, where, counts = np.unique(raw[:, :8].copy().view(np.uint64).ravel(), return_index=True, return_counts=True)
    votes, weights = np.zeros(BITS, np.float64), 1 + np.log(counts)
    for at in range(0, len(where), 8192):
        bits = np.unpackbits(raw[where[at:at + 8192]], axis=1)
        votes += 2 * (weights[at:at + 8192].astype(np.float32) @ bits.astype(np.float32)) - weights[at:at + 8192].sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits stands for: 1 for equal fingerprints, 0 for those of texts that have
    no more in common than chance."""
    if a == b:
        return 1.0
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / BITS)))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one, or all of that."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(bucket, peek, id, text)`` dealt and sorted so that every row is followed by the next one in descending order of
    id: a bucket is a range of ids, and has the first row of the bucket after it as a last, ``peek`` row (the last
    bucket that of the first).

    Whole texts are shuffled once. Bounds and first ids are one row per bucket, of which there are four per shuffle
    partition.
    """
    spark = docs.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    keys = docs.select(key.alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 100 * count)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64), side="left")).astype("int32")

    firsts = {r[0]: r[1] for r in keys.groupBy(bucket_of("key").alias("bucket")).agg(F.max("key")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first_keys = np.array([firsts[b] for b in order], np.int64)[::-1]
    peeked = np.array([before[b] for b in order], np.int32)[::-1]

    @F.pandas_udf("int")
    def peek_of(key: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(first_keys, keys), len(first_keys) - 1)
        return pd.Series(np.where(first_keys[at] == keys, peeked[at], -1)).astype("int32")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       key.alias("key")).withColumns({"own": bucket_of("key"), "also": peek_of("key")})
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("peek")),
                                     F.when(F.col("also") >= 0, F.struct(F.col("also").alias("bucket"), F.lit(True).alias("peek")))))
    dealt = rows.select(F.explode(places).alias("place"), "id", "key", "text").select("place.*", "id", "key", "text")
    return (dealt.repartition(count // 4, "bucket").sortWithinPartitions("bucket", "peek", F.desc("key"), "text")
            .select("bucket", "peek", "id", "text"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint and edited_fingerprint (bytes), near_edited and
    near_next, where the next document is the one after it in descending order of whole-number ids, after the last one
    the first.

    A null text is empty and a null id comes last; rows with equal ids are in the order of their texts. The only row of
    a table is its own next.
    """
    import hashlib

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []
        for batch in batches:
            for bucket, peek, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None and peek or held is not None and held[0] != bucket:
                    held = None
                    if peek:
                        continue
                print_ = fingerprint(text.encode(), shingle)
                if held is not None:
                    _, last_id, last, own = held
                    new = edited(last, text)
                    data = new.encode()
                    changed = fingerprint(data, shingle)
                    found.append((last_id, len(last), hashlib.sha256(data).hexdigest(), own, changed, likeness(own, changed),
                                  likeness(own, print_)))
                held = None if peek else (bucket, doc_id, text, print_)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                found = []

    return in_order(docs, id_col, text_col).mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
             "near_edited double, near_next double")


def _counted(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of every fingerprint within its run of equal (table, key, a, b). A pair that has several blocks in common
    counts in the table of the first; within two tiles, only pairs across them count."""
    out: dict[bytes, int] = {}
    for (t, _, a, b), run in rows.groupby(["table", "key", "a", "b"], sort=False):
        prints = np.frombuffer(b"".join(run["fp"]), np.uint64).reshape(-1, 2)
        side = run["part"].to_numpy()
        left = np.flatnonzero(side == a)
        right = left if a == b else np.flatnonzero(side == b)
        for at in range(0, len(left), TILE):
            rows_at = left[at:at + TILE]
            for other in range(0, len(right), TILE):
                cols_at = right[other:other + TILE]
                x = prints[rows_at][:, None, :] ^ prints[cols_at][None, :, :]
                near = np.bitwise_count(x).sum(axis=2, dtype=np.int32) <= radius
                if not near.any():
                    continue
                u, v = np.nonzero(near)
                blocks = x[u, v].view(np.uint32)
                fresh = (u_v := rows_at[u] != cols_at[v]) & (blocks[:, :t] != 0).all(axis=1) if t else rows_at[u] != cols_at[v]
                for nodes in ((rows_at[u[fresh]],) if a == b else (rows_at[u[fresh]], cols_at[v[fresh]])):
                    which, n = np.unique(nodes, return_counts=True)
                    for w, k in zip(which, n):
                        fp = run["fp"].iloc[w]
                        out[fp] = out.get(fp, 0) + int(k)
    return pd.DataFrame({"fp": list(out), "n": list(out.values())}, columns=["fp", "n"])


def neighbours(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """``(fp, n_near)`` for every distinct fingerprint of column ``fp`` that has others within ``radius`` (at most 3)
    differing bits: how many.

    Four tables, each with another of the four 32-bit blocks in front as its key: fingerprints within the radius share
    one block at least. A key with very many fingerprints is cut into parts that meet in pairs, so that no task gets
    more than two parts of it, and what is given out are counts, not pairs.
    """
    if radius >= BITS // 32:
        raise ValueError("four blocks find no more than three differing bits")
    distinct = fingerprints.select("fp").distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.substring("fp", 4 * t + 1, 4).alias("key")) for t in range(BITS // 32)])
    entries = distinct.select("fp", F.explode(keys).alias("e")).select("fp", "e.table", "e.key")
    crowded = entries.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select(
        "table", "key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    met = entries.join(crowded, ["table", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    placed = met.select("table", "key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "table", "key", "fp", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    placed = written(placed, "placed")
    bundles = max(1, placed.count() // 16_384)
    bundled = placed.groupBy(F.pmod(F.xxhash64("table", "key", "a", "b"), F.lit(bundles)))
    return bundled.applyInPandas(lambda rows: _counted(rows, radius), "fp binary, n bigint").groupBy("fp").agg(
        F.sum("n").alias("n_near"))
