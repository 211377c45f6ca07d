"""Repeated byte strings by sampled suffixes (operator 4).

The suffixes of all texts are sampled by a difference cover, the samples get names by recursion on triples, equal names
are brought together, and the suffixes in between are merged by way of the sample they share with their equals:

1. The name of a string of 3, 9 and 27 bytes is a hash of the triple of names it is made of; two of these name 54 bytes.
2. The cover is chosen by content: a suffix is sampled if its 54-byte name is the least in some stretch of 47 positions.
   Like the classic cover by remainders it has the property that matters, that any two equal strings of 100 bytes hold
   samples at the same distance from their starts; but it takes 4 % of the positions and not 67 %.
3. Samples are dealt by name and sorted. Those with a name of their own end here, with all suffixes that lean on them.
4. The suffixes that lean on one sample are a span. Of equal spans all but the first are later copies as a whole.
   Where a name has several spans, the suffixes of the first of each are merged: they are dealt by the name of their
   100 bytes, sorted, and each is compared with the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import byte_values, written

LENGTH = 100
SAMPLED = 54
STRETCH = LENGTH - SAMPLED + 1
#: Bytes of text that a task works on at once; one text at least.
PORTION = 8 << 20
_SPAN = np.dtype([("name", "<u8"), ("span", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("last", "<u4")])
_SUFFIX = np.dtype([("name", "<u8"), ("check", "<u8"), ("doc", "<u4"), ("start", "<u4")])
_CUT = np.dtype([("start", "<u4"), ("last", "<u4")])
#: A text's place among the others: rows of one id are told apart by the hashes of their texts.
_TEXT = np.dtype([("doc", "<i8"), ("hash", "<i8")])
_PLACED = np.dtype([*_TEXT.descr, ("start", "<u4"), ("last", "<u4")])


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A hash of names, position by position."""
    result = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        result ^= p
        result *= np.uint64(0xFF51AFD7ED558CCD)
        result ^= result >> np.uint64(32)
    return result


class Names:
    """Names of the strings at every position of a text of at least 100 bytes."""

    def __init__(self, text: bytes):
        name = np.frombuffer(text, np.uint8).astype(np.uint64)
        for width in (1, 3, 9):
            size = len(name) - 2 * width
            name = _mix(name[:size], name[width:width + size], name[2 * width:])
        size = len(name) - 27
        self.sample = _mix(name[:size], name[27:])
        self.suffixes = len(text) - LENGTH + 1

    def whole(self, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """Names of the 100-byte strings at the given positions."""
        return _mix(self.sample[at] + np.uint64(salt), self.sample[at + LENGTH - SAMPLED])

    def spans(self, doc: int) -> np.ndarray:
        """The samples of the text with the first and the last suffix that leans on each."""
        least = (self.sample & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.sample), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, STRETCH - 32):
            least = np.minimum(least[:-step], least[step:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((start[1:] - 1, [len(at) - 1]))
        found = np.empty(len(start), _SPAN)
        found["name"], found["doc"], found["start"], found["last"] = self.sample[at[start]], doc, start, last
        found["span"] = _mix(self.whole(start), self.whole(last), (last - start).astype(np.uint64), (at[start] - start).astype(np.uint64))
        return found


def _first_of(rows: np.ndarray, keys: list[str], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by keys and places, which of the ordered rows begin a group of equal keys, which are later copies): a row
    at the place of the first of its group is that first once more, from a repeated row, and no copy of it."""
    places = [texts["doc"], texts["hash"], rows["start"]]
    order = np.lexsort([*places[::-1], *(rows[k] for k in keys[::-1])])
    same = np.ones(max(0, len(rows) - 1), bool)
    for k in keys:
        column = rows[k][order]
        same &= column[1:] == column[:-1]
    first = np.concatenate((np.ones(min(1, len(rows)), bool), ~same))
    begin = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    copy = np.zeros(len(rows), bool)
    for place in places:
        ordered = place[order]
        copy |= ordered != ordered[begin]
    return order, first, copy


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        at = batch.schema.get_field_index(column)
        others = [c.to_pylist() for k, c in enumerate(batch.columns) if k != at]
        for text, *rest in zip(byte_values(batch.column(at)), *others):
            held.append((text, *rest))
            size += len(text)
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


def _dealt(rows: np.ndarray, ids: np.ndarray, buckets: int, kind: np.dtype) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows by bucket of their names, with the ids of the documents that they speak of."""
    if not len(rows):
        return
    bucket = (rows["name"] >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for s, e in zip(cuts, cuts[1:]):
        part = rows[s:e].astype(kind)
        docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
        yield int(bucket[s]), ids[docs].tobytes(), part.tobytes()


def _gathered(frame: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(rows, text of each) of the parts of a bucket."""
    rows, ids = [], []
    for raw, known in zip(frame["rows"], frame["ids"]):
        part = np.frombuffer(raw, kind)
        rows.append(part)
        ids.append(np.frombuffer(known, _TEXT)[part["doc"]])
    return np.concatenate(rows), np.concatenate(ids)


def _by_stripe(ids: np.ndarray, cuts: np.ndarray, kind: int, stripes: int) -> list[tuple[int, int, bytes]]:
    """(stripe, kind, cuts with their texts) for every stripe: a share of the documents, dealt by id."""
    rows = np.empty(len(ids), _PLACED)
    rows["doc"], rows["hash"], rows["start"], rows["last"] = ids["doc"], ids["hash"], cuts["start"], cuts["last"]
    stripe = _mix(ids["doc"].astype(np.int64).view(np.uint64)) % np.uint64(stripes)
    order = np.argsort(stripe, kind="stable")
    rows, stripe = rows[order], stripe[order]
    ends = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1], [True]))) if len(rows) else np.array([], int)
    return [(int(stripe[s]), kind, rows[s:e].tobytes()) for s, e in zip(ends, ends[1:])]


def _by_doc(frame: pd.DataFrame) -> pd.DataFrame:
    """A row per text of a stripe, with its cuts."""
    rows = np.concatenate([np.frombuffer(c, _PLACED) for c in frame["cuts"]])
    rows = rows[np.lexsort([rows["hash"], rows["doc"]])]
    other = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["hash"][1:] != rows["hash"][:-1])
    ends = np.flatnonzero(np.concatenate(([True], other, [True])))
    return pd.DataFrame([(int(rows["doc"][s]), int(rows["hash"][s]), _cuts(rows[s:e]).tobytes()) for s, e in zip(ends, ends[1:])],
                        columns=["_doc", "_hash", "cuts"])


def _cuts(rows: np.ndarray) -> np.ndarray:
    found = np.empty(len(rows), _CUT)
    found["start"], found["last"] = rows["start"], rows["last"] if "last" in rows.dtype.names else rows["start"]
    return found


COPY, OPEN, SPANS = 0, 1, 2
_DEALT = "bucket int, kind int, ids binary, rows binary"
_FOUND = "stripe int, kind int, cuts binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _sampled(buckets: int):
    """Deals the spans of all texts; of equal spans in one portion only the first, the others are copies already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches, "text"):
            ids = np.array([(d, h) for _, d, h in portion], _TEXT)
            each = [Names(t).spans(k) for k, (t, *_) in enumerate(portion) if len(t) >= LENGTH]
            if not each:
                continue
            spans = np.concatenate(each)
            order, first, copy = _first_of(spans, ["name", "span"], ids[spans["doc"]])
            copies = spans[order[copy]]
            out = [(b, SPANS, i, r) for b, i, r in _dealt(spans[order[first]], ids, buckets, _SPAN)]
            # copies take the way of the spans, in the bucket whose number their stripe has
            out += [(stripe, COPY, b"", cuts) for stripe, _, cuts in _by_stripe(ids[copies["doc"]], _cuts(copies), COPY, buckets)]
            yield _batch(out, _DEALT)
    return run


def _spans_met(frame: pd.DataFrame, stripes: int) -> pd.DataFrame:
    """Copies, and the first spans of names that have several."""
    spans = frame[frame["kind"] == SPANS]
    found = [(int(b), COPY, c) for b, c in frame.loc[frame["kind"] == COPY, ["bucket", "rows"]].itertuples(index=False)]
    if len(spans):
        rows, ids = _gathered(spans, _SPAN)
        order, first, copy = _first_of(rows, ["name", "span"], ids)
        rows, ids = rows[order], ids[order]
        found += _by_stripe(ids[copy], _cuts(rows[copy]), COPY, stripes)
        rows, ids = rows[first], ids[first]
        _, at, counts = np.unique(rows["name"], return_inverse=True, return_counts=True)
        several = counts[at] > 1
        found += _by_stripe(ids[several], _cuts(rows[several]), OPEN, stripes)
    return pd.DataFrame(found, columns=["stripe", "kind", "cuts"])


def _suffixes(buckets: int):
    """Deals the suffixes of open spans by the name of their 100 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches, "text"):
            ids = np.array([(d, h) for _, d, h, _ in portion], _TEXT)
            each = []
            for k, (text, *_, cuts) in enumerate(portion):
                open_ = np.frombuffer(cuts, _CUT)
                counts = open_["last"].astype(np.int64) - open_["start"] + 1
                at = np.repeat(open_["start"].astype(np.int64) - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                names = Names(text)
                rows = np.empty(len(at), _SUFFIX)
                rows["name"], rows["check"], rows["doc"], rows["start"] = names.whole(at), names.whole(at, 1), k, at
                each.append(rows)
            out = list(_dealt(np.concatenate(each), ids, buckets, _SUFFIX))
            if out:
                yield _batch(out, "bucket int, ids binary, rows binary")
    return run


def _suffixes_met(frame: pd.DataFrame, stripes: int) -> pd.DataFrame:
    """Sorted by name and place, a suffix is a copy if the first of the same name is at another place."""
    rows, ids = _gathered(frame, _SUFFIX)
    order, _, copy = _first_of(rows, ["name", "check"], ids)
    later = order[copy]
    return pd.DataFrame(_by_stripe(ids[later], _cuts(rows[later]), COPY, stripes), columns=["stripe", "kind", "cuts"])


def kept_bytes(text: bytes, cuts: bytes) -> tuple[bytes, int, int]:
    """(what is left of the text, bytes removed, maximal removed runs)."""
    gone = np.zeros(len(text) + 1, np.int32)
    spans = np.frombuffer(cuts, _CUT)
    np.add.at(gone, spans["start"].astype(np.int64), 1)
    np.add.at(gone, spans["last"].astype(np.int64) + LENGTH, -1)
    out = np.cumsum(gone[:-1]) > 0
    runs = int(np.count_nonzero(out[1:] & ~out[:-1]) + out[:1].sum())
    return np.frombuffer(text, np.uint8)[~out].tobytes(), int(out.sum()), runs


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_doc, _hash, cuts)``: packed first and last starts of 100-byte strings that also start earlier, for the text of
    this hash in the rows of this id."""
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = _texts(docs, id_col, text_col).where("doc IS NOT NULL")
    met = written(texts.mapInArrow(_sampled(buckets), _DEALT).groupBy("bucket").applyInPandas(
        lambda frame: _spans_met(frame, buckets), _FOUND), "met")
    by_text = "_doc bigint, _hash bigint, cuts binary"
    open_ = met.where(F.col("kind") == OPEN).groupBy("stripe").applyInPandas(_by_doc, by_text)
    again = texts.join(open_, F.expr("doc = _doc AND hash = _hash")).select("text", "doc", "hash", "cuts")
    merged = written(again.mapInArrow(_suffixes(buckets), "bucket int, ids binary, rows binary").groupBy("bucket").applyInPandas(
        lambda frame: _suffixes_met(frame, buckets), _FOUND), "merged")
    copies = met.where(F.col("kind") == COPY).union(merged)
    return copies.groupBy("stripe").applyInPandas(_by_doc, by_text)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(text.alias("text"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("hash"))


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` for every row: what is left of the UTF-8 bytes of its text without
    those that lie in a 100-byte string that also starts earlier: in a row with a smaller whole-number id, or earlier in
    the same one.

    Null and short texts lose nothing, nor do rows with a null id, which have no place in the order. Rows that share id
    and text are a single place and lose nothing to each other; rows that share only the id are in the order of the
    hashes of their texts.
    """
    cuts = repeated_spans(docs, id_col, text_col)
    joined = _texts(docs, id_col, text_col).join(cuts, F.expr("doc = _doc AND hash = _hash"), "left").select("text", "doc", "cuts")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches, "text"):
            out = []
            for text, doc, found in portion:
                kept, removed, spans = kept_bytes(text, found) if found else (text, 0, 0)
                out.append((doc, len(text), removed, spans, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
