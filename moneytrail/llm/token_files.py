"""Token ids in patched frame-of-reference files (operator 6).

A file is a run of segments, a segment the token ids of consecutive whole documents:

    "PFR1" | partition u32 | number u32 | before u64 | documents u64 | values u64 | blocks u32
    document ids i64 each | id is null u8 each | values of each document u64 each
    block index: offset of each block from the first, u64 each
    blocks
    "PFREND\\r\\n"

All numbers are little-endian. ``before`` counts the values of earlier segments of the partition. A block has 1024
values (the last is filled up with its minimum):

    minimum u32 | width u8 | exceptions u16 | 16 x width words u64 | positions u16 each | differences u32 each

Every value is kept as its difference from the minimum in ``width`` bits; differences that need more stand in the
exception lists, and leave a zero. In a group of 64 values, value i takes the bits from i x width on.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from moneytrail.llm.common import written

MAGIC, END = b"PFR1", "PFREND\r\n"
HEAD = struct.Struct("<4sIIQQQI")
BLOCK_HEAD = struct.Struct("<IBH")
BLOCK = 1024
#: Share of a block's values, in percent, that fits into its width.
PERCENTILE = 95
SEGMENT_VALUES = 1 << 20
SEGMENTS_PER_FILE = 8
END_ID = 2
#: Words whose ids a worker remembers; it starts over when there are more.
REMEMBERED = 1_200_000
#: New stretches that are encoded in one line.
JOINED = 1024
#: A character that marks where texts are cut; those that hold it go another way.
CUT = "\x01"
ASCII_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (n, 1024) of values below 2**width as words (n, 16 * width)."""
    groups = values.astype(np.uint64).reshape(len(values), BLOCK // 64, 64)
    words = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for i in range(64):
        at, off = divmod(i * width, 64)
        words[:, :, at] |= groups[:, :, i] << np.uint64(off)
        if off + width > 64:
            words[:, :, at + 1] |= groups[:, :, i] >> np.uint64(64 - off)
    return words.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    groups = words.reshape(len(words), BLOCK // 64, width)
    values = np.empty((len(words), BLOCK // 64, 64), np.uint64)
    for i in range(64):
        at, off = divmod(i * width, 64)
        values[:, :, i] = groups[:, :, at] >> np.uint64(off)
        if off + width > 64:
            values[:, :, i] |= groups[:, :, at + 1] << np.uint64(64 - off)
    values &= np.uint64((1 << width) - 1)
    return values.reshape(len(words), BLOCK)


def encode_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of unsigned 32-bit values."""
    if not len(values):
        return []
    fill = -len(values) % BLOCK
    last = values[len(values) - (BLOCK - fill):].min() if fill else 0
    blocks = np.concatenate([values, np.full(fill, last, values.dtype)]).reshape(-1, BLOCK).astype(np.uint32)
    least = blocks.min(axis=1)
    over = blocks - least[:, None]
    bits = np.frexp(over.astype(np.float64))[1].astype(np.uint8)
    rank = -(-BLOCK * percentile // 100) - 1
    widths = np.partition(bits, rank, axis=1)[:, rank]
    patched = bits > widths[:, None]
    kept = np.where(patched, 0, over)
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        for row, words in zip(rows, _pack(kept[rows], int(width))):
            packed[row] = words.tobytes()
    found = []
    for k, width in enumerate(widths):
        where = np.flatnonzero(patched[k])
        found.append(b"".join((BLOCK_HEAD.pack(int(least[k]), int(width), len(where)), packed[k],
                               where.astype("<u2").tobytes(), over[k, where].astype("<u4").tobytes())))
    return found


def decode_blocks(data: memoryview, starts: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` values of the blocks that begin at ``starts``."""
    heads = [BLOCK_HEAD.unpack_from(data, int(s)) for s in starts]
    result = np.zeros((len(starts), BLOCK), np.uint64)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        words = np.stack([np.frombuffer(data, "<u8", 16 * int(width), int(starts[r]) + BLOCK_HEAD.size) for r in rows])
        result[rows] = _unpack(words, int(width))
    for k, (least, width, patched) in enumerate(heads):
        if patched:
            at = int(starts[k]) + BLOCK_HEAD.size + 128 * width
            where = np.frombuffer(data, "<u2", patched, at)
            result[k, where] = np.frombuffer(data, "<u4", patched, at + 2 * patched)
        result[k] += np.uint64(least)
    return result.reshape(-1)[:count].astype(np.uint32)


def segment(partition: int, number: int, before: int, ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    """A segment without its end mark."""
    blocks = encode_blocks(values)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:len(blocks)]
    return b"".join((HEAD.pack(MAGIC, partition, number, before, len(ids), len(values), len(blocks)),
                     np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids], "u1").tobytes(),
                     np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks))


def segments(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, before, document ids, values of each document, all values) of every segment of a file."""
    view, at, end = memoryview(data), 0, END.encode()
    while at < len(data):
        magic, partition, _, before, docs, count, blocks = HEAD.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        ids = np.frombuffer(view, "<i8", docs, at)
        null = np.frombuffer(view, "u1", docs, at + 8 * docs)
        lengths = np.frombuffer(view, "<u8", docs, at + 9 * docs).astype(np.int64)
        index = np.frombuffer(view, "<u8", blocks, at + 17 * docs).astype(np.int64)
        at += 17 * docs + 8 * blocks
        values = decode_blocks(view, at + index, count)
        if blocks:
            at += int(index[-1])
            _, width, patched = BLOCK_HEAD.unpack_from(view, at)
            at += BLOCK_HEAD.size + 128 * width + 6 * patched
        if view[at:at + len(end)] != end:
            raise ValueError("a segment of a token file is cut off")
        at += len(end)
        yield partition, before, [None if n else int(x) for x, n in zip(ids, null)], lengths, values


class Encoder:
    """Token ids of whole texts as little-endian 32-bit words, by a tokenizer file of the tokenizers library.

    For byte-level tokenizers, whose pieces never go on past a single space or line break between other characters: every
    such stretch, with the space or break before it, is encoded once and then looked up. A batch is cut into stretches
    and numbered by Arrow, so that Python sees each different stretch of a batch once. Other tokenizers get whole texts
    (``by_word=False``).
    """

    def __init__(self, tokenizer_file: str, by_word: bool = True, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.by_word, self.remembered = by_word, remembered
        self.known: dict[str, bytes] = {}
        self.line_break = np.array(self._encode(["\n"])[0], "<u4")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_joined(self, words: list[str], before: bytes) -> None:
        """Remembers the ids of stretches without line breaks, which are encoded in long lines and cut at the breaks."""
        chunks = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        for chunk, ids in zip(chunks, self._encode(["\n".join(c) for c in chunks])):
            ids = np.array(ids, "<u4")
            cuts = np.flatnonzero(ids == self.line_break[0]) if len(self.line_break) == 1 else ids[:0]
            mark = "\n" if before else ""
            if len(cuts) == len(chunk) - 1:
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                starts = [0, *(e + 4 for e in ends[:-1])]
                self.known.update((mark + w, before + raw[i:j]) for w, i, j in zip(chunk, starts, ends))
            else:
                self.known.update((mark + w, before + np.array(x, "<u4").tobytes()) for w, x in zip(chunk, self._encode(chunk)))

    def _learn(self, new: list[str]) -> None:
        self._learn_joined([w for w in new if w[:1] != "\n"], b"")
        self._learn_joined([w[1:] for w in new if w[:1] == "\n"], self.line_break.tobytes())

    def _ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each stretch has)."""
        coded = stretches.dictionary_encode()
        each = coded.dictionary.to_pylist()
        if len(self.known) > self.remembered:
            self.known.clear()
        self._learn([w for w in each if w not in self.known])
        found = [self.known[w] for w in each]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, firsts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[codes] - (ends - counts), counts)
        return flat[at], counts

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and _single_spaces(t) for t in texts]
        result = [b""] * len(texts)
        odd = [k for k, p in enumerate(plain) if not p and texts[k]]
        whole = [_INNER_SPACE.split(texts[k]) if self.by_word else [texts[k]] for k in odd]
        flat = self._encode([w if not i else " " + w for ws in whole for i, w in enumerate(ws)])
        at = 0
        for k, ws in zip(odd, whole):
            result[k] = np.array([x for ids in flat[at:at + len(ws)] for x in ids], "<u4").tobytes()
            at += len(ws)
        rows = [k for k, p in enumerate(plain) if p]
        if rows:
            marked = [texts[k].replace(" ", CUT + " ").replace("\n", CUT + "\n") for k in rows]
            parts = pc.split_pattern(pa.array(marked, pa.large_string()), CUT)
            ids, counts = self._ids(parts.flatten())
            ends = np.concatenate(([0], np.cumsum(counts)))[parts.offsets.to_numpy()].tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            for k, i, j in zip(rows, ends[:-1], ends[1:]):
                result[k] = bytes(raw[4 * i:4 * j])
        return result


def _single_spaces(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between other characters, and :data:`CUT` is free."""
    if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", "\n\n", " \n", "\n ", CUT)):
        return False
    return not (any(x in text for x in ASCII_SPACES) if text.isascii() else _OTHER_SPACE.search(text))


@functools.lru_cache(1)
def _encoder(tokenizer_file: str, by_word: bool) -> Encoder:
    """One for a Python worker: what a task has looked up is there for the next."""
    return Encoder(tokenizer_file, by_word)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, by_word: bool = True) -> None:
    """Encodes every whole text, adds ``end_id`` and writes the ids under ``path`` in ascending order of whole-number ids.

    Texts are dealt by ranges of ids and encoded in order. A null text is empty, a null id comes first, and rows with
    equal ids are in the order of their texts. What a task holds is a batch of texts and one segment.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, by_word)
        end = np.array([end_id], "<u4").tobytes()
        partition, number, before = TaskContext.get().partitionId(), 0, 0
        ids, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(parts), "<u4")
            data = segment(partition, number, before, ids, [len(p) // 4 for p in parts], values)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for doc_id, data in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    ids.append(doc_id)
                    parts.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= SEGMENT_VALUES:
                        yield flush()
                        number, before = number + 1, before + held
                        ids, parts, held = [], [], 0
        if ids:
            yield flush()

    segs = rows.mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
    segs.write.option("lineSep", END).option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the files: partition, ``before`` (values of its partition before it), doc_id, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for partition, before, ids, lengths, values in segments(data.as_py()):
                    ends = np.cumsum(lengths)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, partition, np.int32)), pa.array(before + ends - lengths), pa.array(ids, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                                  pa.array(values.astype(np.int32)))],
                        ["partition", "before", "doc_id", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "partition int, before bigint, doc_id bigint, ids array<int>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files: where a document's ids start among all ids, how many
    there are, and the checksum of their little-endian bytes. The window runs over one row for each task that wrote."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for partition, before, ids, lengths, values in segments(data.as_py()):
                    ends = np.cumsum(lengths)
                    raw = memoryview(values.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), partition, np.int32)), pa.array(before + ends - lengths),
                         pa.array(ids, pa.int64()), pa.array(lengths), pa.array(sums, pa.int64())],
                        ["partition", "before", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = written(files.mapInArrow(run, "partition int, before bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"),
                   "token-index")
    totals = rows.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("partition", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "partition").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
