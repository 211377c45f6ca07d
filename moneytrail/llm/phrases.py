"""Phrases that occur more often than their parts would by chance, from sorted suffix pointers.

A phrase is frequent only if all its words, pairs and triples are, so passes over the texts narrow what is sorted: exact
counts of words, counts of the hashes of pairs of frequent words, then of triples of frequent pairs, and at last the
suffixes of up to ``MAX_WORDS`` words that begin at a frequent pair and end where a triple is not. Tasks know what is frequent
by bitmaps of ``BITS`` bits of the hashes. Their size does not depend on the corpus: what meets a bit by chance costs work
and is counted in words and dropped like any other, and nothing frequent is lost.

Suffixes are routed by their leading words into ranges, and every range is sorted by multikey quicksort: pointers are
parted in three by one word, the middle part goes on with the next word, and its size is the count of the words so far. A
middle part below the least count is abandoned, unless it touches an end of its range and may go on in the next one; those
are added up afterwards. The quicksort takes all parts of a level at once, so numpy does the work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.common import written

MAX_WORDS = 5
#: Bits of the bitmaps of frequent words and pairs.
BITS = 2 ** 25
#: Words that a task sorts together before it hands its counts on, bytes of a text that it takes apart at once. The arrays of
#: a block take some 230 bytes a word, and a Python worker keeps what it once took.
BLOCK_WORDS, BLOCK_BYTES = 700_000, 2_000_000
#: Distinct suffixes that a task holds at about before it hands them on.
HELD_ROWS = 400_000
#: Suffixes of a range at about.
RANGE_ROWS = 1_000_000
#: Buckets of phrases that are ranked before their language is.
RANK_BUCKETS = 256

#: What ends a piece, what parts words inside it.
PIECE_ENDS, GAPS = b".,;:!?\n\v\f\r", b" \t"
_TO_ENDS = bytes.maketrans(PIECE_ENDS + GAPS, b"." * len(PIECE_ENDS) + b" " * len(GAPS))


def multikey_sort(keys: np.ndarray, weights: np.ndarray, least: int, ends: bool) -> tuple[list, tuple]:
    """Sorts pointers to the rows of ``keys`` (n, depth; 0 where a row has ended). Returns for each depth the groups of rows
    that agree so far, as ``(a row of each, their weights)``, and in the same form the groups of wholly equal rows.

    Groups lighter than ``least`` are abandoned: neither returned nor sorted further; with ``ends``, except for those
    that hold the first or last row of the order.
    """
    n, deepest = keys.shape
    order = np.arange(n)
    start, size, depth = np.array([0] if n else [], np.int64), np.array([n] if n else [], np.int64), np.zeros(min(n, 1), np.int64)
    found: list[list] = [[] for _ in range(deepest)]
    equal: list[tuple] = []
    while len(start):
        part = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size                       # where each part begins among the open positions
        rows = order[np.arange(len(part)) - first[part] + start[part]]
        word = keys[rows, depth[part]]
        ends_of = (start, start + size // 2, start + size - 1)
        pivot = np.sort(np.stack([keys[order[x], depth] for x in ends_of]), axis=0)[1][part]
        sides = [word < pivot, word == pivot, word > pivot]
        counts = [np.add.reduceat(c.astype(np.int64), first) for c in sides]
        base = [start, start + counts[0], start + counts[0] + counts[1]]
        for side, number, b in zip(sides, counts, base):
            at = part[side]
            order[b[at] + np.arange(len(at)) - (np.cumsum(number) - number)[at]] = rows[side]
        # the middle parts are groups that agree in one more word, or have ended
        weight = np.add.reduceat(np.where(sides[1], weights[rows], 0), first)
        row = order[base[1]]
        goes_on = keys[row, depth] != 0
        keep = (weight >= least) | (ends & ((base[1] == 0) | (base[1] + counts[1] == n)))
        last = depth + 1 == deepest
        for d in range(deepest):
            here = goes_on & keep & (depth == d)
            found[d].append((row[here], weight[here]))
        here = keep & (last | ~goes_on)
        equal.append((row[here], weight[here]))
        deeper = np.where(goes_on & keep & ~last)[0]
        below, above = np.where(counts[0] > 0)[0], np.where(counts[2] > 0)[0]
        start = np.concatenate([base[0][below], base[2][above], base[1][deeper]])
        size = np.concatenate([counts[0][below], counts[2][above], counts[1][deeper]])
        depth = np.concatenate([depth[below], depth[above], depth[deeper] + 1])
    return [_joined(f) for f in found], _joined(equal)


def _joined(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*pieces))


class _Numbers(dict):
    """Numbers of the words of a language in the order of their first use; 0 is no word."""

    def __init__(self, lang: str, names: list):
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = n = len(self.names) - 1
        return n


class _Block:
    """The words of some texts as numbers, with 0 between pieces."""

    def __init__(self):
        self.names: list = [("", b"")]
        self.langs: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.length = 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        numbers = self.langs.get(lang)
        if numbers is None:
            numbers = self.langs[lang] = _Numbers(lang, self.names)
            numbers[b"."] = 0
        self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.length += len(tokens)


def _slices(text: str, portion: int) -> Iterator[list[bytes]]:
    """The words of a text in portions of bounded size, ``.`` for the end of a piece; no portion ends inside a word."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_ENDS)
    at = 0
    while at < len(data):
        end = at + portion
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b".", at, end))
            if cut < at:
                later = [x for x in (data.find(b" ", end), data.find(b".", end)) if x >= 0]
                cut = min(later) if later else len(data) - 1
            end = cut + 1
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def _blocks(batches: Iterator[pa.RecordBatch], reach: int, most: int, portion: int) -> Iterator[tuple[list, np.ndarray, int]]:
    """``(names, numbers, starts)``: blocks of words of which the first ``starts`` positions are not in any other block; the
    ``reach`` words after them are there to complete what begins before."""
    block = _Block()
    for batch in batches:
        for k in range(batch.num_rows):
            lang, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            for tokens in _slices(text or "", portion):
                block.add(lang, tokens)
                if block.length >= most + reach:
                    numbers = np.concatenate(block.parts)
                    yield block.names, numbers, len(numbers) - reach
                    rest = [block.names[i] for i in numbers[len(numbers) - reach:]] if reach else []
                    block = _Block()
                    for own, word in rest:
                        block.add(own, [word or b"."])
            block.add(lang, [b"."])
    if block.length:
        numbers = np.concatenate(block.parts)
        yield block.names, numbers, len(numbers)


def _hashes(names: list) -> np.ndarray:
    """What Spark's ``xxhash64(lang, word)`` gives for each name."""
    seeds: dict[str, int] = {}
    out = np.zeros(len(names), np.uint64)
    for i, (lang, word) in enumerate(names):
        if lang not in seeds:
            seeds[lang] = xxhash.xxh64_intdigest(lang.encode(), seed=42)
        out[i] = xxhash.xxh64_intdigest(word, seed=seeds[lang])
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _alive(numbers: np.ndarray, names: list, known: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For runs of 1, 2, ... words, by the position of their first: their hashes, and whether bitmaps have them and all
    their parts. The last run is one word longer than the bitmaps say and is alive if its parts are."""
    own = _hashes(names)
    runs, alive = [own[numbers]], [(_has(known[0], own) & (np.arange(len(names)) > 0))[numbers]]
    for m in range(1, len(known) + 1):
        # the next word's hash, turned by its place in the run
        turned = (runs[0] << np.uint64(m)) | (runs[0] >> np.uint64(64 - m))
        runs.append(runs[-1][:-1] ^ turned[m:])
        alive.append(alive[-1][:-1] & alive[-1][1:])
        if m < len(known):
            at = np.where(alive[m])[0]
            alive[m][at] = _has(known[m], runs[m][at])
    return runs, alive


def _bitmap(keys: DataFrame, value: Column) -> np.ndarray:
    """A bitmap of ``BITS`` bits over the hashes ``value`` of all ``keys``; that size is all that reaches the driver."""
    rows = keys.select((value.bitwiseAND(F.lit(BITS - 1)) + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        data = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at:at + len(data)] = data[:len(out) - at]
    return out


def _table(names: list, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Rows (lang, w1, ..., n) of words by their numbers; no word (0) is null."""
    words = pa.array([w.decode("utf-8", "surrogatepass") if i else None for i, (_, w) in enumerate(names)], pa.string())
    langs = pa.array([lang for lang, _ in names], pa.string())
    first = pa.array(columns[0])
    return pa.RecordBatch.from_arrays([langs.take(first), *[words.take(pa.array(c)) for c in columns], pa.array(counts.astype(np.int64))],
                                      names=["lang", *[f"w{i + 1}" for i in range(len(columns))], "n"])


def _schema(depth: int) -> str:
    return "lang string, " + ", ".join(f"w{i + 1} string" for i in range(depth)) + ", n long"


def _words(texts: DataFrame) -> DataFrame:
    """The words of each block with their number."""
    bounds = BLOCK_WORDS, BLOCK_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, numbers, starts in _blocks(batches, MAX_WORDS - 1, *bounds):
            tally = np.bincount(numbers[:starts], minlength=len(names))
            tally[0] = 0
            there = np.where(tally)[0]
            if len(there):
                yield _table(names, [there], tally[there])

    return texts.mapInArrow(count, _schema(1))


def _runs(texts: DataFrame, known: list[np.ndarray]) -> DataFrame:
    """``(h, n)``: hashes of the runs of one word more than ``known`` has bitmaps, if their parts are known, in each block."""
    bounds = BLOCK_WORDS, BLOCK_BYTES
    shared = [texts.sparkSession.sparkContext.broadcast(b) for b in known]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, numbers, starts in _blocks(batches, MAX_WORDS - 1, *bounds):
            runs, alive = _alive(numbers, names, [b.value for b in shared])
            h, n = np.unique(runs[-1][:starts][alive[-1][:starts]], return_counts=True)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(count, "h long, n long")


def _suffix_blocks(batches: Iterator[pa.RecordBatch], known: list[np.ndarray], bounds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each block with their number, equal ones as one row."""
    for names, numbers, starts in _blocks(batches, MAX_WORDS - 1, *bounds):
        alive = _alive(numbers, names, known)[1]
        triples = np.concatenate([alive[2], np.zeros(MAX_WORDS, bool)])
        begin = np.where(alive[1][:starts])[0]
        keys, on = np.zeros((len(begin), MAX_WORDS), np.int32), np.ones(len(begin), bool)
        padded = np.concatenate([numbers, np.zeros(MAX_WORDS, np.int64)])
        for d in range(MAX_WORDS):
            if d > 1:
                on = on & triples[begin + d - 2]
            keys[:, d] = np.where(on, padded[begin + d], 0)
        at, n = multikey_sort(keys, np.ones(len(keys), np.int64), 1, False)[1]
        if len(at):
            yield _table(names, [keys[at, d].astype(np.int64) for d in range(MAX_WORDS)], n)


def _suffixes(texts: DataFrame, known: list[np.ndarray]) -> DataFrame:
    """Suffixes of two words or more with their number in each task, cut where a pair or triple is not known."""
    bounds, held = (BLOCK_WORDS, BLOCK_BYTES), HELD_ROWS
    shared = [texts.sparkSession.sparkContext.broadcast(b) for b in known]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added_up(_suffix_blocks(batches, [b.value for b in shared], bounds), held)

    return texts.mapInArrow(count, _schema(MAX_WORDS))


def _added_up(blocks: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task's blocks with equal suffixes as one row; about ``most`` rows are held at once."""
    keys, held, rows = ["lang", *[f"w{i + 1}" for i in range(MAX_WORDS)]], [], 0
    for block in itertools.chain(blocks, [None]):
        if block is not None:
            held.append(block)
            rows += block.num_rows
        if held and (block is None or rows > most):
            total = pa.Table.from_batches(held).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            if block is None or total.num_rows > most // 2:
                yield from total.to_batches()
                total = total.slice(0, 0)
            held, rows = total.to_batches(), total.num_rows


def _ranges(suffixes: DataFrame, least: int) -> DataFrame:
    """``(lang, words, n)`` of all phrases of two words or more that occur at least ``least`` times among the suffixes."""
    columns = ["lang", *[f"w{i + 1}" for i in range(MAX_WORDS)]]
    ranges = suffixes.count() // RANGE_ROWS + 1

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).combine_chunks()
        texts = [rows.column(c).combine_chunks() for c in columns]
        # numbers in the order of the words' bytes, so that the first and last rows here are those of the range
        ordered = [pc.unique(texts[0]).drop_null(), pc.unique(pa.concat_arrays(texts[1:])).drop_null()]
        ordered = [x.take(pc.sort_indices(x)) for x in ordered]
        keys = np.stack([pc.fill_null(pc.add(pc.index_in(t, value_set=ordered[min(i, 1)]), 1), 0).to_numpy(zero_copy_only=False)
                         for i, t in enumerate(texts)], axis=1).astype(np.int32)
        groups, _ = multikey_sort(keys, rows.column("n").to_numpy(), least, True)
        for d in range(2, MAX_WORDS + 1):
            at, n = groups[d]
            if len(at):
                pick = pa.array(at)
                none = pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays([t.take(pick) if i <= d else none for i, t in enumerate(texts)] + [pa.array(n)],
                                                 names=[*columns, "n"])

    parts = suffixes.repartitionByRange(ranges, *columns).mapInArrow(sort, _schema(MAX_WORDS))
    return parts.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(
        "lang", F.array_compact(F.array(*columns[1:])).alias("words"), "n")


def phrase_counts(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``(lang, words, n)`` of every phrase of 1 to ``MAX_WORDS`` words that occurs at least ``least``
    times, and ``(lang, total)``, the number of all its words. Texts are lower-cased in A-Z only and split into pieces at
    ``PIECE_ENDS``; occurrences overlap, but stay inside a piece. A null language is ``und``, a null text has no words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    words = written(_words(texts).groupBy("lang", "w1").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.where(F.col("n") >= least)
    known = [_bitmap(words, F.xxhash64("lang", "w1"))]
    for _ in range(2):
        runs = _runs(texts, known).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        known.append(_bitmap(runs, F.col("h")))
    phrases = _ranges(written(_suffixes(texts, known), "suffixes"), least)
    return written(phrases.unionByName(words.select("lang", F.array("w1").alias("words"), "n")), "phrases"), totals


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))`` in whole numbers of 38 digits."""
    def wide(x: Column) -> Column:
        return x.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(22,0)") * wide(n).cast("decimal(16,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, cover_percent: int = 100, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of two to five words of each language.

    A phrase is scored by its weakest cut into two parts, ``floor(1000 * a * n / (l * r))``, the first of equal ones. A
    phrase inside a longer frequent one that has at least ``cover_percent`` of its occurrences is left out. Ties in score go by
    count, then by the phrase's bytes. A table without texts, or without frequent phrases, gives no rows; repeated rows and
    rows without an id count like any other, and no column but the two named is read.
    """
    phrases, totals = phrase_counts(docs, least, text, lang)
    named = phrases.select("lang", F.concat_ws(" ", "words").alias("part"), F.col("n").alias("f"))
    longer = phrases.where("size(words) > 1")
    cuts = longer.select("lang", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "k", F.expr("concat_ws(' ', slice(words, 1, k))").alias("left"),
                       F.expr("concat_ws(' ', slice(words, k + 1, 5))").alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(named.select("lang", F.col("part").alias(side), F.col("f").alias(count)), ["lang", side])
    # a row for each language
    cuts = cuts.join(totals, "lang").withColumn("score", score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r", F.col("total").alias("n"))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    inside = phrases.where("size(words) > 2").select("lang", "n", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), "
        "s -> concat_ws(' ', slice(words, s, m)))))")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    left = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < cover_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))).withColumn(
        "first", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("first") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
