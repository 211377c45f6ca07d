"""Repeated runs of lines by prefix doubling over line ids (operator 8).

Lines with a word are the symbols, blank lines are passed over. A class of equal runs is named by its first position
(document id, hash of the text, number of the line): equal runs have equal names, and the name says at once whether a
run has occurred before. A class with one position ends there; the classes that are left after a round are the
longest-common-prefix intervals of at least that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from moneytrail.llm.common import let, written

MIN_WORDS = 8
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, at, hashes, words) of every line with a word; ``at`` counts those lines."""
    def entries(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.length(F.translate(x, _BLANK, "")) > 0)
        return F.transform(full, lambda x: F.struct(
            F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(1), F.trim(x)).alias("b"),
            F.size(F.array_remove(F.split(x, "[ \\t-\\r]+"), "")).alias("words")))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
                       F.posexplode(let(_lines(F.col(text_col)), entries)).alias("at", "line"))
    return rows.select("id", "h", "at", F.col("line.a").alias("a"), F.col("line.b").alias("b"), F.col("line.words").alias("words"))


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` whose ``keys`` occur at two positions or more, with the first of them as ``name``. Hot keys cost one row
    per task before the shuffle, and AQE can split them where the names are joined back."""
    here = F.struct("id", "h", "at")
    classes = rows.groupBy(*keys).agg(F.min(here).alias(name), F.max(here).alias("_last")).where(
        F.col(name) != F.col("_last")).drop("_last")
    return rows.join(classes, keys)


def repeated_lines(positions: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, h, gone)`` from :func:`_positions`, which is read twice: for documents with later copies of runs, the numbers of their lines (those with a word,
    from 0) that lie in one.

    A run counts if it has ``min_words`` words or more in all. It is a later copy if the same lines also begin at an
    earlier position: in a document with a smaller id, or further up in the same one. Every maximal run is covered by
    the shortest runs of enough words that begin, or end, at each of its lines, and such a run has ``min_words`` lines at
    most; so the doubling ends after log2(min_words) rounds, whatever the length of the maximal runs.
    """
    # repeated rows of one document stand at equal positions: each counts once
    lines = written(_named(positions, ["a", "b"], "n0").drop("a", "b").distinct(), "lines")
    own = Window.partitionBy("id", "h").orderBy("at")
    ahead = lambda column, steps: F.first(column).over(own.rangeBetween(steps, steps))

    words_to = [F.sum("words").over(own.rangeBetween(0, k)) for k in range(min_words)]
    words_from = [F.sum("words").over(own.rangeBetween(-k, 0)) for k in range(min_words)]
    shortest = lambda sums: F.array_position(F.array(*[s >= min_words for s in sums]), True).cast("int")
    sized = lines.select("*", shortest(words_to).alias("forth"), shortest(words_from).alias("backward"))
    spans = written(sized.select("id", "h", F.explode(F.array(
        F.struct(F.col("at").alias("at"), F.col("forth").alias("size")),
        F.struct((F.col("at") - F.col("backward") + 1).alias("at"), F.col("backward").alias("size")))).alias("s")).select(
        "id", "h", "s.at", "s.size").where("size > 0").distinct(), "spans")

    names = lines.select("id", "h", "at", "n0")
    level, found = 0, []
    while True:
        step = 1 << level
        # runs of step to 2 step - 1 lines are two, overlapping, of this round's length
        sizes = spans.where((F.col("size") >= step) & (F.col("size") < 2 * step))
        left = sizes.join(names.withColumnRenamed("n0", "l"), ["id", "h", "at"])
        right = names.select("id", "h", F.col("at").alias("_to"), F.col("n0").alias("r"))
        both = left.withColumn("_to", F.col("at") + F.col("size") - step).join(right, ["id", "h", "_to"]).drop("_to")
        first = _named(both, ["size", "l", "r"], "n")
        found.append(written(first.where(F.struct("id", "h", "at") != F.col("n")).select("id", "h", "at", "size"), "found"))
        if 2 * step > min_words:
            break
        pairs = names.withColumn("n1", ahead("n0", step)).where("n1 IS NOT NULL")
        names = written(_named(pairs, ["n0", "n1"], "n2").select("id", "h", "at", F.col("n2").alias("n0")), "names")
        level += 1
    spans = reduce(DataFrame.unionByName, found)
    return spans.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list(
        F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)))).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines taken out of the texts, and a last column ``dedup``: struct
    of n_lines (with a word) and n_deleted. The rest of a text, blank lines included, stays as it is.

    Every row stays, if with an empty text. Null texts stay null. Rows that share id and text are the same place: none is
    a later copy of the other. Null ids come first. ``dedup`` must not be a column of ``docs``.
    """
    positions = written(_positions(docs, id_col, text_col), "positions")
    counted = positions.groupBy("id", "h").agg((F.max("at") + 1).alias("n"))
    facts = counted.unionByName(repeated_lines(positions, min_words), allowMissingColumns=True).groupBy(
        F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.max("n").alias("_n"), F.first("gone", True).alias("_gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("_own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    joined = keyed.join(facts, F.expr("_own <=> _id AND _hash = _h"), "left")
    text = F.col("row").getField(text_col)
    full = lambda x: F.length(F.translate(x, _BLANK, "")) > 0
    # (number of the next line with a word, lines that stay)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, x: F.struct(
        (acc["n"] + full(x).cast("int")).alias("n"),
        F.when(full(x) & F.array_contains(F.col("_gone"), acc["n"]), acc["kept"]).otherwise(
            F.concat(acc["kept"], F.array(x))).alias("kept"))
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.aggregate(_lines(text), start, step)["kept"], "\n"))
    shown = [cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*shown, F.struct(F.coalesce("_n", F.lit(0)).alias("n_lines"),
                                          F.coalesce(F.size("_gone"), F.lit(0)).alias("n_deleted")).alias("dedup"))
