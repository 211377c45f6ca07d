"""Quality rules with thresholds from mergeable quantile sketches per language and source (operator 2).

A sketch of a metric is a table of counts per bucket. A bucket keeps the seven leading bits of a whole number, so every
quantile read from a sketch is at most 1/64 below the exact one. Sketches of parts of a corpus merge by adding counts,
which is also how the sketch of a language is made from those of its sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from moneytrail.llm.common import let, words, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects values further than ``reach`` spreads outside the middle half of the group; spread is the width of that
    half, ``least`` at least, so that a group of equal values does not reject everything else."""

    metric: str
    least: int
    reach: int = 3
    low: bool = False
    high: bool = True


#: Metrics are whole numbers per 1000 words.
RULES = (
    Rule("word_length", least=500, reach=4, low=True),
    Rule("symbols", least=100),
    Rule("dup_lines", least=50),
    Rule("repeats", least=100),
)
#: A group with fewer documents takes the thresholds of its language, a language with fewer those of the whole corpus.
MIN_GROUP = 200


def _repeated_words(tokens: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more in the text."""
    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(by_hash: Column) -> Column:
        again = F.filter(by_hash, lambda s, j: F.coalesce(F.get(by_hash, j - 1)["h"] == s["h"], F.lit(False))
                         | F.coalesce(F.get(by_hash, j + 1)["h"] == s["h"], F.lit(False)))
        return F.array_sort(F.transform(again, lambda s: s["i"]))

    def count(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(by_hash, starts), covered))

    return let(let(tokens, hashes), count)


def measure(text: Column) -> Column:
    """Struct of the base measurements of a whole text; a null text has no words.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.
    """
    whole = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))

    counts = let(words(whole), of)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def full(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"), F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"))

    return let(counts, full)


def _metrics(m: Column) -> dict[str, Column]:
    per_mille = lambda x: F.call_function("div", x * 1000, F.greatest(m["n_words"], F.lit(1)))
    return {"word_length": per_mille(m["word_chars"]), "symbols": per_mille(m["n_symbols"]),
            "dup_lines": per_mille(m["n_dup_lines"]), "repeats": per_mille(m["n_repeat_words"])}


def sketch(measured: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, n)`` of rows (lang, source, m); rows without words have no rates and do not
    count. Partial aggregation makes a hot group as cheap as any other."""
    def entries(m: Column) -> Column:
        each = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("v")) for k, v in _metrics(m).items()])
        return F.filter(each, lambda _: m["n_words"] > 0)

    flat = measured.select("lang", "source", F.explode(let(F.col("m"), entries)).alias("e")).select(
        "lang", "source", "e.metric", "e.v")
    bits = flat.withColumn("s", F.greatest(F.lit(0), F.length(F.bin("v")) - 7))
    return bits.groupBy("lang", "source", "metric", F.expr("shiftleft(shiftright(v, s), s)").alias("bucket")).agg(
        F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that the given sketches have counted."""
    first, *rest = sketches
    for s in rest:
        first = first.unionByName(s)
    return first.groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(sketched: DataFrame, *keys: str) -> DataFrame:
    """Per group of ``keys``: its rows and the limits of every metric, as columns. A window holds the buckets of one
    group and metric: 64 per power of two at most."""
    merged = sketched.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.select(*keys, "metric", "bucket", F.sum("n").over(group).alias("total"),
                           F.sum("n").over(group.orderBy("bucket")).alias("up_to"))
    cuts = ranked.groupBy(*keys, "metric").agg(
        F.first("total").alias("total"), F.min(F.when(F.expr("4 * up_to >= total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("4 * up_to >= 3 * total"), F.col("bucket"))).alias("q3"))
    aggs = [F.max("total").alias("total")]
    for r in RULES:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least)) * r.reach
        mine = F.col("metric") == r.metric
        if r.low:
            aggs.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"{r.metric}_low"))
        if r.high:
            aggs.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{r.metric}_high"))
    return cuts.groupBy(*keys).agg(*aggs)


def limits(sketched: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row of limits for every language and source: its own, its language's or the corpus's."""
    own = _quartiles(sketched, "lang", "source").alias("a")
    by_lang = _quartiles(sketched, "lang").alias("b")
    whole = _quartiles(sketched.withColumn("every", F.lit(1)), "every").alias("c")
    names = [c for c in _limit_columns()]
    joined = (own.join(by_lang, F.expr("a.lang <=> b.lang"), "left").join(F.broadcast(whole), F.lit(True), "left"))
    pick = lambda c: (F.when(F.col("a.total") >= min_group, F.col(f"a.{c}"))
                      .when(F.col("b.total") >= min_group, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
    return joined.select("a.lang", "a.source", *[pick(c) for c in names])


def _limit_columns() -> list[str]:
    return [f"{r.metric}_{side}" for r in RULES for side in ("low", "high") if getattr(r, side)]


def judge(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """``measured`` (lang, source, m, any other columns) with ``kept``: the base has not failed and no metric is outside
    the limits of the row's language and source."""
    cut = limit.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                       F.struct(*_limit_columns()).alias("_cut"))
    joined = measured.join(cut, F.expr("lang <=> _lang AND source <=> _source"), "left")

    def verdict(m: Column) -> Column:
        metrics, outside = _metrics(m), F.lit(False)
        for r in RULES:
            if r.low:
                outside = outside | (metrics[r.metric] < F.col("_cut")[f"{r.metric}_low"])
            if r.high:
                outside = outside | (metrics[r.metric] > F.col("_cut")[f"{r.metric}_high"])
        return ~m["base_failed"] & ~F.coalesce(outside, F.lit(False))

    # ``m`` is named once, so that the optimizer cannot copy its measuring into every comparison
    kept = let(F.col("m"), verdict)
    return joined.withColumn("kept", kept).drop("_lang", "_source", "_cut")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """One row per document: id, the base measurements, ``base_failed`` and ``kept``.

    Texts are read once; what later steps need of them are some numbers per document. Null languages and sources are
    groups like any other, a null or empty text fails the base, repeated rows and ids get a row each, and other columns
    do not matter.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                               F.col(source_col).alias("source"), measure(F.col(text_col)).alias("m")), "measured")
    judged = judge(rows, limits(sketch(rows)))
    return judged.select("id", "m.*", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns only. Texts are measured once and written beside what
    was measured, so that the second pass neither measures nor shuffles them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = written(docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), row,
                               measure(F.col(text_col)).alias("m")), "measured")
    cut = written(limits(sketch(rows)), "limits")
    return judge(rows, cut).where("kept").select("row.*")
