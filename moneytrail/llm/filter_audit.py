"""What a set of document filters does together: the exact share of every filter in the removals, and every order's steps.

All of it follows from one small table: how many documents fail each subset of the filters, per part of the corpus. From it
the removals ``v(S)`` of every coalition ``S`` are tabulated. A step of an order removes ``v(before + filter) - v(before)``,
and the Shapley value of a filter is the solution of the least squares problem whose coalitions are weighted by the Shapley
kernel, under the constraint that the shares add up to the removals of all filters. Its normal equations do not depend on
the data, so they are solved once, in rationals, for a unit removal of each coalition; the shares of a part are then whole
multiples of its removals and are summed as integers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import let, words, written

#: The filters of the audit in the order of their bits; each fails the documents that it would remove.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone. A: fewer than 50 words; B: fewer than 65 % distinct words; C: more
    than 5 % capitals ``[A-Z]``; D: one of ``#$%&*|``."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    found = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                                F.size(F.array_distinct(w)).cast("long").alias("d")))
    return let(found, lambda f: (F.when(f["n"] < MIN_WORDS, 1).otherwise(0)
                                 + F.when(100 * f["d"] < MIN_DISTINCT_PERCENT * f["n"], 2).otherwise(0)
                                 + F.when(100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text), 4).otherwise(0)
                                 + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """``matrix @ x = right`` by elimination; exact, for a regular matrix."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [row[n:] for row in rows]


def shapley_factors(n: int) -> list[list[Fraction]]:
    """``factors[i][S]``: what a unit removal of coalition ``S`` (a bit mask) adds to the share of filter ``i``.

    The shares minimize ``sum k(S) (v(S) - sum of S's shares)^2`` over the proper coalitions, with the Shapley kernel
    ``k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|))``, and add up to ``v`` of all filters. The unknowns are the shares and the
    multiplier of the constraint; the right sides are one column for each coalition.
    """
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    everyone = 2 ** n - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, everyone)}
    matrix = [[sum(k for s, k in kernel.items() if s >> i & 1 and s >> j & 1) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * (s >> i & 1) for s in range(everyone + 1)] for i in range(n)]
    right.append([Fraction(int(s == everyone)) for s in range(everyone + 1)])
    return solve(matrix, right)[:n]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic)`` of every row of ``docs``: its source, the bits of the filters that it fails and its
    labels. Written in the shared folder.

    A null text is empty, a null source the part of the empty string. Filter E fails a text that a smaller id has too,
    wherever in the table; a row without an id is neither a first nor a later copy and has no labels. Repeated rows of an id
    are no copies of each other; of repeated labels of an id, one that says good (toxic) is enough.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text_failures(text).alias("own"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest")), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.where("id IS NOT NULL").join(firsts, ["id", "digest"], "left").join(marks, "id", "left").select(
        "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.where("id IS NULL").select("part", F.col("own").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(nameless)


def coalition_table(rows: DataFrame, n: int) -> DataFrame:
    """Per part: ``total``, ``v``, ``v_good`` and ``v_toxic`` (removals of all ``2 ** n`` coalitions, by bit mask) and
    ``unique`` (documents that fail one filter only). Rows shrink to one per part and mask before they are shuffled twice."""
    cells = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("g"), F.sum(F.col("toxic").cast("long")).alias("t"))

    def removed(counts: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(counts)).otherwise(F.lit(0).cast("long")))
                         for s in range(2 ** n)])

    return cells.groupBy("part").agg(
        F.sum("n").alias("total"), removed("n").alias("v"), removed("g").alias("v_good"), removed("t").alias("v_toxic"),
        F.array(*[F.sum(F.when(F.col("mask") == 2 ** i, F.col("n")).otherwise(F.lit(0).cast("long"))) for i in range(n)]).alias("unique"))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, step by step, for every part of ``rows`` (part, mask, good, toxic), where bit ``i`` of the
    mask is a failure of filter ``i``.

    One row per ``part``, ``filter_order`` and ``step``: ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the
    filter, but was removed before), ``unique_fails``, ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``,
    the filter's share in the removals times the number of orders, which makes it whole. No parts give no rows. The orders
    are as many as the factorial of the number of filters, meant for up to seven.
    """
    n, orders = len(filters), factorial(len(filters))
    factors = [[x * orders for x in row] for row in shapley_factors(n)]
    if any(x.denominator != 1 for row in factors for x in row):
        raise ArithmeticError("shares are no whole multiples")
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, i in enumerate(order):
            after = before | 1 << i
            steps.append(f"struct('{''.join(filters[j] for j in order)}', {k + 1}, {i}, {before}, {after})")
            before = after
    shares = F.array(*[sum((F.lit(int(x)) * F.col("v")[s] for s, x in enumerate(row) if x), F.lit(0).cast("long")) for row in factors])
    table = coalition_table(rows, n).withColumn("shares", shares).selectExpr(
        "*", f"inline(array({', '.join(steps)})) AS (filter_order, step, i, before, after)")
    removed = F.col("v")[F.col("after")] - F.col("v")[F.col("before")]
    return table.select(
        "part", "filter_order", "step", (F.col("total") - F.col("v")[F.col("after")]).alias("kept"), removed.alias("removed"),
        (F.expr("v[shiftleft(1, i)]") - removed).alias("redundant"), F.col("unique")[F.col("i")].alias("unique_fails"),
        (F.col("v_good")[F.col("after")] - F.col("v_good")[F.col("before")]).alias("good_lost"),
        (F.col("v_toxic")[F.col("after")] - F.col("v_toxic")[F.col("before")]).alias("toxic_lost"),
        F.col("shares")[F.col("i")].alias("shapley"))
