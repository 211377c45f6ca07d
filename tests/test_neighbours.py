"""Nearest neighbours in cells: exact, and without copying rows to every block of their class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneytrail.operators import learning, neighbours

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def spread_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 60)), float(rng.normal(0, 4)), "few") for i in range(600)]
    rows += [(600 + i, 5.0, 5.0, "same") for i in range(50)]  # nothing to cut
    rows += [(700, 1.0, 1.0, "one"), (701, float("nan"), 1.0, "few"), (702, None, 1.0, "few"), (5, 1.0, 1.0, "few")]
    return spark.createDataFrame(rows, "id long, a double, b double, label string").persist()


def test_neighbours_in_many_blocks_are_those_of_all_pairs(spread_rows):
    rows = [r for r in spread_rows.collect() if r["a"] is not None and r["a"] == r["a"]]
    got = {(r["label"], r["id"]): r["neighbours"] for r in learning.nearest_neighbours(spread_rows, COLS, 4, block_rows=40).collect()}
    assert set(got) == {(r["label"], r["id"]) for r in rows if r["label"] != "one"}
    for r in rows:
        if r["label"] == "one" or r["id"] == 5:  # an id that comes twice
            continue
        near = sorted((round((x["a"] - r["a"]) ** 2 + (x["b"] - r["b"]) ** 2, 6), x["id"]) for x in rows
                      if x["label"] == r["label"] and x["id"] != r["id"])[:4]
        mine = got[(r["label"], r["id"])]
        assert [round((n["y"][0] - r["a"]) ** 2 + (n["y"][1] - r["b"]) ** 2, 6) for n in mine] == [d for d, _ in near]
        if r["label"] == "same":
            assert [n["n"] for n in mine] == [i for _, i in near]


def test_rows_are_copied_to_near_blocks_only(spark):
    line = spark.range(4000).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit("x").alias("label"))
    first, spread = neighbours.own_blocks(line, COLS, 3, 100)
    assert spread.count() == 40 and spread.agg(F.max("blocks")).first()[0] <= 3
    assert first.count() == 4000
    assert first.agg(F.sum(F.size("asked"))).first()[0] < 4000  # 40 copies a row before


def test_cells_hold_every_row_once():
    x = np.random.default_rng(2).normal(size=(500, 3))
    tree = neighbours.cut_cells(x, 8)
    cell = neighbours.cell_of(x, tree)
    assert sorted(set(cell.tolist())) == list(range(8)) and np.bincount(cell).max() < 130
    assert neighbours.cell_of(x, neighbours.cut_cells(np.empty((0, 3)), 4)).max() == 0
