"""Profile versions: the latest of every account, whatever was gathered, retried or lost."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from moneytrail.sources import tables
from moneytrail.sources.profile_store import ProfileStore

SCHEMA = "account string, as_of_us long, n long"


def _version(spark, k):
    """Version ``k`` holds the accounts that ``k`` or ``k + 1`` divide by three; account X comes in every one, later as older."""
    rows = [(f"A{i}", k, 100 * k + i) for i in range(30) if i % 3 in (k % 3, (k + 1) % 3)] + [("X", 100 - k, k)]
    return spark.createDataFrame(rows, SCHEMA)


def _want(spark, versions):
    best = {}
    for number, k in enumerate(versions):
        for r in _version(spark, k).collect():
            old = best.get(r["account"])
            if old is None or (r["as_of_us"], number) > old[0]:
                best[r["account"]] = ((r["as_of_us"], number), tuple(r))
    return sorted(v for _, v in best.values())


def _got(store):
    return sorted(map(tuple, store.load().select("account", "as_of_us", "n").collect()))


def test_ten_versions_stay_bounded(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"), keep=3)
    for k in range(10):
        assert store.save(_version(spark, k)) == k
        assert _got(store) == _want(spark, range(k + 1))
        kept = os.listdir(tmp_path / "p")
        assert sum(f.startswith("base") for f in kept) <= 2 and sum(f.startswith("delta") for f in kept) <= 6
        read = store.load().inputFiles()
        assert len({os.path.dirname(f) for f in read}) <= 3


def test_retries_and_half_written_folders(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"), keep=2)
    store.save(_version(spark, 0), 0)
    store.save(_version(spark, 0), 0)
    assert _got(store) == _want(spark, [0])
    store.save(_version(spark, 1), 1)  # gathered
    store.save(_version(spark, 1), 1)
    assert _got(store) == _want(spark, [0, 1])
    _version(spark, 5).write.parquet(str(tmp_path / "p" / "delta=2"))
    os.remove(tmp_path / "p" / "delta=2" / "_SUCCESS")  # its job was lost
    assert _got(store) == _want(spark, [0, 1])
    assert store.save(_version(spark, 2)) == 2
    assert _got(store) == _want(spark, [0, 1, 2])
    store.save(_version(spark, 3))
    shutil.copytree(tmp_path / "p" / "base=3", tmp_path / "p" / "base=9")
    os.remove(tmp_path / "p" / "base=9" / "_SUCCESS")
    assert _got(store) == _want(spark, [0, 1, 2, 3])


def test_ties_new_columns_nulls_and_nothing(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        store.load()
    store.save(spark.createDataFrame([], SCHEMA))
    assert store.load().count() == 0
    store.save(spark.createDataFrame([("A", 5, 1), ("B", None, 1), (None, 5, 1)], SCHEMA))
    store.save(spark.createDataFrame([("A", 5, 2), ("B", 1, 2), (None, 5, 2)], SCHEMA).withColumn("extra", F.lit("x")))
    store.save(spark.createDataFrame([("C", 1, 3)], SCHEMA))
    want = {("A", 5, 2, "x"), ("B", 1, 2, "x"), (None, 5, 2, "x"), ("C", 1, 3, None)}
    assert set(map(tuple, store.load().select("account", "as_of_us", "n", "extra").collect())) == want
    store.gather()
    assert set(map(tuple, store.load().select("account", "as_of_us", "n", "extra").collect())) == want
    assert tables.load_profiles(spark, str(tmp_path / "p")).count() == 4
