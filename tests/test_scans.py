"""History scans: hot keys, causality, partition counts, plan shape, medians."""

import os
import re
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moneytrail.constants import HOUR_US
from moneytrail.operators import features, history, ledger, medians, rules, windows
from moneytrail.plans.hot import HotKeys, find_hot_keys
from moneytrail.plans.scan import Measure, prior
from moneytrail.sources import views


@pytest.fixture(scope="module")
def hot(tx):
    keys = tuple(r[0] for r in tx.select("sender_account").distinct().collect())[:8]
    return HotKeys(keys, 2 * HOUR_US)


@pytest.fixture(scope="module")
def hot_accounts(tx):
    both = tx.select("sender_account").union(tx.select("receiver_account")).distinct()
    return HotKeys(tuple(r[0] for r in both.collect())[::2], 3 * HOUR_US)


def same(a, b):
    columns = a.columns
    assert a.exceptAll(b.select(*columns)).count() == 0
    assert a.count() == b.count()


def test_find_hot_keys(tx):
    assert not find_hot_keys(tx, "sender_account")
    found = find_hot_keys(tx, "sender_account", max_rows=60)
    counts = {r[0]: r[1] for r in tx.groupBy("sender_account").count().collect()}
    assert set(found.keys) == {k for k, n in counts.items() if n > 60}


def test_rules_split_over_chunks(tx, hot):
    pick = ["id", "rule_score", "rule_reason"]
    same(rules.assess_rules(tx).select(*pick), rules.assess_rules(tx, hot).select(*pick))


def test_sender_history_split_over_chunks(tx, hot):
    same(history.sender_history(tx), history.sender_history(tx, hot=hot))


def test_party_history_split_over_chunks(tx, hot_accounts):
    same(history.party_history(tx), history.party_history(tx, hot_accounts))


def test_reverse_transfers_split_over_chunks(tx, hot_accounts):
    same(ledger.reverse_transfers(tx), ledger.reverse_transfers(tx, hot_accounts))


def test_balances_split_over_chunks(tx, hot_accounts):
    rows = ledger.account_ledger(tx)
    for floor in (False, True):
        same(windows.running_balance(rows, floor=floor), windows.running_balance(rows, floor=floor, hot=hot_accounts))


def test_future_rows_change_nothing(tx):
    cut = tx.agg(F.percentile_approx("ts_us", 0.5)).first()[0]
    before = rules.assess_rules(tx.where(F.col("ts_us") <= cut)).select("id", "rule_score")
    after = rules.assess_rules(tx).where(F.col("ts_us") <= cut).select("id", "rule_score")
    same(before, after)


def test_order_and_partitions_do_not_matter(tx):
    pick = ["id", *features.FEATURES_25]
    a = features.features_25(tx.repartition(1)).select(*pick)
    b = features.features_25(tx.orderBy(F.rand(3)).repartition(13)).select(*pick)
    same(a, b)


def expected_medians(tx):
    by = defaultdict(list)
    for r in tx.select("id", "sender_account", "ts_us", "cents").collect():
        by[r["sender_account"]].append((r["ts_us"], r["id"], r["cents"]))
    want = {}
    for rows in by.values():
        for t, i, c in rows:
            want[i] = int(2 * statistics.median([x for u, _, x in rows if u < t] + [c]))
    return want


def test_medians_small_and_large_accounts(tx, monkeypatch):
    want = expected_medians(tx)
    got = {r["id"]: r["median_cents2"] for r in medians.running_median(tx).collect()}
    assert got == want
    monkeypatch.setattr(medians, "_SMALL", 20)
    got = {r["id"]: r["median_cents2"] for r in medians.running_median(tx).collect()}
    assert got == want


def test_medians_hot_accounts(tx, hot):
    few = HotKeys(hot.keys[:3], hot.chunk_us)
    rows = tx.where(few.is_hot(F.col("sender_account")))
    got = {r["id"]: r["median_cents2"] for r in medians.running_median(rows, few).collect()}
    assert got == expected_medians(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_shuffle_once(spark, tiny):
    text = plan(rules.rule_hits(rules.assess_rules(views.transactions(spark, tiny))))
    assert text.count("Exchange ") == 1
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_sender_history_shuffles_once(spark, tiny):
    assert plan(history.sender_history(views.transactions(spark, tiny))).count("Exchange ") == 1


def test_newest_rows_are_limited_before_the_shuffle(spark, tiny):
    text = plan(windows.latest_per_account(ledger.account_ledger(views.transactions(spark, tiny)), 500))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_reads_only_needed_columns(spark, tiny):
    text = plan(views.accounts(spark, tiny).select("account_number", "pep_flag"))
    assert "c_name" not in text and "c_acctbal" not in text


def test_stable_rows_use_the_shared_folder(spark, tx):
    from moneytrail.session import checkpoint_dir, stable
    rows = stable(tx.select("id"))
    assert rows.count() == tx.count()
    assert any(files for _, _, files in os.walk(checkpoint_dir(spark)))


def test_medians_of_all_longs_agree_on_every_path(spark, monkeypatch):
    """Negative, equal and very large amounts: sorted, over heaps and digit by digit."""
    cents = {"A": [-500, 200, 300, 95, 2 ** 41, 7, -3, 50], "B": [-2 ** 62 + 5, 2 ** 61, -1, 0, 3, -2 ** 40], "C": [7, 7, 7], "D": [2 ** 60]}
    rows = [(1000 * n + i, s, 60_000_000 * (i // 2), c) for n, (s, values) in enumerate(cents.items()) for i, c in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, sender_account string, ts_us long, cents long")
    want = {}
    for n, s, t, c in rows:
        known = sorted([x for _, o, u, x in rows if o == s and u < t] + [c])
        want[n] = known[(len(known) - 1) // 2] + known[len(known) // 2]
    for hot in (HotKeys(), HotKeys(tuple("ABCD")), HotKeys(("C",)), HotKeys(("Z",))):
        assert {r["id"]: r["median_cents2"] for r in medians.running_median(df, hot).collect()} == want
    monkeypatch.setattr(medians, "_SMALL", 0)
    assert {r["id"]: r["median_cents2"] for r in medians.running_median(df).collect()} == want


def test_newest_rows_of_hot_accounts(spark, tiny):
    book = ledger.account_ledger(views.transactions(spark, tiny))
    accounts = tuple(r[0] for r in book.select("account").distinct().collect())
    for n in (3, 50):
        plain = windows.latest_per_account(book, n)
        same(plain, windows.latest_per_account(book, n, HotKeys(accounts[::2])))
        same(plain, windows.latest_per_account(book, n, HotKeys(accounts), parts=5))


def leave_events(df):
    """The most leave events that a scan of the plan makes of a row."""
    return max(int(n) for n in re.findall(r"sequence\(0, (\d+)", df._jdf.queryExecution().analyzed().toString()))


def test_rows_leave_only_for_windows_that_are_read(spark, tiny):
    tx = views.transactions(spark, tiny)
    # a day, ten minutes, the end of the day; three spans and two of recipients
    assert leave_events(features.features_25(tx)) == 3
    assert leave_events(features.features_82(tx, views.accounts(spark, tiny), 0)) == 5


@pytest.mark.parametrize("hot", [HotKeys(), HotKeys(("a",), 10)])
def test_measures_that_expire_together_share_one_leave_event(spark, hot):
    rows = spark.createDataFrame([(1, "a", 0, 5, 3), (2, "a", 2, 9, 5), (3, "a", 3, None, 7), (4, "a", 6, 30, None), (5, "a", 20, 30, 1),
                                  (6, "b", 20, 30, 1), (7, None, 1, 4, 2), (8, None, 3, 4, 2)],
                                 "id long, k string, ts_us long, ends long, v long")
    one, ends = F.lit(1).cast("long"), F.col("ends")
    seen = prior(rows, "k", [Measure("n", one, expires=ends), Measure("total", F.col("v"), expires=ends)], hot=hot)
    apart = prior(rows, "k", [Measure("n", one, expires=F.col("ends")), Measure("total", F.col("v"), expires=F.col("ends") + 0)], hot=hot)
    want = {1: (0, 0), 2: (1, 3), 3: (2, 8), 4: (2, 12), 5: (2, 7), 6: (0, 0), 7: (0, 0), 8: (1, 2)}
    assert leave_events(seen) == 1 and leave_events(apart) == 2
    for df in (seen, apart):
        assert {r["id"]: (r["n"], r["total"]) for r in df.collect()} == want
