"""Streams equal batches; retries, duplicates and progress."""

from pyspark.sql import functions as F

from moneytrail.operators import adaptive, profiles, rules
from moneytrail.sources import events, tables, views
from moneytrail.sources.schema import DEFAULTS, TABLES, conform_schema
from moneytrail.streaming import jobs, log


def test_batches_see_history(spark, tiny, tx, tmp_path):
    """Two micro-batches over a split table score exactly like one batch over all of it."""
    cut = tx.agg(F.percentile_approx("ts_us", 0.6)).first()[0]
    src = str(tmp_path / "in")
    tx.where(F.col("ts_us") > cut).repartition(1).write.parquet(src)
    stream = jobs.stream_transactions(spark, src, tx.schema)
    out = str(tmp_path / "out")
    accounts, watch = views.accounts(spark, tiny), views.watchlist(spark, tiny)
    names = spark.createDataFrame([], "p_name string, w_name string, score double")
    q = jobs.stream_score(stream, tx.where(F.col("ts_us") <= cut), accounts, watch, out, str(tmp_path / "cp"),
                          pairs=names)
    q.awaitTermination()
    got = spark.read.parquet(out + "/scored").select("id", F.size(F.filter("rules", lambda h: h["rule_id"] != "SCREENING")).alias(
        "n"))
    want = rules.assess_rules(tx).where(F.col("ts_us") > cut).select("id", F.size("rules").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    counted = log.BatchLog(spark, out + "/log", stream.schema).progress().first()
    assert counted["rows"] == got.count() and counted["late"] == counted["invalid"] == 0
    assert sum(p["numInputRows"] for p in jobs.monitor_progress(q)) >= got.count()


def _velocity_by_hand(rows):
    """Plain counts of ``(id, us, sender)`` over the hour and the day before."""
    out = {}
    for i, us, sender in rows:
        ages = [us - t for _, t, s in rows if s == sender and t < us]
        out[i] = (sum(a <= 3_600_000_000 for a in ages), sum(a <= 86_400_000_000 for a in ages))
    return out


def test_log_retries_late_rows_and_corrections(spark, tmp_path):
    """Five batches with a segment of two, one of them repeated: every row sees the batches before its own once."""
    hour = 3_600_000_000
    base = 1_700_000_000_000_000
    batches = [[(1, 0, "A"), (2, hour, "B")], [(3, hour // 2, "A"), (4, 2 * hour, "B")], [(5, hour, "A")],
               [(6, 3 * hour, "A"), (7, None, "A"), (8, -30 * hour, "B"), (9, 3 * hour, None)], [(10, 4 * hour, "A"), (11, 4 * hour, "B")]]
    schema = "id long, ts timestamp, sender_account string, receiver_account string, amount decimal(18,2), ts_us long, cents long"

    def frame(rows):
        made = spark.createDataFrame([(i, None if t is None else base + t, s) for i, t, s in rows], "id long, us long, s string")
        return made.select("id", F.timestamp_micros("us").alias("ts"), F.col("s").alias("sender_account"),
                           F.lit("R").alias("receiver_account"), F.lit(1).cast("decimal(18,2)").alias("amount"),
                           F.col("us").alias("ts_us"), F.lit(100).cast("long").alias("cents"))

    empty, out = spark.createDataFrame([], schema), str(tmp_path / "out")
    kept = log.BatchLog(spark, out + "/log", empty.schema, segment=2)
    for n in (0, 1, 2, 2, 3, 4, 4):
        jobs._batch(frame(batches[n]), n, empty, out, kept, 24 * hour, 24 * hour, jobs.velocity)
    got = {r["id"]: (r["count_1h"], r["count_24h"]) for r in spark.read.parquet(out + "/scored").collect()}
    late = {r["id"] for r in spark.read.parquet(out + "/late").collect()}
    assert late == {7, 8} and set(got) == {1, 2, 3, 4, 5, 6, 9, 10, 11}
    timed = [(i, base + t, s) for b in batches for i, t, s in b if t is not None]
    want = _velocity_by_hand(timed)
    assert {i: v for i, v in got.items() if i != 9} == {i: v for i, v in want.items() if i in got and i != 9}
    counts = {r["log_batch"]: (r["rows"], r["invalid"], r["late"], r["last_id"]) for r in kept.progress().collect()}
    assert counts == {0: (2, 0, 0, 2), 1: (2, 0, 0, 4), 2: (1, 0, 0, 5), 3: (4, 1, 2, 9), 4: (2, 0, 0, 11)}
    fixed = jobs.correct_late(spark, empty, out, empty.schema, jobs.velocity, 5).collect()
    assert {r["id"]: (r["count_1h"], r["count_24h"]) for r in fixed} == {i: want[i] for i in (2, 4, 8, 11)}


def test_watchlist_changes_between_batches(spark, tiny, tx, tmp_path):
    """An entry added after the first batch hits in the second."""
    accounts, src, out, lists = views.accounts(spark, tiny), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "list")
    listed = views.watchlist(spark, tiny)
    listed.where("false").write.parquet(lists)
    sender = tx.join(accounts.select(F.col("account_number").alias("sender_account"), "id_number"), "sender_account").first()
    rows = tx.where(F.col("sender_account") == sender["sender_account"])
    cut = rows.agg(F.percentile_approx("ts_us", 0.5)).first()[0]
    names = spark.createDataFrame([], "p_name string, w_name string, score double")
    for part in (rows.where(F.col("ts_us") <= cut), rows.where(F.col("ts_us") > cut)):
        part.write.mode("append").parquet(src)
        jobs.stream_score(jobs.stream_transactions(spark, src, tx.schema), tx.where("false"), accounts,
                          lambda: spark.read.parquet(lists), out, str(tmp_path / "cp"), pairs=names).awaitTermination()
        spark.createDataFrame([(1, "No One", sender["id_number"], None, "sanctions", None)], listed.schema).write.mode("append").parquet(lists)
    hit = spark.read.parquet(out + "/scored").select("id", "ts_us", F.exists("screening_hits", lambda h: h["match_type"] == "exact_id").alias("hit"))
    assert {r["hit"] for r in hit.where(F.col("ts_us") <= cut).collect()} == {False}
    assert {r["hit"] for r in hit.where(F.col("ts_us") > cut).collect()} == {True}


def test_burst_session_edge(spark):
    """Five minutes exactly still joins a session; a microsecond more does not."""
    base = 1_700_000_000_000_000
    times = [0, 300_000_000, 600_000_000, 900_000_001]
    df = spark.createDataFrame([(i, "A", base + t, 100) for i, t in enumerate(times)],
                               "id long, sender_account string, us long, cents long")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    assert sorted(r["n"] for r in jobs.burst_sessions(df).collect()) == [1, 3]


def test_profile_update_equals_plain_fold(spark, tx):
    cut = tx.agg(F.percentile_approx("ts_us", 0.6)).first()[0]
    base = profiles.build_profiles(tx, cut)
    later = tx.where(F.col("ts_us") >= cut)
    got = {r["account"]: r for r in adaptive.update_profiles(base, later).collect()}
    rows = {}
    for r in adaptive.updates(later).orderBy("ts_us", "id").toPandas().itertuples(index=False):
        rows.setdefault(r.account, []).append(r)
    for start in adaptive.profile_state(base).collect():
        want = adaptive.fold_rows(adaptive._unpack(start.asDict()), rows.get(start["account"], []))
        g = got[start["account"]]
        assert g["total_transactions"] == want["total_transactions"]
        for name in ("avg_amount", "std_amount", "min_amount", "max_amount"):
            assert abs(g[name] - want[name]) < 1e-6
        for name in ("channel_distribution", "type_distribution", "common_recipients", "common_countries"):
            assert set(g[name]) == set(want[name]), name
            assert all(abs(g[name][k] - want[name][k]) < 1e-9 for k in want[name]), name
        assert g["preferred_channels"] == want["preferred_channels"] and len(g["preferred_channels"]) <= 3
        assert [r["id"] for r in g["recent"]] == [r["id"] for r in want["recent"]]


def test_long_histories_are_folded_whole(spark):
    """A hundred transfers to one recipient, then nine thousand to another: both stay known, and the last fifty rows."""
    tx = spark.range(9_100).select(
        "id", F.lit("A").alias("sender_account"), (F.col("id") * 1000).alias("ts_us"), F.lit(10.0).alias("amount"), F.lit("online").alias("channel"),
        F.lit("transfer").alias("transaction_type"), F.when(F.col("id") < 100, "RA").otherwise("RB").alias("receiver_account"),
        F.lit("ZW").alias("destination_country")).repartition(7)
    start = spark.createDataFrame([("A", 0, 10.0, 0.0, 10.0, 10.0, {}, {}, {}, {}, 0.0, 0.0), ("B", 5, 1.0, 0.5, 1.0, 2.0, {"atm": 1.0}, {}, {}, {"FR": 0.1}, 0.0, 1.0)],
                                  "account string, total_transactions long, avg_amount double, std_amount double, min_amount double, max_amount double, "
                                  "channel_distribution map<string,double>, type_distribution map<string,double>, common_recipients map<string,double>, "
                                  "common_countries map<string,double>, recipient_diversity double, international_ratio double")
    got = {r["account"]: r for r in adaptive.fold_accounts(start, adaptive.updates(tx)).collect()}
    assert set(got["A"]["common_recipients"]) == {"RA", "RB"} and got["A"]["recipient_diversity"] > 1.9
    assert got["A"]["total_transactions"] == 9_100 and [r["id"] for r in got["A"]["recent"]] == list(range(9_050, 9_100))
    assert got["B"]["total_transactions"] == 5 and got["B"]["preferred_channels"] == ["atm"] and got["B"]["recent"] == []
    more = adaptive.fold_accounts(start, adaptive.updates(tx.withColumn("sender_account", F.lit("C"))), new_accounts=True)
    assert {r["account"]: r["total_transactions"] for r in more.collect()} == {"A": 0, "B": 5, "C": 9_100}


def test_events_and_profiles_round_trip(spark, tiny, tx, tmp_path):
    rows = events.envelope(events.balance_payload(views.accounts(spark, tiny)), "balance", F.col("user_id"))
    events.write_events(rows, "json", str(tmp_path / "events"))
    back = spark.read.json(str(tmp_path / "events"))
    assert back.count() == rows.count() and set(back.columns) == {"topic", "key", "value"}
    cut = tx.agg(F.max("ts_us")).first()[0]
    for moment in (cut - 3_600_000_000, cut):
        tables.save_profiles(profiles.build_profiles(tx, moment), str(tmp_path / "profiles"))
    kept = tables.load_profiles(spark, str(tmp_path / "profiles"))
    assert kept.select("account").distinct().count() == kept.count()
    assert kept.where(F.col("as_of_us") == cut).count() == kept.count()


def test_read_tables_conform(spark, tx, tmp_path):
    old = tx.select("id", "ts", "sender_account", "receiver_account", "amount", "transaction_type")
    old.write.parquet(str(tmp_path / "t"))
    row = tables.read_transactions(spark, str(tmp_path / "t")).first()
    assert row["channel"] == "online" and row["destination_country"] == "ZW" and row["cents"] is not None
    empty = conform_schema(spark.createDataFrame([(1,)], "id long"), TABLES["accounts"], DEFAULTS["accounts"]).first()
    assert empty["risk_rating"] == "standard" and empty["username"] is None
