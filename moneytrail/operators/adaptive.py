"""Adaptive profile update: recent behaviour replaces old behaviour at a rate that falls with maturity and anomaly.

The update of one transaction depends on all before it: lists are cut to ten after every step, shares are normalised.
So every account is folded in order of time: rows are dealt by account and sorted inside the partitions, and one pass
carries the state of the account it is in from batch to batch. A task holds one Arrow batch and one state, however long the
history; nothing is cut off. One account is folded by one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import COUNTRY_LISTS
#: Newest transactions that a profile keeps, preferred channels and types that it names, states written at a time.
RECENT, PREFERRED, WRITTEN = 50, 3, 1_000
STATE_SCHEMA = ("account string, total_transactions long, avg_amount double, std_amount double, min_amount double, "
                "max_amount double, channel_distribution map<string,double>, type_distribution map<string,double>, "
                "common_recipients map<string,double>, common_countries map<string,double>, "
                "recipient_diversity double, international_ratio double, preferred_channels array<string>, "
                "preferred_types array<string>, recent array<struct<id: bigint, ts_us: bigint, amount: double, "
                "channel: string, kind: string, receiver: string, country: string>>")


def _mix(shares: dict, key: str, alpha: float) -> dict:
    shares = dict(shares)
    shares[key] = shares.get(key, 0.0) * (1 - alpha) + alpha
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()} if total > 0 else shares


def _top(weights: dict, n: int = 10) -> dict:
    return dict(sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:n])  # ties by name: repeatable


def _preferred(shares: dict) -> list:
    return list(_top(shares, PREFERRED))


def _step(s: dict, r) -> None:
    """One transaction, in place."""
    s["total_transactions"] += 1
    a = 0.05 * (1.0 - r.score / 200) * (1 - min(1.0, s["total_transactions"] / 100) * 0.5)
    s["avg_amount"] = s["avg_amount"] * (1 - a) + r.amount * a
    s["std_amount"] = s["std_amount"] * (1 - a) + abs(r.amount - s["avg_amount"]) * a
    s["min_amount"], s["max_amount"] = min(s["min_amount"], r.amount), max(s["max_amount"], r.amount)
    s["channel_distribution"] = _mix(s["channel_distribution"], r.channel, a)
    s["type_distribution"] = _mix(s["type_distribution"], r.kind, a)
    if r.kind == "transfer" and r.receiver:
        fresh = {c: (w * (1 - a) + a if c == r.receiver else w * (1 - a * 0.5)) for c, w in s["common_recipients"].items()}
        fresh.setdefault(r.receiver, a)
        s["common_recipients"] = _top(fresh)
        total = sum(s["common_recipients"].values())
        if total > 0:
            s["recipient_diversity"] = len(s["common_recipients"]) / total
    seen = s["common_countries"]
    fresh = {c: (w + a if c == r.country else w * 0.99) for c, w in seen.items()}
    if r.country not in seen:
        fresh[r.country] = 2 * a
    s["common_countries"] = _top(fresh)
    s["recent"].append({"id": r.id, "ts_us": r.ts_us, "amount": r.amount, "channel": r.channel, "kind": r.kind,
                        "receiver": r.receiver, "country": r.country})
    del s["recent"][:-RECENT]


def _named(s: dict) -> dict:
    """What follows from the state as a whole."""
    countries = s["common_countries"]
    if countries:
        s["international_ratio"] = sum(c not in COUNTRY_LISTS["domestic"] for c in countries) / len(countries)
    s["preferred_channels"], s["preferred_types"] = _preferred(s["channel_distribution"]), _preferred(s["type_distribution"])
    return s


def fold_rows(state: dict, rows) -> dict:
    """The state after rows ``(id, ts_us, score, amount, channel, kind, receiver, country)`` in order."""
    s = {**state, "recent": list(state.get("recent") or [])}
    for r in rows:
        _step(s, r)
    return _named(s)


def profile_state(profiles: DataFrame) -> DataFrame:
    """Columns of a built profile the update works on. The newest transactions begin with the first update."""
    pairs = lambda c: F.map_from_entries(c)
    return profiles.select("account", "total_transactions", "avg_amount", "std_amount", "min_amount", "max_amount",
                           "channel_distribution", "type_distribution",
                           pairs("common_recipients").alias("common_recipients"),
                           pairs("common_countries").alias("common_countries"), "recipient_diversity",
                           "international_ratio")


def updates(tx: DataFrame) -> DataFrame:
    """Rows the update reads, keyed by the sender; ``tx`` may carry ``anomaly_score``."""
    score = F.col("anomaly_score") if "anomaly_score" in tx.columns else F.lit(0.0)
    return tx.select(F.col("sender_account").alias("account"), "id", "ts_us", F.col("amount").cast("double").alias(
        "amount"), F.coalesce("channel", F.lit("online")).alias("channel"),
        F.coalesce("transaction_type", F.lit("unknown")).alias("kind"),
        F.coalesce("receiver_account", F.lit("")).alias("receiver"),
        F.coalesce("destination_country", F.lit("ZW")).alias("country"), score.cast("double").alias("score"))


def fold_accounts(states: DataFrame, rows: DataFrame, new_accounts: bool = False) -> DataFrame:
    """Every account of ``states`` (``profile_state``, or what this returns) after its ``rows`` (``updates``) in time order.

    Rows of accounts without a state are left out, or with ``new_accounts`` begin one at their first amount. An account
    without rows keeps its state.
    """
    starts = states.select("account", F.to_json(F.struct(*states.columns)).alias("start"))
    both = starts.unionByName(rows, allowMissingColumns=True).repartition("account")
    both = both.sortWithinPartitions("account", F.col("start").isNull(), "ts_us", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, state, done = None, None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.account != account:
                    if state is not None:
                        done.append(_pack(_named(state)))
                    account, state = r.account, None
                    if len(done) >= WRITTEN:
                        yield pd.DataFrame(done, columns=_COLUMNS)
                        done = []
                if isinstance(r.start, str):
                    state = _unpack(json.loads(r.start))
                    continue
                if state is None and new_accounts:
                    state = _unpack({**_EMPTY, "account": account, "avg_amount": r.amount})
                if state is not None:
                    _step(state, r)
        if state is not None:
            done.append(_pack(_named(state)))
        yield pd.DataFrame(done, columns=_COLUMNS)

    # numbers that a starting row lacks would turn whole columns into doubles
    whole = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("id", "ts_us")})
    return whole.mapInPandas(fold, STATE_SCHEMA)


def update_profiles(profiles: DataFrame, tx: DataFrame) -> DataFrame:
    """State of every profile after all of its account's transactions, in time order."""
    return fold_accounts(profile_state(profiles), updates(tx))


_MAPS = ("channel_distribution", "type_distribution", "common_recipients", "common_countries")


_COLUMNS = ["account", "total_transactions", "avg_amount", "std_amount", "min_amount", "max_amount", *_MAPS,
            "recipient_diversity", "international_ratio", "preferred_channels", "preferred_types", "recent"]
_EMPTY = {"total_transactions": 0, "std_amount": 0.0, "min_amount": float("inf"), "max_amount": float("-inf"),
          "recipient_diversity": 0.0, "international_ratio": 0.0}


def _unpack(row: dict) -> dict:
    for m in _MAPS:
        row[m] = dict(row.get(m) or {})
    row["recent"] = [r if isinstance(r, dict) else r.asDict() for r in row.get("recent") or []]
    return row


def _pack(state: dict) -> dict:
    return {k: state.get(k) for k in _COLUMNS}
