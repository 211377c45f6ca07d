"""An account's transactions in both directions, balances, and reverse transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, prior


def account_ledger(df: DataFrame) -> DataFrame:
    """One row per (account, transaction); a transaction of an account with itself appears once.

    Columns ``account``, ``direction`` (out, in, self), ``counterparty`` and ``signed_cents`` are added.
    """
    s, r = F.col("sender_account"), F.col("receiver_account")
    same = s.eqNullSafe(r) | r.isNull()
    out_sign = F.when(F.col("transaction_type") == "deposit", F.col("cents")).otherwise(-F.col("cents"))
    own = F.struct(s.alias("account"), F.when(same, "self").otherwise("out").alias("direction"),
                   r.alias("counterparty"), F.when(same & (F.col("transaction_type") == "transfer"), F.lit(0))
                   .otherwise(out_sign).cast("long").alias("signed_cents"))
    other = F.struct(r.alias("account"), F.lit("in").alias("direction"), s.alias("counterparty"),
                     F.when(F.col("transaction_type") == "transfer", F.col("cents")).otherwise(F.lit(0))
                     .cast("long").alias("signed_cents"))
    sides = F.when(same, F.array(own)).otherwise(F.array(own, other))
    return df.withColumn("_side", F.explode(sides)).select("*", "_side.*").drop("_side")


def balances(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Opening balance plus the net of the account's ledger."""
    net = ledger.groupBy(F.col("account").alias("account_number")).agg(F.sum("signed_cents").alias("net_cents"))
    opening = F.round(F.col("balance") * 100).cast("long")
    return accounts.join(net, "account_number", "left").select(
        "account_number", opening.alias("opening_cents"), F.coalesce("net_cents", F.lit(0)).alias("net_cents"),
        (opening + F.coalesce("net_cents", F.lit(0))).alias("balance_cents"))


def fan_in_out(df: DataFrame) -> DataFrame:
    """Distinct partners of every account: recipients it sent to, senders it received from."""
    pairs = df.groupBy("sender_account", "receiver_account").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(F.col("sender_account").alias("account")).agg(F.count("receiver_account").alias("fan_out"))
    into = pairs.groupBy(F.col("receiver_account").alias("account")).agg(F.count("sender_account").alias("fan_in"))
    return out.join(into, "account", "full").select("account", F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
                                                    F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def reverse_transfers(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Add ``reverse_count`` and ``reverse_first_us`` over earlier transactions in the opposite direction.

    Both directions of a pair share one scan over the canonical pair; a self-transfer has no reverse.
    """
    s, r = F.col("sender_account"), F.col("receiver_account")
    forward = s < r
    rows = df.select("*", F.least(s, r).alias("_lo"), F.greatest(s, r).alias("_hi"), forward.alias("_fwd"))
    one = F.lit(1).cast("long")
    rows = prior(rows, ["_lo", "_hi"], [
        Measure("_nf", F.when(forward, one)), Measure("_nb", F.when(s > r, one)),
        Measure("_tf", F.when(forward, F.col("ts_us")), "min"),
        Measure("_tb", F.when(s > r, F.col("ts_us")), "min")], hot=hot)
    apart = s != r
    return rows.select(
        *df.columns,
        F.when(apart, F.when(F.col("_fwd"), F.col("_nb")).otherwise(F.col("_nf"))).otherwise(F.lit(0))
        .cast("long").alias("reverse_count"),
        F.when(apart, F.when(F.col("_fwd"), F.col("_tb")).otherwise(F.col("_tf"))).alias("reverse_first_us"))


def similar_reverse(df: DataFrame) -> DataFrame:
    """``id`` and ``round_trip`` for rows with an earlier opposite transfer of nearly the same amount.

    "Nearly" is ``|a - b| / max(a, 1) < 0.1``, in cents ``b`` in ``[a - k, a + k]``.  The amount axis is halved
    repeatedly; every row is known under one node per level with the earliest time seen there, and a band is the
    union of at most two nodes per level.  So the search is an equi-join of small aggregates, never a pairing of
    the rows of a pair of accounts.  Only pairs used in both directions take part.
    """
    s, r = F.col("sender_account"), F.col("receiver_account")
    apart = df.where(s != r).select("id", "ts_us", "cents", F.least(s, r).alias("lo"), F.greatest(s, r).alias("hi"),
                                    (s < r).alias("fwd"))
    both = (apart.groupBy("lo", "hi").agg(F.count_if("fwd").alias("f"), F.count_if(~F.col("fwd")).alias("b"))
            .where("f > 0 AND b > 0").select("lo", "hi"))
    rows = apart.join(both, ["lo", "hi"], "left_semi").where("cents >= 0")

    # a band around a is at most 2k + 1 wide, so larger nodes cannot fit into it; and a row of c cents can only lie
    # in bands of amounts up to c / 0.9, which are narrower than 0.3 c
    def levels(width: str):
        return F.explode(F.expr(f"sequence(0, cast(ceil(log2({width})) AS INT))")).alias("level")

    nodes = (rows.select("lo", "hi", "fwd", "ts_us", "cents", levels("greatest(cents, 100L) * 0.3D"))
             .groupBy("lo", "hi", "fwd", "level", F.expr("shiftright(cents, level)").alias("node"))
             .agg(F.min("ts_us").alias("seen_us")))

    # the tolerance: largest whole k with 10 * k < max(cents, 100)
    k = F.floor((F.greatest("cents", F.lit(100)) - 1) / 10).cast("long")
    band = rows.select("id", "lo", "hi", (~F.col("fwd")).alias("fwd"), "ts_us",
                       F.greatest(F.col("cents") - k, F.lit(0)).alias("a"), (F.col("cents") + k + 1).alias("z"))
    # [a, z): at each level the node at a if it is a right child, the node before z if z is one past a left child
    at = band.select("*", levels("z - a")).select(
        "id", "lo", "hi", "fwd", "ts_us", "level",
        F.expr("shiftright(a + shiftleft(1L, level) - 1, level)").alias("p"), F.expr("shiftright(z, level)").alias("q"))
    at = at.where("p < q")
    ends = F.array_compact(F.array(F.when(F.col("p") % 2 == 1, F.col("p")),
                                   F.when(F.col("q") % 2 == 1, F.col("q") - 1)))
    probes = at.select("id", "lo", "hi", "fwd", "ts_us", "level", F.explode(ends).alias("node"))
    hits = probes.join(nodes, ["lo", "hi", "fwd", "level", "node"]).where("seen_us < ts_us")
    return hits.groupBy("id").agg(F.lit(True).alias("round_trip"))


def transaction_pairs(df: DataFrame) -> DataFrame:
    """Edges of the account graph with first and last use."""
    return df.groupBy("sender_account", "receiver_account").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"))
