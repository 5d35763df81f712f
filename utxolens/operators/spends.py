"""Resolving inputs to the outputs they spend, under each rule a consumer needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTPOINT = ["prev_txid", "prev_vout"]


def prevouts(tx_out: DataFrame) -> DataFrame:
    """Outputs under the names by which inputs claim them."""
    return tx_out.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), F.col("addr").alias("prev_addr"), F.col("address").alias("prev_address"), F.col("amount").alias("prev_amount"), F.col("us").alias("prev_us"))


def resolve_inputs(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Every input with the output it claims, whoever else claims it; unresolved ones keep nulls."""
    return tx_in.join(prevouts(tx_out), OUTPOINT, "left")


def matched_inputs(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    return tx_in.join(prevouts(tx_out), OUTPOINT, "left_semi")


def unresolved_inputs(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    return tx_in.join(prevouts(tx_out), OUTPOINT, "left_anti")


def spend_resolution(tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame) -> DataFrame:
    """First spender wins: of the transactions that claim an existing outpoint, the earliest in source order is resolved."""
    claims = matched_inputs(tx_in, tx_out).join(tx.select("txid", "seq"), "txid")
    first = F.min_by("txid", F.struct("seq", "vin")).over(Window.partitionBy(*OUTPOINT))
    return claims.select("txid", "vin", *OUTPOINT, F.when(F.col("txid") == first, "resolved").otherwise("double_spend_conflict").alias("status"))


def unique_spends(tx_in: DataFrame) -> DataFrame:
    """Conflicts drop out: outpoints that inputs of exactly one transaction claim, and that transaction."""
    return tx_in.groupBy(*OUTPOINT).agg(F.min("txid").alias("spend_txid"), F.max("txid").alias("other")).where("spend_txid = other").drop("other")


def input_stats(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Inputs and distinct input addresses of each transaction; an input's own address comes before its output's."""
    own = F.coalesce(F.expr("nullif(address, '')"), F.col("prev_addr"))
    return resolve_inputs(tx_in, tx_out).groupBy("txid").agg(F.count("*").alias("n_in"), F.count_distinct(own).alias("n_addr"))


def equal_outputs(tx_out: DataFrame) -> DataFrame:
    """The size of each transaction's largest group of equal output values."""
    return tx_out.groupBy("txid", F.coalesce("amount", F.lit(0)).alias("amount")).count().groupBy("txid").agg(F.max("count").alias("max_equal"))


def linking_transactions(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Transactions with two input addresses or more, marked where they look like mixing."""
    stats = input_stats(tx_in, tx_out).where("n_addr >= 2").join(equal_outputs(tx_out), "txid", "left")
    return stats.select("txid", "n_in", "n_addr", F.coalesce("max_equal", F.lit(0)).alias("max_equal"), (F.coalesce(F.col("n_in") >= 3, F.lit(False)) & F.coalesce(F.col("max_equal") >= 3, F.lit(False))).alias("mixing"))


def coverage(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of counters about what is known and how far spends resolve."""
    spends = spend_resolution(tx_in, tx_out, tx).agg(F.count_if(F.col("status") == "resolved").alias("resolved_spends"), F.count_if(F.col("status") != "resolved").alias("double_spend_conflicts"))
    parts = [tx.agg(F.count("*").alias("transactions")), tx_out.agg(F.count("*").alias("outputs"), F.count_distinct("addr").alias("addresses")), tx_in.agg(F.count("*").alias("inputs")), unresolved_inputs(tx_in, tx_out).agg(F.count("*").alias("missing_prevouts")), obs.agg(F.count("*").alias("observations")), spends]
    out = parts[0]
    for p in parts[1:]:  # one-row tables
        out = out.crossJoin(p)
    return out.withColumn("spend_lineage_complete", (F.col("missing_prevouts") == 0) & (F.col("double_spend_conflicts") == 0))


def value_conservation(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """For each spending transaction: whether all inputs resolve, and whether it then pays out more than it takes in."""
    ins = resolve_inputs(tx_in, tx_out).groupBy("txid").agg(F.bool_and(F.col("prev_amount").isNotNull()).alias("complete"), F.sum("prev_amount").alias("amount_in"))
    outs = tx_out.groupBy("txid").agg(F.sum("amount").alias("amount_out"))
    joined = ins.join(outs, "txid", "left")
    return joined.select("txid", "complete", "amount_in", "amount_out", F.coalesce(F.col("complete") & (F.col("amount_in") < F.col("amount_out")), F.lit(False)).alias("violation"))


def rapid_spends(tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame, seconds: int = 3600) -> DataFrame:
    """Receipts on an address spent again within `seconds`, both ends included; only plain addresses count."""
    outs = prevouts(tx_out).where("prev_address is not null").select(*OUTPOINT, F.col("prev_address").alias("address"), F.col("prev_us").alias("received_us"))
    spends = tx_in.select("txid", "vin", *OUTPOINT).join(outs, OUTPOINT).join(tx.select("txid", F.col("us").alias("spent_us")), "txid")
    delay = F.col("spent_us") - F.col("received_us")
    return spends.where(delay.between(0, seconds * 1_000_000)).select("address", *OUTPOINT, "txid", "vin", "received_us", "spent_us", delay.alias("delay_us"))


def window_start(us, seconds):
    """Start of the epoch-aligned, half-open window of a non-negative time."""
    return us - F.pmod(us, seconds.cast("long") * 1_000_000)
