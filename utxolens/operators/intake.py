"""Raw records to facts: validation, quarantine, first-wins deduplication, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, parse_list_cell, parse_port, parse_sats, parse_timestamp

NETWORKS = ("mainnet", "testnet", "regtest", "unknown")


def normalize(raw: DataFrame) -> DataFrame:
    """Each record with its parsed fields and the first error in checking order, null where it is sound."""
    t, amounts, out_addr, in_addr = parse_timestamp(F.col("timestamp")), parse_list_cell(F.col("output_amounts")), parse_list_cell(F.col("output_addresses")), parse_list_cell(F.col("input_addresses"))
    parsed = F.transform(amounts, lambda a: parse_sats(a))
    df = raw.select("logical_record", F.lower(blank_to_null(F.col("txid"))).alias("txid"), F.coalesce(F.lower(blank_to_null(F.col("network"))), F.lit("unknown")).alias("network"), t.alias("t"), out_addr.alias("out_addr"), in_addr.alias("in_addr"), parsed.alias("sats"), blank_to_null(F.col("src_ip")).alias("src_ip"), parse_port(F.col("src_port")).alias("port"))
    error = F.coalesce(
        F.when(~F.coalesce(F.col("txid").rlike("^[0-9a-f]{64}$"), F.lit(False)), "txid is not 64 hex digits"), F.when(~F.col("network").isin(*NETWORKS), "unknown network"), F.col("t.error"),
        F.when(F.size("sats") == 0, "no outputs"), F.when(F.size("out_addr") != F.size("sats"), "array lengths differ"), F.get(F.filter("sats", lambda s: s.error.isNotNull()), 0)["error"], F.col("port.error"))
    return df.withColumn("error", error)


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("error is null")


def quarantined(normalized: DataFrame) -> DataFrame:
    return normalized.where("error is not null").select("logical_record", F.substring("error", 1, 1000).alias("reason"))


def output_facts(rows: DataFrame) -> DataFrame:
    z = rows.select("txid", F.posexplode(F.arrays_zip(F.col("out_addr").alias("a"), F.col("sats").alias("s"))).alias("vout", "z"))
    return z.select("txid", "vout", F.col("z.a").alias("address"), F.col("z.s.value").alias("amount_sats"))


def observation_facts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("src_ip").isNotNull() | F.col("port.value").isNotNull()).select(F.concat(F.lit("source:"), F.col("logical_record").cast("string")).alias("observation_id"), "txid", "src_ip", F.col("port.value").alias("src_port"))


def dedupe_txid(rows: DataFrame, digest) -> DataFrame:
    """First row of each txid wins; a later one is a duplicate if its content is the same, else a conflicting variant."""
    order = Window.partitionBy("txid").orderBy("logical_record")
    first = F.first("digest").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumn("digest", digest).withColumn("rn", F.row_number().over(order)).withColumn("first", first)
    return out.withColumn("verdict", F.when(F.col("rn") == 1, "accepted").when(F.col("digest") == F.col("first"), "duplicate").otherwise("conflicting variant")).drop("rn", "first")


def inspection(normalized: DataFrame) -> DataFrame:
    """Most frequent reasons, twenty at most."""
    return normalized.groupBy(F.coalesce("error", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)
