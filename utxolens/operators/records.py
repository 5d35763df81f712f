"""Structured source records to transaction, input, output and observation facts, with the first error of each row.

Amounts are decimal coins or whole satoshi, lists are real JSON arrays, bracketed literals or parted text; objects
in `inputs` and `outputs` win over parallel address and amount lists, and a plain list of strings there is a list of addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, list_cell, parse_port, parse_sats, parse_timestamp

#: Every canonical field; a source that lacks one has nulls there.
FIELDS = ("txid", "network", "timestamp", "observed_at", "block_hash", "block_height", "block_time", "fee", "fee_sats", "inputs", "outputs", "input_addresses", "input_amounts", "input_amounts_sats",
          "output_addresses", "output_amounts", "output_amounts_sats", "script_type", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "asn", "observer_id")
# Networks a record may name.
NETWORKS = ("bitcoin-mainnet", "bitcoin-testnet", "bitcoin-regtest", "unknown")
_IN = "array<struct<prev_txid string, prev_vout string, address string, amount string, amount_sats string, sequence string>>"
_OUT = "array<struct<amount string, value string, amount_sats string, script_id string, script_type string, address string>>"
_HEX = "^[0-9a-fA-F]{64}$"


def _objects(c: Column, schema: str) -> Column:
    """The objects of a JSON array of objects; null for any other cell."""
    return F.when(c.rlike(r"^\s*\[\s*\{"), F.from_json(c, schema))


def _either(sats: Column, coins: Column) -> Column:
    """An amount that is in satoshi if that cell is filled, else in coins."""
    return F.when(blank_to_null(sats).isNotNull(), parse_sats(sats, btc=False)).otherwise(parse_sats(coins))


def _first_error(items: Column, error) -> Column:
    return F.get(F.filter(F.transform(items, error), lambda e: e.isNotNull()), 0)


def normalize_records(raw: DataFrame) -> DataFrame:
    """Each record with parsed fields, `ins` and `outs` (arrays of structs) and its first error in checking order."""
    text = {f: (F.col(f).cast("string") if f in raw.columns else F.lit(None).cast("string")) for f in FIELDS}
    df = raw.select("logical_record", *[c.alias(f) for f, c in text.items()])
    c = {f: blank_to_null(F.col(f)) for f in FIELDS}
    seen, block = parse_timestamp(F.coalesce(c["timestamp"], c["observed_at"])), parse_timestamp(c["block_time"])
    fee = _either(c["fee_sats"], c["fee"])
    plain = lambda side: F.when(_objects(c[f"{side}s"], _IN if side == "input" else _OUT).isNull(), c[f"{side}s"])
    addresses = {side: list_cell(F.coalesce(c[f"{side}_addresses"], plain(side))) for side in ("input", "output")}
    in_sats = {side: c[f"{side}_amounts"].isNull() & c[f"{side}_amounts_sats"].isNotNull() for side in ("input", "output")}
    amounts = {side: list_cell(F.coalesce(c[f"{side}_amounts"], c[f"{side}_amounts_sats"])) for side in ("input", "output")}
    df = df.select(
        "*", seen.alias("_t"), block.alias("_b"), fee.alias("_fee"), _objects(c["inputs"], _IN).alias("_ins"), _objects(c["outputs"], _OUT).alias("_outs"),
        *[x for side in ("input", "output") for x in (addresses[side].alias(f"_{side}_a"), amounts[side].alias(f"_{side}_m"), in_sats[side].alias(f"_{side}_s"))], parse_port(c["src_port"]).alias("_sp"), parse_port(c["dst_port"]).alias("_dp"))
    amount = lambda side: F.transform(f"_{side}_m.items", lambda a: F.when(F.col(f"_{side}_s"), parse_sats(a, btc=False)).otherwise(parse_sats(a)))
    listed_in = F.transform(F.arrays_zip(F.col("_input_a.items").alias("a"), amount("input").alias("m")), lambda z: F.struct(F.lit(None).cast("string").alias("prev_txid"), F.lit(None).cast("int").alias("prev_vout"), blank_to_null(z.a).alias("address"), z.m.value.alias("amount_sats"), z.m.error.alias("error")))
    named_in = F.transform("_ins", lambda i: _input(i))
    listed_out = F.transform(F.arrays_zip(F.col("_output_a.items").alias("a"), amount("output").alias("m")), lambda z: F.struct(blank_to_null(z.a).alias("address"), z.m.value.alias("amount_sats"), F.lit(None).cast("string").alias("script_id"), blank_to_null(F.col("script_type")).alias("script_type"), z.m.error.alias("error")))
    named_out = F.transform("_outs", lambda o: _output(o))
    df = df.withColumn("ins", F.coalesce(named_in, listed_in)).withColumn("outs", F.coalesce(named_out, listed_out))
    size = lambda x: F.size(F.col(x))
    error = F.coalesce(
        F.when(~F.coalesce(c["txid"].rlike(_HEX), F.lit(False)), "txid is not 64 hex digits"), F.when(~F.coalesce(c["network"], F.lit("unknown")).isin(*NETWORKS), "unknown network"), F.col("_t.error"), F.col("_fee.error"),
        F.when(c["block_height"].isNotNull() & c["block_height"].try_cast("long").isNull(), "block height is no integer"), F.col("_b.error"), F.col("_input_a.error"), F.col("_input_m.error"),
        F.when((size("_input_m.items") > 0) & (size("_input_a.items") != size("_input_m.items")), "input lists differ in length"), F.col("_output_a.error"), F.col("_output_m.error"),
        F.when(F.col("_outs").isNull() & ((size("_output_a.items") != size("_output_m.items")) | (size("_output_m.items") == 0)), "outputs must be lists of equal length"),
        _first_error(F.col("ins"), lambda i: i.error), _first_error(F.col("outs"), lambda o: o.error), F.col("_sp.error"), F.col("_dp.error"))
    return df.select("logical_record", F.lower(c["txid"]).alias("txid"), F.coalesce(c["network"], F.lit("unknown")).alias("network"), F.col("_t.us").alias("us"), F.col("_b.us").alias("block_us"), F.col("_fee.value").alias("fee_sats"), c["block_height"].try_cast("long").alias("block_height"), c["block_hash"].alias("block_hash"),
                     "ins", "outs", *[c[f].alias(f) for f in ("src_ip", "dst_ip", "geo_country", "asn")], F.coalesce(c["observer_id"], F.lit("source-unspecified")).alias("observer_id"), F.col("_sp.value").alias("src_port"), F.col("_dp.value").alias("dst_port"), error.alias("error"))


def _input(i: Column) -> Column:
    amount, prev, vout = _either(i.amount_sats, i.amount), blank_to_null(i.prev_txid), blank_to_null(i.prev_vout)
    error = F.coalesce(F.when(prev.isNotNull() & ~prev.rlike(_HEX), "previous txid is not 64 hex digits"), F.when(vout.isNotNull() & vout.try_cast("int").isNull(), "previous vout is no integer"), F.when(vout.try_cast("int") < 0, "previous vout is negative"), amount.error)
    return F.struct(F.lower(prev).alias("prev_txid"), vout.try_cast("int").alias("prev_vout"), blank_to_null(i.address).alias("address"), amount.value.alias("amount_sats"), error.alias("error"))


def _output(o: Column) -> Column:
    amount = _either(o.amount_sats, F.coalesce(blank_to_null(o.amount), o.value))
    error = F.coalesce(amount.error, F.when(amount.value.isNull(), "an output needs an amount"))
    return F.struct(blank_to_null(o.address).alias("address"), amount.value.alias("amount_sats"), blank_to_null(o.script_id).alias("script_id"), F.coalesce(blank_to_null(o.script_type), blank_to_null(F.col("script_type"))).alias("script_type"), error.alias("error"))


def transaction_facts(rows: DataFrame) -> DataFrame:
    """Accepted records' transactions; the time is that of the block where one is given."""
    return rows.where("error is null").select("logical_record", "txid", "network", F.coalesce("block_us", "us").alias("us"), "block_height", "block_hash", "fee_sats", F.when(F.col("block_us").isNotNull(), "block_time").otherwise("unknown").alias("time_meaning"))


def input_facts(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").select("logical_record", "txid", F.posexplode("ins").alias("vin", "i")).select("logical_record", "txid", "vin", "i.prev_txid", "i.prev_vout", "i.address", "i.amount_sats")


def output_facts(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").select("logical_record", "txid", F.posexplode("outs").alias("vout", "o")).select("logical_record", "txid", "vout", "o.amount_sats", "o.script_id", "o.script_type", "o.address")


def observation_facts(rows: DataFrame, source: str) -> DataFrame:
    """One observation for each accepted record with any network field."""
    some = F.coalesce("src_ip", "dst_ip", F.col("src_port").cast("string"), F.col("dst_port").cast("string"), "geo_country", "asn").isNotNull()
    return rows.where("error is null").where(some).select(F.concat_ws(":", F.lit(source), F.col("logical_record").cast("string")).alias("observation_id"), "txid", "observer_id", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "asn", "us")
