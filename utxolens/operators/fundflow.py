"""Fund flow: the direct counterparties of transactions, addresses and outputs, with amounts and what lies beyond each.

Centres are taken many at a time. A transaction's counterparties are the addresses whose outputs it spent and those it paid (an
output without an address stands for itself); an address's are the transactions that paid it and those that spent from it. An output is one
coin: its flow is its address's, without one that of its transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spends import spend_resolution

#: Ways that an entry lists, and entries that a side shows.
VIA, SHOWN = 5, 40
# Why a counterparty leads nowhere.
UNSPENT, NO_MORE, NO_LEGS = "unspent", "no other transaction", "no other inputs or outputs"


def coins(tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame) -> DataFrame:
    """Every output with its address's node and its resolved spender's, null where there is none."""
    spent = spend_resolution(tx_in, tx_out, tx).where("status = 'resolved'").groupBy(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")).agg(F.min("txid").alias("s"))
    node = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    out = tx_out.select("txid", "vout", "addr", "amount").join(spent, ["txid", "vout"], "left")
    return out.select(node("out", "txid", "vout").alias("coin"), node("tx", "txid").alias("made"), F.when(F.col("addr").isNotNull(), node("address", "addr")).alias("lock"), "amount", F.when(F.col("s").isNotNull(), node("tx", "s")).alias("spender"))


def resolved_centres(centres: DataFrame, coins: DataFrame) -> DataFrame:
    """(asked, centre) for nodes that are there: an output gives its address, without one its transaction."""
    asked = centres.select(F.col("node").alias("asked")).distinct()
    out = asked.where("asked like 'out:%'").join(coins, F.col("asked") == F.col("coin")).select("asked", F.coalesce("lock", "made").alias("centre"))
    own = [asked.where(f"asked like '{k}:%'").join(coins.select(F.col(c).alias("asked")).where("asked is not null").distinct(), "asked", "left_semi").select("asked", F.col("asked").alias("centre")) for k, c in (("tx", "made"), ("address", "lock"))]
    return out.unionByName(own[0]).unionByName(own[1])


def _entries(rows: DataFrame, side: str) -> DataFrame:
    """One entry for each (centre, id) from rows (centre, id, coin, amount, spent, way): unknown amounts leave a sum unknown."""
    ways = F.slice(F.array_sort(F.collect_list(F.when(F.col("way").isNotNull(), F.struct("coin", "way")))), 1, VIA)
    amount = F.when(F.count_if(F.col("amount").isNull()) == 0, F.sum("amount"))
    out = rows.groupBy("centre", "id").agg(amount.alias("amount"), F.count("*").alias("utxo_count"), F.count_if("spent").alias("spent_count"), ways.alias("w"), F.min("next").alias("next"))
    return out.select("centre", F.lit(side).alias("side"), "id", "amount", "utxo_count", "spent_count", F.array_join("w.way", ",").alias("via"), "next")


def fund_flow(tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame, centres: DataFrame, shown: int = SHOWN) -> tuple[DataFrame, DataFrame]:
    """(entries, totals) of the centres (`node`): the `shown` largest counterparties a side, and one row a centre of counts and sums.

    An entry has `onward`, how much goes on beyond the centre (of an address its other transactions, of a transaction its inputs and outputs
    not of the centre's address, of a bare output its other end), and is selectable if that is more than none.
    """
    c = coins(tx_in, tx_out, tx)
    # The tables are as small as what the centres touch.
    asked = resolved_centres(centres, c)
    nodes = asked.select("centre").distinct()
    true, key = F.lit(True), F.coalesce("lock", "coin").alias("id")
    bare = F.col("lock").isNull()
    t_in = c.join(nodes, F.col("spender") == F.col("centre")).select("centre", key, "coin", "amount", true.alias("spent"), F.col("made").alias("way"), F.when(bare, F.col("made")).alias("next"))
    t_out = c.join(nodes, F.col("made") == F.col("centre")).select("centre", key, "coin", "amount", F.col("spender").isNotNull().alias("spent"), F.col("spender").alias("way"), F.when(bare, F.coalesce("spender", F.lit(""))).alias("next"))
    mine = c.join(nodes, F.col("lock") == F.col("centre"))
    none = F.lit(None).cast("string").alias("next")
    a_in = mine.select("centre", F.col("made").alias("id"), "coin", "amount", F.col("spender").isNotNull().alias("spent"), F.col("coin").alias("way"), none)
    a_out = mine.where("spender is not null").select("centre", F.col("spender").alias("id"), "coin", "amount", true.alias("spent"), F.col("coin").alias("way"), none)
    every = _entries(t_in.unionByName(a_in), "in").unionByName(_entries(t_out.unionByName(a_out), "out"))
    place = F.row_number().over(Window.partitionBy("centre", "side").orderBy(F.col("amount").isNull(), F.desc("amount"), "id"))
    top = every.withColumn("place", place).where(F.col("place") <= shown)
    # Beyond the centre: transactions of an address, legs of a transaction.
    pairs = top.select("centre", "id").distinct()
    held = pairs.where("id like 'address:%'").join(c, F.col("id") == F.col("lock"))
    touched = held.select("centre", "id", F.col("made").alias("t")).union(held.where("spender is not null").select("centre", "id", F.col("spender").alias("t"))).distinct()
    beyond = touched.groupBy("centre", "id").agg(F.count_if(F.col("t") != F.col("centre")).alias("onward"))
    legs = c.select(F.col("made").alias("id"), "lock").unionByName(c.where("spender is not null").select(F.col("spender").alias("id"), "lock"))
    foreign = pairs.where("id like 'tx:%'").join(legs, "id").groupBy("centre", "id").agg(F.count_if(~F.col("lock").eqNullSafe(F.col("centre"))).alias("onward"))
    top = top.join(beyond.unionByName(foreign), ["centre", "id"], "left")
    bare = F.col("id").startswith("out:")
    onward = F.when(bare, (F.col("next") != "").cast("long")).otherwise(F.coalesce("onward", F.lit(0)))
    source = F.when(bare, F.nullif("next", F.lit(""))).otherwise(F.col("id"))
    reason = F.when(onward > 0, F.lit(None)).when(bare, UNSPENT).when(F.col("id").startswith("tx:"), NO_LEGS).otherwise(NO_MORE)
    times = tx.select(F.concat(F.lit("tx:"), F.col("txid").cast("string")).alias("id"), "us")
    entries = top.withColumns({"onward": onward, "source_id": source, "selectable": onward > 0, "reason": reason}).join(times, "id", "left")
    entries = asked.join(entries, "centre").select("asked", "centre", "side", "place", "id", "amount", "utxo_count", "spent_count", "via", "source_id", "onward", "selectable", "reason", "us")
    side = lambda what, s: F.count_if(F.col("side") == s).alias(what)
    known = lambda what, s: F.when(F.count_if((F.col("side") == s) & F.col("amount").isNull()) == 0, F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0))).alias(what)
    counts = every.groupBy("centre").agg(side("input_count", "in"), side("output_count", "out"), known("input_sats", "in"), known("output_sats", "out"), F.count_distinct("id").alias("_ids"))
    dead = entries.select("centre", "side", "id", "selectable").distinct().groupBy("centre").agg(F.count_if((F.col("side") == "in") & ~F.col("selectable")).alias("dead_end_inputs"), F.count_if((F.col("side") == "out") & ~F.col("selectable")).alias("dead_end_outputs"))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("input_count", "output_count")]
    cut = [F.greatest(F.coalesce(f"{s}put_count", F.lit(0)) - shown, F.lit(0)).alias(f"truncated_{s}puts") for s in ("in", "out")]
    rows = asked.join(counts, "centre", "left").join(dead, "centre", "left")
    sums = [F.when(F.col("_ids").isNull(), 0).otherwise(F.col(n)).alias(n) for n in ("input_sats", "output_sats")]
    deads = [F.coalesce(n, F.lit(0)).alias(n) for n in ("dead_end_inputs", "dead_end_outputs")]
    return entries, rows.select("asked", "centre", *zero, *sums, *deads, *cut, F.when(F.col("centre").startswith("address:"), F.coalesce("_ids", F.lit(0))).alias("transaction_count"))
