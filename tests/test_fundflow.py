"""Fund flow on a small ledger with known answers."""

from utxolens.operators.fundflow import NO_LEGS, NO_MORE, UNSPENT, fund_flow

OUT = [(1, 0, "funding", 1_000_000), (2, 0, "pay", 600_000), (2, 1, "change", 399_000), (3, 0, "final", 590_000), (4, 0, None, 50), (4, 1, None, None), (5, 0, "final", 40), (1, 1, "other", 7)]
IN = [(2, 0, 1, 0), (3, 0, 2, 0), (5, 0, 4, 0), (6, 0, 99, 0), (6, 1, 1, 0)]


def flow(spark, *nodes, **more):
    outs = spark.createDataFrame([(*o, o[0] * 10) for o in OUT], "txid long, vout int, addr string, amount long, us long").selectExpr("*", "addr as address")
    ins = spark.createDataFrame(IN, "txid long, vin int, prev_txid long, prev_vout int")
    tx = spark.createDataFrame([(i, i, i * 10) for i in range(1, 7)], "txid long, seq long, us long")
    entries, totals = fund_flow(ins, outs, tx, spark.createDataFrame([(n,) for n in nodes], "node string"), **more)
    found = {}
    for r in entries.orderBy("asked", "side", "place").collect():
        found.setdefault((r.asked, r.side), []).append(r)
    return found, {r.asked: r for r in totals.collect()}


def test_flow_of_a_transaction(spark):
    found, totals = flow(spark, "tx:2")
    (source,) = found["tx:2", "in"]
    assert (source.id, source.amount, source.utxo_count, source.spent_count, source.via, source.selectable) == ("address:funding", 1_000_000, 1, 1, "tx:1", True)
    pay, change = found["tx:2", "out"]
    assert (pay.id, pay.amount, pay.spent_count, pay.via, pay.onward, pay.source_id, pay.reason) == ("address:pay", 600_000, 1, "tx:3", 1, "address:pay", None)
    assert (change.id, change.onward, change.selectable, change.reason, change.via) == ("address:change", 0, False, NO_MORE, "")
    t = totals["tx:2"]
    assert (t.input_count, t.output_count, t.input_sats, t.output_sats, t.dead_end_inputs, t.dead_end_outputs, t.transaction_count) == (1, 2, 1_000_000, 999_000, 0, 1, None)


def test_flow_of_addresses_and_outputs(spark):
    found, totals = flow(spark, "address:pay", "out:2:1", "address:funding", "address:final", "tx:77", "nothing")
    (paid,), (spent,) = found["address:pay", "in"], found["address:pay", "out"]
    assert (paid.id, paid.amount, paid.onward, paid.via, paid.us) == ("tx:2", 600_000, 2, "out:2:0", 20) and (spent.id, spent.onward, spent.spent_count) == ("tx:3", 1, 1)
    assert totals["address:pay"].transaction_count == 2
    assert totals["out:2:1"].centre == "address:change" and ("out:2:1", "out") not in found and totals["out:2:1"].output_count == 0
    (first,) = found["address:funding", "in"]
    assert (first.id, first.onward, first.selectable) == ("tx:1", 1, True)
    assert [(e.id, e.amount, e.onward, e.reason) for e in found["address:final", "in"]] == [("tx:3", 590_000, 1, None), ("tx:5", 40, 1, None)]
    assert "tx:77" not in totals and "nothing" not in totals


def test_bare_outputs_unknown_amounts_and_cuts(spark):
    found, totals = flow(spark, "tx:4", "out:4:0", "tx:5")
    spent, unspent = found["tx:4", "out"]
    assert (spent.id, spent.source_id, spent.onward) == ("out:4:0", "tx:5", 1) and (unspent.id, unspent.amount, unspent.source_id, unspent.reason) == ("out:4:1", None, None, UNSPENT)
    assert totals["tx:4"].output_sats is None and totals["tx:4"].input_sats == 0 and totals["out:4:0"].centre == "tx:4"
    (source,) = found["tx:5", "in"]
    assert (source.id, source.source_id, source.onward, source.via) == ("out:4:0", "tx:4", 1, "tx:4")
    found, totals = flow(spark, "tx:2", shown=1)
    assert [e.id for e in found["tx:2", "out"]] == ["address:pay"] and totals["tx:2"].truncated_outputs == 1 and totals["tx:2"].output_count == 2


def test_a_transaction_of_one_leg_is_a_dead_end(spark):
    found, _ = flow(spark, "address:other")
    (paid,) = found["address:other", "in"]
    assert (paid.onward, paid.reason) == (1, None)
    outs = spark.createDataFrame([(1, 0, "only", 5, 1, "only")], "txid long, vout int, addr string, amount long, us long, address string")
    ins = spark.createDataFrame([], "txid long, vin int, prev_txid long, prev_vout int")
    entries, _ = fund_flow(ins, outs, spark.createDataFrame([(1, 1, 1)], "txid long, seq long, us long"), spark.createDataFrame([("address:only",)], "node string"))
    assert [(r.id, r.selectable, r.reason) for r in entries.collect()] == [("tx:1", False, NO_LEGS)]
