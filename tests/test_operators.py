"""Operators on small hand-made facts with known answers."""

import pytest
from pyspark.sql import functions as F
from utxolens.functions import scalars
from utxolens.operators import graph, groups, intake, network, spends, stats, windows
from utxolens.sources import files
from utxolens.streaming import events

OUT = "txid long, vout int, part long, address string, script_id string, addr string, script_type string, amount long, us long"
IN = "txid long, vin int, prev_txid long, prev_vout int, address string"
MINUTE = 60_000_000


def facts(spark, outs, ins):
    """outs: (txid, vout, addr, amount, us); ins: (txid, vin, prev_txid, prev_vout)."""
    o = spark.createDataFrame([(t, v, 0, a, None, a, "p", m, us) for t, v, a, m, us in outs], OUT)
    times = {t: us for t, _, _, _, us in outs}
    tx = spark.createDataFrame([(t, t, us, 0) for t, us in times.items()], "seq long, txid long, us long, fee long")
    return tx, spark.createDataFrame([(*i, None) for i in ins], IN), o


@pytest.fixture(scope="module")
def chain(spark):
    """One coin passed on four times, a little less each time."""
    return facts(spark, [(1, 0, "seed", 100000, 0), (2, 0, "hop1", 90000, MINUTE), (2, 1, "p1", 9000, MINUTE), (3, 0, "hop2", 80000, 2 * MINUTE), (4, 0, "hop3", 70000, 3 * MINUTE)], [(2, 0, 1, 0), (3, 0, 2, 0), (4, 0, 3, 0)])


def test_peeling_chain(spark, chain):
    tx, tx_in, tx_out = chain
    walks = graph.peeling_walks(graph.peeling_hops(tx_in, tx_out)).collect()
    assert [(w.hops, w.path) for w in walks] == [(3, "2,3,4")]
    assert graph.peeling_walks(graph.peeling_hops(tx_in, tx_out), shortest=4).count() == 0
    assert graph.peeling_walks(graph.peeling_hops(tx_in.where("txid < 4"), tx_out)).count() == 0


def test_seed_proximity_and_risk(spark, chain):
    tx, tx_in, tx_out = chain
    seeds = spark.createDataFrame([("seed", 1.0)], "addr string, weight double")
    got = {r.addr: r.score for r in graph.seed_proximity(tx_in, tx_out, seeds, 2, 0.5).collect()}
    assert got["seed"] == 1.0 and got["hop1"] == 0.5 and got["hop2"] == 0.25 and "hop3" not in got
    risk = {r.addr: r.risk for r in graph.risk_downstream(tx_in, tx_out, seeds).collect()}
    assert risk["seed"] == 1.0 and risk["hop1"] == pytest.approx(0.85) and risk["hop2"] == pytest.approx(0.85**2)


def test_equal_outputs_and_clusters(spark):
    tx, tx_in, tx_out = facts(spark, [(1, i, f"a{i}", 60000, 0) for i in range(3)] + [(2, i, f"m{i}", 50000, MINUTE) for i in range(3)] + [(2, 3, "c", 29000, MINUTE), (3, 0, "z", 90000, MINUTE)], [(2, 0, 1, 0), (2, 1, 1, 1), (2, 2, 1, 2), (3, 0, 2, 0), (3, 1, 2, 3)])
    (g,) = graph.coinjoin_like(tx_in, tx_out).collect()
    assert (g.txid, g.equal_outputs, g.equal_value) == (2, 3, 50000)
    clusters = graph.common_input_clusters(tx_in, tx_out).collect()
    assert {c.addr for c in clusters} == {"m0", "c"}, "the mixing-like transaction links nothing"


def test_addresses_of_one_transaction_take_no_part_in_rounds(spark, monkeypatch):
    tx, tx_in, tx_out = facts(spark, [(1, i, f"a{i}", 10 + i, 0) for i in range(60)], [(2 + i // 20, i % 20, 1, i) for i in range(60)] + [(3, 20, 1, 0)])
    linked, found = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: linked.append(sorted(map(tuple, edges.collect()))) or found(edges))
    got = {r.addr: r.entity_id for r in graph.common_input_clusters(tx_in, tx_out).collect()}
    assert linked == [[(2, 3)]], "a0 alone is in two transactions"
    import hashlib

    name = lambda a: "E-" + hashlib.md5(a.encode()).hexdigest()[:12]
    assert got == {f"a{i}": name("a0" if i < 40 else "a40") for i in range(60)}


def test_claims_are_made_in_two_shuffles(spark, chain):
    from utxolens.plans.domain import _spends

    assert _spends(chain[2])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_rows_of_a_frequent_value_are_not_one_task(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 10 > 0, 0.0d, id * 1.0d) AS v", "id % 2 = 0 AS is_ref")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = stats.reference_rank(rows, "v")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000, sizes
        ref = sorted(0.0 if i % 10 else float(i) for i in range(0, 4000, 2))
        assert all(r.rank == sum(x <= r.v for x in ref) / 2000 for r in got.where("id % 97 < 11").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_recipient_history_over_ranges(spark):
    import random

    r = random.Random(3)
    pays = sorted({(t, r.choice(("busy", "busy", "b", f"x{r.randrange(40)}"))) for t in range(400) for _ in range(2)})
    us = {t: 1_000_000 * r.randrange(90) for t in range(400)}
    out = spark.createDataFrame([(t, a, us[t]) for t, a in pays], "txid long, addr string, us long")
    got = {x.txid: x for x in windows.recipient_history(out).collect()}
    for t in us:
        before = [[us[o] for o, b in pays if b == a and us[o] < us[t]] for s, a in pays if s == t]
        n = [len(x) for x in before]
        want = (len(n), sum(x > 0 for x in n) / len(n), sum(n) / len(n), max([(max(x) - min(x)) / 1e6 for x in before if x], default=0.0))
        assert tuple(got[t])[1:] == pytest.approx(want), t


def test_an_address_without_an_entity_is_its_own_wallet(spark):
    from utxolens.operators import readside

    tx, tx_in, tx_out = facts(spark, [(1, 0, "a", 5, 0), (1, 1, "b", 7, 0), (2, 0, "c", 9, 1)], [(2, 0, 1, 0), (2, 1, 1, 1), (2, 2, 8, 8), (3, 0, 2, 0)])
    entities = spark.createDataFrame([("a", "E"), ("b", "E")], "addr string, wallet string")
    got = {(r.txid, r.wallet, r.amount, r.side) for r in graph.value_flows(tx_in, tx_out, entities).collect()}
    assert got == {(1, "E", 12, "out"), (2, "c", 9, "out"), (2, "E", 12, "in"), (3, "c", 9, "in")}
    obs = spark.createDataFrame([(2, "r"), (2, "r"), (3, "s"), (7, "s")], "txid long, src_ip string")
    assert {tuple(r) for r in readside.wallet_endpoints(tx_in, tx_out, obs, entities).collect()} == {("E", "r", 1), ("c", "s", 1)}
    pairs = network.wallet_observations(tx_in, tx_out, obs, "src_ip", entities)
    assert {tuple(r) for r in pairs.select("wallet", "key", "txid").collect()} == {("E", "r", 2), ("c", "s", 3)}


def test_two_spend_rules(spark):
    tx, tx_in, tx_out = facts(spark, [(1, 0, "a", 10, 0), (1, 1, "b", 10, 0), (2, 0, "c", 5, 1), (3, 0, "d", 5, 2)], [(2, 0, 1, 0), (3, 0, 1, 0), (3, 1, 1, 1), (3, 2, 9, 9)])
    status = {(r.txid, r.vin): r.status for r in spends.spend_resolution(tx_in, tx_out, tx).collect()}
    assert status == {(2, 0): "resolved", (3, 0): "double_spend_conflict", (3, 1): "resolved"}
    assert {(r.prev_txid, r.prev_vout) for r in spends.unique_spends(tx_in).collect()} == {(1, 1), (9, 9)}
    assert spends.unresolved_inputs(tx_in, tx_out).count() == 1


def test_history_sees_only_earlier_windows(spark):
    hour = 3600 * 1_000_000
    rows = [("a", 3600, 0, 1, 1000), ("a", 3600, hour, 2, 10000), ("a", 3600, 2 * hour, 1, 500), ("b", 3600, 0, 1, 5000)]
    f = spark.createDataFrame(rows, "addr string, seconds int, start_us long, transactions long, total_value long")
    got = {(r.addr, r.start_us // hour): r for r in windows.address_history(f).collect()}
    assert got["a", 0].baseline_count is None and got["b", 0].surge_value is None
    assert (got["a", 1].gap_seconds, got["a", 1].baseline_count, got["a", 1].surge_count, got["a", 1].baseline_value, got["a", 1].surge_value) == (3600, 1, 2, 1000, 10)
    assert got["a", 2].baseline_count == 1.5 and got["a", 2].surge_count == pytest.approx(1 / 1.5)


def test_equal_times_never_see_each_other(spark):
    tx, _, tx_out = facts(spark, [(1, 0, "x", 1, 0), (2, 0, "x", 1, MINUTE), (3, 0, "x", 1, MINUTE), (4, 0, "x", 1, 2 * MINUTE)], [])
    got = {r.txid: r.mean_prior_count for r in windows.recipient_history(tx_out).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 3}


def test_shapes(spark):
    tx, tx_in, tx_out = facts(spark, [(0, i, f"a{i}", 1000, 0) for i in range(3)] + [(1, i, f"b{i}", v, 100 * 10**6) for i, v in enumerate((500, 500, 500, 490))] + [(2, 0, "c", 900, 200 * 10**6), (2, 1, "d", 90, 200 * 10**6)], [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 0, 2), (2, 0, 1, 0)])
    got = {r.txid: r for r in stats.shape_features(tx_in, tx_out, tx).collect()}
    assert (got[1].equal_tol_0, got[1].equal_tol_10, got[1].n_inputs) == (3, 4, 3) and got[2].one_big_one_small == 1 and got[1].one_big_one_small == 0
    assert {r.txid for r in stats.motif_flags(stats.shape_features(tx_in, tx_out, tx)).where("mixing_like").collect()} == {1}


def test_survival_and_precision(spark):
    km = lambda e: stats.kaplan_meier(spark.createDataFrame([("s", d, ev) for d, ev in zip((1, 2, 3, 4), e)], "stratum string, duration long, event boolean")).orderBy(F.desc("duration")).first().survival
    assert km([True] * 4) == 0 < km([True, False, False, False])
    ap = [stats.average_precision(spark.createDataFrame([(0.5, x) for x in o], "score double, label boolean")).first().average_precision for o in ([True, False, False], [False, False, True])]
    assert ap[0] == ap[1] == pytest.approx(1 / 3)


def test_reference_set_takes_the_earliest(spark):
    tx = spark.createDataFrame([(i, (i // 4) * 1_000_000) for i in range(11)], "txid long, us long")
    assert {r.txid for r in stats.reference_set(tx).where("is_ref").collect()} == set(range(7))


def test_scalars(spark):
    cells = ['["a","b"]', "['a', 'b']", "a;b", "a|b", "a, b", "a b", " ", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(scalars.parse_list_cell(F.col("c"))).collect()]
    assert got == [["a", "b"]] * 6 + [[], []]
    times = ["1767225600", "1767225600000", "2026-01-01 00:00:00 UTC", "2026-01-01T00:00:00Z", "2026-01-01T00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in times], "c string").select(scalars.parse_timestamp(F.col("c"))).collect()]
    assert [g.us for g in got] == [1767225600000000] * 4 + [None] and got[4].error == "no time zone"
    got = [r[0] for r in spark.createDataFrame([(c,) for c in ("0.1", "0.000000001", "-1", "x", "30000000")], "c string").select(scalars.parse_sats(F.col("c"))).collect()]
    assert got[0].value == 10_000_000 and [g.error for g in got[1:]] == ["fraction of a satoshi", "negative amount", "not a number", "more than can exist"]
    scopes = ["", "x", "203.0.113.9", "0.0.0.0", "127.0.0.1", "169.254.1.1", "224.0.0.1", "10.1.1.1", "250.0.0.1", "8.8.8.8"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in scopes], "c string").select(scalars.ip_scope(F.col("c"))).collect()]
    assert got == ["missing", "invalid", "documentation", "unspecified", "loopback", "link_local", "multicast", "private", "reserved", "public"]


def test_header_names():
    got = files.describe(["Timestamp", "Source IP", "Destination Port", "TxID", "From Addresses", "Output Values", "Country", "AS Number", "extra"])
    assert got["renames"] == {"Timestamp": "timestamp", "Source IP": "src_ip", "Destination Port": "dst_port", "TxID": "txid", "From Addresses": "input_addresses", "Output Values": "output_amounts", "Country": "geo_country", "AS Number": "asn"}
    assert got["unmapped"] == ["extra"] and got["missing"] == ["dst_ip", "src_port", "output_addresses[]", "input_amounts[]", "fee", "script_type"]


def test_intake(spark):
    ok = ("2026-01-01T00:00:00Z", "a" * 64, "mainnet", "", "x;y", "0.1;0.2", None, None)
    rows = [(1, *ok), (2, *ok[:1], "b" * 64, *ok[2:4], "x", *ok[5:]), (3, *ok), (4, ok[0], "c" * 64, "moon", *ok[3:])]
    raw = spark.createDataFrame(rows, "logical_record long, timestamp string, txid string, network string, input_addresses string, output_addresses string, output_amounts string, src_ip string, src_port string")
    n = intake.normalize(raw)
    assert {r.logical_record: r.reason for r in intake.quarantined(n).collect()} == {2: "array lengths differ", 4: "unknown network"}
    verdicts = intake.dedupe_txid(intake.accepted(n), F.md5(F.to_json("sats").cast("binary"))).collect()
    assert {r.logical_record: r.verdict for r in verdicts} == {1: "accepted", 3: "duplicate"}


def test_binomial_tail(spark):
    rows = [(0, 5, 0.3), (3, 3, 0.5), (1, 4, 0.0), (2, 4, 1.0), (2, 3, 0.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "k long, n long, p double").select(network.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got == pytest.approx([1, 0.125, 0, 1, 0.5])


def test_review_groups(spark):
    day = 86_400_000_000
    rows = [(1, 0, ["x"], "peel"), (2, 5, ["x", "y"], "peel"), (3, 6, ["y"], "peel"), (4, day, ["x"], "peel"), (5, 7, ["x"], "fan")]
    found = spark.createDataFrame([(i, s, s + 9, r, str(i), a) for i, s, a, r in rows], "id long, start_us long, end_us long, rule string, entity_ref string, anchors array<string>")
    got = {r.id: (r.rule, r.day, r.leader) for r in groups.review_groups(found).collect()}
    assert got[1] == got[2] and got[3] != got[1], "anchors are the representative's"
    assert len({got[1], got[4], got[5]}) == 3


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 5} 00:{i % 60:02d}:00", i % 3, "click", float(i), "{}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    batch = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {tuple(r) for r in events.drain(events.tumbling(events.read_events(spark, str(tmp_path / "in")), late="0 seconds"), str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in events.tumbling(batch).collect()}
    assert got <= want and len(got) >= len(want) - 3, "only the last day's windows are still open"
    assert events.drain(events.first_wins(events.read_events(spark, str(tmp_path / "in")), "user_id"), str(tmp_path / "first")).count() == 3


def test_results_do_not_depend_on_partitions(spark, chain):
    tx, tx_in, tx_out = chain
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, graph.graph_edges(tx, tx_in, tx_out, spark.createDataFrame([], "obs_id long, txid long, src_ip string, dst_ip string")).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) == 13


def test_neighbourhood_pages_name_only_the_edges_they_hold(spark, monkeypatch):
    kept, wide = graph.keep, []
    monkeypatch.setattr(graph, "keep", lambda df, tag: wide.append(df.columns) or kept(df, tag))
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("b", "c", "x"), ("c", "d", "x"), ("c", "a", "y"), ("d", "e", "x"), ("y", "z", "x")], "from_node string, to_node string, edge_type string")
    reached = graph.neighbourhood(edges, "a", 2)
    assert sorted(tuple(r) for r in reached.collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    nodes, page, totals = graph.neighbourhood_page(edges, reached, 2)
    assert [r.node for r in nodes.collect()] == ["a", "b", "c", "d"]
    import hashlib

    want = sorted(hashlib.sha256("|".join(e).encode()).hexdigest() for e in {("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("c", "a", "y")})
    assert [r.edge_id for r in page.collect()] == want
    assert tuple(totals.first()) == (4, 4, 0, 0)
    assert not any("edge_id" in columns for columns in wide)
