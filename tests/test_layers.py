"""Layers that SQL does not express, against plain Python, and ranks by ranges."""

import random
from math import exp, lgamma, log
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F
from utxolens.operators import anomaly, graph, groups, layers, ordered, peeling, readside, risk, stats


def test_stouffer_is_the_weighted_sum_of_normal_quantiles(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(20) / 7, r.random(), r.random() < 0.7) for i in range(200)]
    got = {x.txid: x.fused for x in layers.stouffer(spark.createDataFrame(rows, "txid long, a double, b double, is_ref boolean"), ["a", "b"], [1.0, 0.5]).collect()}
    ref = [x for x in rows if x[3]]
    for t, a, b, _ in rows:
        z = 0.0
        for weight, at, v in ((1.0, 1, a), (0.5, 2, b)):
            p = (sum(x[at] >= v for x in ref) + 1) / (len(ref) + 1)
            z += weight * NormalDist().inv_cdf(1 - min(1 - 1e-9, max(1e-9, p)))
        assert got[t] == pytest.approx(z / (1 + 0.25) ** 0.5)


def plain_groups(rows, most):
    """{frozenset of ids} by one pass over all findings."""
    day, made = 86_400_000_000, []
    for i, s, e, rule, entity, a in sorted(rows, key=lambda x: (x[1], x[2], x[3], x[4], x[0])):
        free = bool(a) and s <= e <= (s // day + 1) * day
        fit = next((g for g in made if g["free"] and free and g["rule"] == rule and g["day"] == s // day and (rule == "peel" or g["focal"] == entity) and g["anchors"] & set(a) and len(g["ids"]) < most), None)
        if fit is None:
            made.append(fit := {"free": free, "rule": rule, "day": s // day, "focal": entity, "anchors": set(a), "ids": []})
        fit["ids"].append(i)
    return made


def test_review_groups_agree_with_one_pass_over_all_findings(spark):
    r = random.Random(2)
    day = 86_400_000_000
    rows = [(i, s := r.randrange(3 * day), s + r.choice([9, -1, day // 3]), ["peel", "fan"][i % 2], f"e{r.randrange(4)}", [str(x) for x in r.sample(range(30), r.randrange(4))]) for i in range(400)]
    found = spark.createDataFrame(rows, "id long, start_us long, end_us long, rule string, entity_ref string, anchors array<string>")
    got = {}
    for x in groups.review_groups(found, most=5).collect():
        got.setdefault(x.leader, []).append((x.ordinal, x.id, x.singleton))
    assert {tuple(i for _, i, _ in sorted(g)) for g in got.values()} == {tuple(g["ids"]) for g in plain_groups(rows, 5)}
    assert all(leader == sorted(g)[0][1] for leader, g in got.items()) and {s for g in got.values() for *_, s in g} == {None, "no anchor", "the window leaves its day"}


def test_anchors_are_spends_of_walks_and_exact_sources_of_others(spark):
    found = spark.createDataFrame([(1, "peeling", "address:a"), (2, "peeling", "tx:7"), (3, "fan_out", "address:h"), (4, "fan_out", "address:h"), (5, "fan_out", "tx:9"), (6, "peeling", "address:z")], "id long, rule string, entity_ref string")
    spends = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 1, 2)], "id long, prev_txid long, txid long")
    refs = spark.createDataFrame([(3, "e", "/0", "s"), (4, "e", "/0", "s"), (4, "e", None, "s"), (5, "e", "/2", "s"), (6, "e", "/0", "s")], "id long, evidence_id string, locator string, sha256 string")
    rows = groups.finding_anchors(found, spends, refs)
    got = {x.id: x for x in rows.collect()}
    assert len(set(got[1].anchors) & set(got[2].anchors)) == 1 and got[3].anchors == got[4].anchors != got[5].anchors and got[6].anchors == []
    assert got[1].txs == ["tx:10", "tx:11"] and sorted(got[2].txs) == ["tx:11", "tx:12", "tx:7"] and got[3].txs == [] and got[5].txs == ["tx:9"] and got[5].entities == []
    timed = rows.withColumns({"start_us": F.col("id"), "end_us": F.col("id") + 5})
    made = groups.review_groups(timed)
    assert {x.id: x.leader for x in made.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert {x.leader: (x.members, x.transactions, x.entities, x.start_us, x.end_us) for x in groups.group_coverage(made, timed).collect()} == {1: (2, 4, 1, 1, 7), 3: (2, 0, 1, 3, 9), 5: (1, 1, 0, 5, 10), 6: (1, 0, 1, 6, 11)}


def test_change_points_are_the_run_length_posterior(spark):
    r = random.Random(3)
    n = [r.choice((0, 1, 2)) for _ in range(40)] + [r.choice((9, 10, 12)) for _ in range(20)]
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(n)], "family string, bucket long, n double")
    got = [x.changed for x in stats.change_points(series).orderBy("bucket").collect()]
    runs, want = {0: 1.0}, []
    for t, v in enumerate(n):
        new = {}
        for length, p in runs.items():
            a, b = 1 + sum(n[t - length : t]), 1 + length
            like = max(1e-12, exp(lgamma(a + v) - lgamma(a) - lgamma(v + 1) + a * log(b / (b + 1)) - v * log(b + 1)))
            new[0] = new.get(0, 0) + p * like / 240
            new[length + 1] = p * like * (1 - 1 / 240)
        total = sum(new.values())
        runs = {k: p / total for k, p in new.items()}
        want.append(runs[0])
    assert got == pytest.approx(want)


def test_calibration_is_isotonic(spark):
    r = random.Random(4)
    rows = [("many", r.randrange(20) / 20, r.random()) for _ in range(400)] + [("few", 0.5, 1.0)] * 5 + [("one", r.random(), 0.0) for _ in range(50)]
    rows = [(k, s, u < s if k == "many" else k == "few") for k, s, u in rows]
    got = anomaly.calibrate(spark.createDataFrame(rows, "rule string, score double, label boolean")).collect()
    assert [(x.rule, x.x) for x in got if x.rule != "many"].count(("few", None)) == 1 and {x.rule: x.y for x in got if x.x is None} == {"few": pytest.approx(6 / 7), "one": pytest.approx(1 / 52)}
    many = [x for x in rows if x[0] == "many"]
    values = sorted({s for _, s, _ in many})
    n = {v: [x[2] for x in many if x[1] == v] for v in values}
    mean = lambda a, b: sum(sum(n[v]) for v in values[a : b + 1]) / sum(len(n[v]) for v in values[a : b + 1])
    base = sum(x[2] for x in many) / len(many)
    for x in got:
        if x.rule == "many":
            i = values.index(x.x)
            fit = max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1))
            assert x.y == pytest.approx((fit * len(many) + base) / (len(many) + 1))


def test_isolation_forest_sets_the_stranger_apart(spark):
    r = random.Random(5)
    rows = [(i, r.gauss(0, 1), r.gauss(5, 2), i % 10 < 7) for i in range(800)] + [(900, 9.0, -9.0, False)]
    df = spark.createDataFrame(rows, "txid long, a double, b double, is_ref boolean")
    score = {x.txid: x.score for x in anomaly.isolation_forest(df, "txid", ["a", "b"], trees=40).collect()}
    assert max(score, key=score.get) == 900 and all(0 < s < 1 for s in score.values())
    again = {x.txid: x.score for x in anomaly.isolation_forest(df.repartition(7), "txid", ["a", "b"], trees=40).collect()}
    assert again == score
    assert anomaly.isolation_forest(df.where("txid < 0"), "txid", ["a", "b"]).count() == 0


def test_ranks_and_running_totals_by_ranges(spark):
    r = random.Random(6)
    rows = [(i, r.choice((1, 1, 2, 7, r.random())), r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame([(i, float(v), w) for i, v, w in rows], "id long, v double, w long")
    got = ordered.running(ordered.ranked(df, [F.desc("v"), F.col("id")]), [F.desc("v"), F.col("id")], {"through": "w"}).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    total = 0
    for place, (x, (i, _, w)) in enumerate(zip(sorted(got, key=lambda x: x.rank), want), 1):
        total += w
        assert (x.id, x.rank, x.through) == (i, place, total)
    assert ordered.ranked(df.where("id < 0"), [F.col("id")]).count() == 0


def test_component_rounds_shrink(spark, monkeypatch):
    """All rounds together write a few times the edges, on a path and on hubs that share members."""
    kept = graph.keep
    for edges in (spark.range(3000).selectExpr("id * 7919 % 3001 a", "(id + 1) * 7919 % 3001 b"), spark.range(3000).selectExpr("id % 40 a", "100 + id div 3 b")):
        rows = []

        def count(df, tag):
            out = kept(df, tag)
            rows.append(out.count())
            return out

        monkeypatch.setattr(graph, "keep", count)
        got = graph.components(edges).collect()
        assert len(got) == len({x.node for x in got}) == edges.selectExpr("explode(array(a, b)) n").distinct().count()
        assert {x.root for x in got} == {min(x.node for x in got)}
        assert sum(rows) < 12 * 3000, sum(rows)


def test_components_of_any_type(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "q")], "a string, b string")
    assert {(x.node, x.root) for x in graph.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    named = lambda c: F.struct(F.length(c).alias("n"), F.col(c).alias("v")).alias(c)
    got = graph.components(edges.where("a is not null").select(named("a"), named("b"))).collect()
    assert {(x.node.v, x.root.v) for x in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.components(edges.where("a = 'none'")).count() == 0


def test_risk_goes_down_and_up(spark):
    outs = [(1, 0, "seed", 100), (2, 0, "mid", 60), (2, 1, "side", 40), (3, 0, "end", 60), (4, 0, "far", 10)]
    tx_out = spark.createDataFrame([(t, v, a, a, m, 0) for t, v, a, m in outs], "txid long, vout int, addr string, address string, amount long, us long")
    tx_in = spark.createDataFrame([(2, 0, 1, 0, None), (3, 0, 2, 0, None), (4, 0, 9, 9, None)], "txid long, vin int, prev_txid long, prev_vout int, address string")
    wallet = tx_out.select("addr", F.col("addr").alias("wallet"))
    score = lambda seed: {x.wallet: x for x in risk.risk_scores(tx_in, tx_out, wallet, risk.wallet_seeds(spark.createDataFrame([(seed, 1.0)], "ref string, weight double"), wallet)).collect()}
    down = score("seed")
    assert (down["mid"].downstream, down["end"].downstream, down["seed"].risk) == (0.85, 0.7225, 1.0) and "far" not in down and down["seed"].is_seed
    up = score("end")
    assert (up["mid"].upstream, up["seed"].upstream, up["seed"].downstream) == (0.85, pytest.approx(0.85 * 0.85 * 0.6), 0.0)


def test_cuts_at_equal_scores(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 10 else 0.5) for i in range(40)], "id long, score double")
    assert sorted(x.id for x in readside.keep_budget(df, "id", 0.3).collect()) == list(range(12))
    assert [x.id for x in readside.keep_budget(df, "id", 1e-9).collect()] == [0]


def test_poisson_tails_hold_at_any_rate(spark):
    cases = [(k, rate) for rate in (0.25, 3.0, 40.0, 744.0, 746.0, 2000.0, 10_000.0) for k in {0, 1, 5, int(rate), *(int(rate + z * rate**0.5) for z in (-4, -1, 1, 2, 4, 6)), int(3 * rate) + 9} if k >= 0] + [(0, 0.0), (2, 0.0)]
    df = spark.createDataFrame([(k, float(r)) for k, r in cases], "k long, rate double")
    got = {(r.k, r.rate): r.s for r in df.select("k", "rate", layers.poisson_surprise(F.col("k"), F.col("rate")).alias("s")).collect()}
    for k, rate in cases:
        log_term = lambda i: i * log(rate) - rate - lgamma(i + 1)
        if k == 0:
            tail = 1.0
        elif rate == 0:
            tail = 0.0
        elif k > rate:
            tail = sum(exp(log_term(i)) for i in range(k, k + 3000))
        else:
            tail = 1 - sum(exp(log_term(i)) for i in range(k))
        assert got[k, rate] == pytest.approx(-log(max(1e-12, tail)), rel=1e-7, abs=1e-9), (k, rate)


def test_binomial_tails_of_busy_wallets(spark):
    from utxolens.operators.network import binomial_tail

    def plain(k, n, p):
        return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k, n + 1)))

    cases = [(0, 5, 0.3), (3, 5, 0.3), (5, 5, 0.3), (6, 5, 0.3), (2, 9, 0.0), (2, 9, 1.0), (40, 100, 0.3), (20, 100, 0.3), (3000, 9000, 0.31), (2700, 9000, 0.31), (9000, 9000, 0.999)]
    df = spark.createDataFrame(cases + [(5_000_900, 10_000_000, 0.5)], "k long, n long, p double")
    got = {(r.k, r.n, r.p): r.t for r in df.select("k", "n", "p", binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()}
    for k, n, p in cases:
        want = 1.0 if k <= 0 or p >= 1 else 0.0 if p <= 0 or k > n else plain(k, n, p)
        assert got[k, n, p] == pytest.approx(want, rel=1e-7, abs=1e-12)
    # 900 of 10 million above the mean: 0.569 standard deviations.
    assert got[5_000_900, 10_000_000, 0.5] == pytest.approx(1 - NormalDist().cdf(899.5 / (10_000_000 * 0.25) ** 0.5), abs=1e-6)


def test_path_signals_count_other_findings_only(spark):
    paths = spark.createDataFrame([(1, "c", ["a", "b", "b", "x"]), (2, "c", ["a"]), (3, "d", ["a"])], "id long, case string, nodes array<string>")
    found = spark.createDataFrame([(1, "c", "a", "open"), (1, "c", "b", "open"), (9, "c", "b", "open"), (8, "c", "x", "dismissed"), (7, "e", "a", "open")], "id long, case string, entity_ref string, status string")
    assert {r.id: r.share for r in readside.path_signals(paths, found).collect()} == {1: pytest.approx(1 / 3), 2: 1.0, 3: 0.0}


def test_stack_findings_are_those_over_the_references_quantile(spark):
    import numpy as np

    r = random.Random(11)
    rows = [(i, i < 140, float(r.randrange(30)), r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "txid long, is_ref boolean, a double, b double")
    tx = spark.createDataFrame([(i, (i % 50) * 1_000_000_000) for i in range(200)], "txid long, us long")
    fused = {x.txid: x.fused for x in layers.stouffer(df, ["a", "b"], [1.0, 1.0]).collect()}
    cut = np.quantile([fused[i] for i in range(140)], 0.9)
    want = sorted((i for i in fused if fused[i] >= cut - 1e-12), key=lambda i: (-fused[i], (i % 50), i))
    got = layers.stack_findings(df, tx, ["a", "b"], budget=0.1).orderBy("rank").collect()
    assert [x.entity_ref for x in got] == [f"tx:{i}" for i in want] and [x["rank"] for x in got] == list(range(1, len(want) + 1))
    assert all(x.end_us - x.start_us == 900_000_000 and x.start_us % 900_000_000 == 0 for x in got)
    one = {x.entity_ref for x in layers.stack_findings(df, tx, ["a"], budget=0.1).collect()}
    assert one == {f"tx:{i}" for i, _, a, _ in rows if a >= np.quantile([x[2] for x in rows[:140]], 0.9)}
    assert layers.stack_findings(df.where("txid < 40"), tx, ["a"], budget=0.1).count() == 0


def test_causal_bursts_know_only_completed_buckets(spark):
    minute = 60_000_000
    times = [(i, t * minute, "f", t != 31) for i, t in enumerate([0, 1, 2, 16, 31, 32, 33, 34, 35, 36, 46, 61])]
    got = {x.txid: x.burst for x in stats.causal_bursts(spark.createDataFrame(times, "txid long, us long, family string, member boolean")).collect()}
    counts, rate, surprise = [3, 1, 5, 1, 1], 0.25, []
    for n in counts:
        base = max(0.25, rate)
        surprise.append(-log(max(1e-12, 1 - sum(exp(k * log(base) - base - lgamma(k + 1)) for k in range(n)))))
        rate = rate * 0.5 ** (1 / 96) + n * (1 - 0.5 ** (1 / 96))
    for i, t, _, member in times:
        bucket = t // (15 * minute)
        assert got[i] == pytest.approx(surprise[bucket - 1] if bucket and member else 0.0)


def test_risk_rounds_hold_a_row_a_transaction(spark, monkeypatch):
    kept, seen = risk.keep, {}
    monkeypatch.setattr(risk, "keep", lambda df, tag: seen.setdefault(tag, df.columns) and kept(df, tag))
    outs = spark.createDataFrame([(t, v, f"a{t}{v}", 10) for t in range(4) for v in range(2)], "txid long, vout int, addr string, amount long")
    ins = spark.createDataFrame([(t + 1, t, 0) for t in range(3)], "txid long, prev_txid long, prev_vout int")
    wallet = outs.select("addr", F.col("addr").alias("wallet"))
    got = risk.risk_scores(ins, outs, wallet, spark.createDataFrame([("a00", 1.0)], "wallet string, seed double"), hops=2)
    assert {r.wallet: r.downstream for r in got.collect() if r.downstream > 0} == {"a00": 1.0, "a10": 0.85, "a11": 0.85, "a20": 0.7225, "a21": 0.7225}
    assert seen["risk-down"] == seen["risk-up"] == ["txid", "t"]


def test_hops_that_go_on_alike_are_one_walk_and_patterns_see_numbers_only(spark, monkeypatch):
    # Two outpoints that transaction 5 spends go on by its output 1; a third goes on by its output 0.
    rows = [(1, 0, 5, 1), (2, 0, 5, 1), (3, 0, 5, 0), (5, 1, 6, 0), (5, 0, 7, None), (6, 0, 8, None)]
    hops = spark.createDataFrame(rows, "prev_txid long, prev_vout int, spend_txid long, next_vout int")
    got = sorted((x.start_txid, x.start_vout, x.walk) for x in graph.doubled_walks(hops, F.col("spend_txid"), 4).collect())
    assert got == [(1, 0, [5, 6, 8]), (3, 0, [5, 7]), (5, 0, [7]), (5, 1, [6, 8]), (6, 0, [8])]
    seen, plain = [], peeling.components
    monkeypatch.setattr(peeling, "components", lambda edges: seen.append(edges.dtypes) or plain(edges))
    signals = spark.createDataFrame([(1, 0, "address:a", 3, 0.5, 0, "5,6,8"), (9, 0, "address:a", 3, 0.7, 5, "11,12,13"), (2, 0, "address:b", 3, 0.6, None, "6,8,9"), (4, 0, "address:c", 4, 0.2, 7, "1,2,3,4")], "start_txid long, start_vout int, entity_ref string, hops long, score double, first_us long, path string")
    found = sorted((x.pattern, x.chains, x.transactions, x.hops, x.score, x.path) for x in peeling.peeling_groups(signals).collect())
    assert found == [("c:1:0", 3, 7, 3, 0.7, "11,12,13"), ("c:4:0", 1, 4, 4, 0.2, "1,2,3,4")]
    assert seen == [[("a", "bigint"), ("b", "bigint")]]


def test_only_shared_anchors_are_carried_and_findings_are_linked_by_number(spark, monkeypatch):
    rows = [(1, 0, 9, "peel", "tx:1", ["a", "b"]), (2, 1, 9, "peel", "tx:2", ["b", "c"]), (3, 2, 9, "peel", "tx:3", ["d", "d"]), (4, 3, 9, "fan", "e", ["a", "s"]), (5, 3, 9, "fan", None, ["a"]), (6, 4, 9, "fan", None, ["a"]), (7, 5, 9, "fan", "e", ["s"])]
    found = spark.createDataFrame(rows, "id long, start_us long, end_us long, rule string, entity_ref string, anchors array<string>")
    seen, plain = [], groups.components
    monkeypatch.setattr(groups, "components", lambda edges: seen.append((edges.dtypes, edges.count())) or plain(edges))
    got = {x.id: (x.leader, x.ordinal, x.singleton) for x in groups.review_groups(found).collect()}
    assert got == {1: (1, 0, None), 2: (1, 1, None), 3: (3, 0, None), 4: (4, 0, None), 5: (5, 0, None), 6: (5, 1, None), 7: (4, 1, None)}
    # One row for each finding and anchor that another finding has too.
    assert seen == [([("a", "bigint"), ("b", "bigint")], 6)]


def test_episodes_of_all_parts(spark):
    from types import SimpleNamespace

    from utxolens.plans import review

    quarter = 900_000_000
    outs = spark.createDataFrame([(p, t, p * 5 % 3 * quarter, "a") for p in (7, 100_007, 2_100_007) for t in (1, 2)], "part long, txid long, us long, addr string")
    ins = spark.createDataFrame([(2, 1)], "txid long, prev_txid long")
    d = SimpleNamespace(tx_in=ins, tx_out=outs, tx=spark.createDataFrame([(1, 0), (2, 5)], "txid long, us long"))
    got = review._episodes(d).collect()
    assert sorted(x.entity_ref for x in got) == ["address:p100007", "address:p2100007", "address:p7", "tx:2"] and len({x.id for x in got}) == 4
    assert {len(x.anchors) for x in got} == {2} and min(x.id for x in got if x.rule == "fan_out") == (1 << 40) + 100_000 * (7 * 5 % 3) + 7


def test_risk_of_addresses_has_both_directions_and_eight_hops(spark):
    # A line of eleven transactions with a seed at its sixth: five hops lie before it, five after it.
    outs = spark.createDataFrame([(t, 0, f"a{t}", 100, t) for t in range(11)], "txid long, vout int, addr string, amount long, part long")
    ins = spark.createDataFrame([(t + 1, t, 0) for t in range(10)], "txid long, prev_txid long, prev_vout int")
    seeds = spark.createDataFrame([(5, 1.0), (5, 0.5)], "part long, weight double")
    got = {r.addr: r for r in risk.address_risk(ins, outs, seeds, by="part").collect()}
    assert {a: r.downstream for a, r in got.items() if r.downstream} == {f"a{5 + k}": pytest.approx(0.85**k, abs=1e-6) for k in range(6)}
    assert {a: r.upstream for a, r in got.items() if r.upstream} == {f"a{5 - k}": pytest.approx(0.85**k, abs=1e-6) for k in range(6)}
    assert sorted(got) == sorted(f"a{t}" for t in range(11)) and [a for a, r in got.items() if r.is_seed] == ["a5"]
    far = {r.addr for r in risk.address_risk(ins, outs, spark.createDataFrame([(0, 1.0)], "part long, weight double"), by="part").collect()}
    assert far == {f"a{t}" for t in range(9)}, "eight hops and no more"
