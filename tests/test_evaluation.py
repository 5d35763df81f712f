"""Evaluation operators, trailing counts and prior places against plain Python."""

import random
from itertools import combinations
from math import inf, log1p
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F
from utxolens.operators import evaluation, windows

TASKS = {"motif": ("hit", "everyone"), "near": ("hit", "close")}


def judged(seed, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hit, near = r.random() < 0.2, r.random() < 0.3
        rows.append((i, "xy"[i % 2], i < 0.7 * n, i >= 0.7 * n, near and not hit, hit, True, hit or near, r.randrange(5) / 2 + hit, None if r.random() < 0.1 else r.random() + hit / 2, float(r.randrange(3))))
    return rows, "txid long, ds string, is_ref boolean, is_eval boolean, near_miss boolean, hit boolean, everyone boolean, close boolean, a double, b double, rule double"


def quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    lo, hi = v[int(at)], v[min(len(v) - 1, int(at) + (at > int(at)))]
    return lo if lo == hi else lo + (hi - lo) * (at - int(at))


def plain(rows, fusion, budget, ks):
    """{(ds, task, candidate): measurements} by one loop over candidates; ties by blocks of equal scores."""
    out = {}
    for ds in "xy":
        own = [r for r in rows if r[1] == ds]
        val = {"a": lambda r: r[8], "b": lambda r: -inf if r[9] is None else r[9]}
        ref = {c: [f(r) for r in own if r[2]] for c, f in val.items()}

        def part(c, r):
            v = val[c](r)
            if fusion == "rank_average":
                return sum(x <= v for x in ref[c]) / len(ref[c])
            return NormalDist().inv_cdf(1 - min(1 - 1e-9, max(1e-9, (sum(x >= v for x in ref[c]) + 1) / (len(ref[c]) + 1))))

        names = {"rule_baseline": lambda r: r[10], **{c: val[c] for c in "ab"}}
        for s in combinations("ab", 2):
            names["+".join(s)] = lambda r, s=s: sum(part(c, r) for c in s) / (len(s) if fusion == "rank_average" else len(s) ** 0.5)
        for name, score in names.items():
            for task, inside in (("motif", lambda r: True), ("near", lambda r: r[7])):
                cut = quantile([score(r) for r in own if r[2] and inside(r)], 1 - budget)
                ev = [(round(score(r), 12), r[5], r[4], score(r) >= cut) for r in own if r[3] and inside(r)]
                ap = above = 0.0
                hits, done, pos = {k: 0.0 for k in ks}, 0, 0
                total, positives = len(ev), sum(e[1] for e in ev)
                for v in sorted({e[0] for e in ev}, reverse=True):
                    block = [e for e in ev if e[0] == v]
                    p = sum(e[1] for e in block)
                    for k in ks:
                        hits[k] += p * min(1, max(0, (min(k, total) - done) / len(block)))
                    done, pos = done + len(block), pos + p
                    ap += p * pos / done
                pairs = [(x > y) + (x == y) / 2 for x, h, *_ in ev if h for y, g, *_ in ev if not g]
                flagged = [e for e in ev if e[3]]
                share = lambda a, b, other=None: a / b if b else other
                out[ds, task, name] = (total, positives, len(flagged), share(sum(e[1] for e in flagged), len(flagged), 0.0), sum(e[1] for e in flagged) / max(1, positives), share(sum(e[2] for e in flagged), len(flagged), 0.0),
                                       share(ap, positives), share(sum(pairs), len(pairs)), *[share(hits[k], min(k, total)) for k in ks])
    return out


@pytest.mark.parametrize("fusion", ["rank_average", "stouffer"])
def test_every_combination_measures_what_one_loop_does(spark, fusion):
    rows, schema = judged(3)
    got = evaluation.ablation(spark.createDataFrame(rows, schema), ["a", "b"], "rule", TASKS, by=("ds",), fusion=fusion, budget=0.1, ks=(5, 30)).collect()
    want = plain(rows, fusion, 0.1, (5, 30))
    columns = ("rows", "positives", "flagged", "precision_at_budget", "recall_at_budget", "near_miss_rate", "average_precision", "roc_auc", "precision_at_5", "precision_at_30")
    assert len(got) == len(want) == 16
    for r in got:
        assert tuple(r[c] for c in columns) == pytest.approx(want[r.ds, r.task, r.candidate]), (r.ds, r.task, r.candidate)


def test_an_ablation_of_nothing_measures_nothing(spark):
    rows, schema = judged(4, 20)
    assert evaluation.ablation(spark.createDataFrame([], schema), ["a"], "rule", TASKS).count() == 0
    blank = spark.createDataFrame(rows, schema).withColumns({"hit": F.lit(False), "is_ref": F.lit(False)})
    for r in evaluation.ablation(blank, ["a", "b"], "rule", TASKS, max_size=1).collect():
        assert (r.positives, r.flagged, r.average_precision, r.roc_auc) == (0, 0, None, None) and r.candidate in ("rule_baseline", "a", "b")


def test_queues_are_compared_only_where_they_can_be(spark):
    schema = "txid long, candidate double, baseline double, label boolean, benign boolean, merchant boolean"
    rows = [(i, float(i % 7), float(i % 5), i % 3 == 0, i % 3 > 0, i % 3 == 1) for i in range(60)]
    r = evaluation.queue_comparison(spark.createDataFrame(rows, schema), 10).first()
    top = lambda k: sorted(rows, key=lambda x: (-x[k], x[0]))[:10]
    a, b = top(1), top(2)
    assert r.status == "EVALUATED" and r.candidate_precision == sum(x[3] for x in a) / 10 and r.baseline_recall == sum(x[3] for x in b) / 20
    assert (r.candidate_merchant, r.baseline_merchant, r.merchant_removed, r.merchant_new) == (sum(x[5] for x in a), sum(x[5] for x in b), sum(x[5] for x in b if x not in a), sum(x[5] for x in a if x not in b))
    for bad, budget, word in (([(*rows[0][:3], None, None, None), *rows[1:]], 10, "cover"), (rows, 61, "capacity"), (rows, 0, "capacity"), ([(*x[:3], False, True, True) for x in rows], 10, "positive"), ([(*x[:5], False) for x in rows], 10, "merchant"), ([], 10, "capacity")):
        r = evaluation.queue_comparison(spark.createDataFrame(bad, schema), budget).first()
        assert r.status == "NOT EVALUABLE" and word in r.reasons and r.candidate_precision is None and r.merchant_new is None


def test_what_was_not_measured_is_no_worst_case(spark):
    schema = "dataset string, task string, population long, prevalence double, review_budget int, ap double, p_at_100 double, p_at_review_budget double, recall_at_review_budget double, benign_false_positives double, minimum_ap_delta double"
    good = (0.9, 0.95, 0.9, 0.5, 3.0, 0.1)
    rows = [("x", "t", 200, 0.1, 50, *good), ("y", "t", 60, 0.1, 50, 0.88, 0.2, 0.8, 0.4, 9.0, 0.0),
            ("x", "u", 200, 0.0, 50, *good), ("y", "u", 200, 0.1, None, 1.5, float("nan"), 0.5, 0.5, 2.5, 0.1), ("x", "v", 200, 0.1, 50, *good)]
    reports, sets = spark.createDataFrame(rows, schema), spark.createDataFrame([("x",), ("y",)], "dataset string")
    matrix = evaluation.quality_matrix(reports, sets, ["t", "u", "v"], 50)
    got = {(r.task, r.metric): (r.status, r.worst, r.unknown) for r in matrix.collect()}
    assert got["t", "ap"] == ("COMPLETE", 0.88, 0) and got["t", "benign_false_positives"] == ("COMPLETE", 9.0, 0) and got["t", "minimum_ap_delta"] == ("COMPLETE", 0.0, 0)
    assert got["t", "p_at_100"] == ("COMPLETE", 0.95, 0)  # 60 rows have no precision at 100: that dataset does not count
    assert got["u", "ap"] == ("INCOMPLETE", None, 2) and got["u", "p_at_100"] == ("INCOMPLETE", None, 1) and got["u", "p_at_review_budget"] == ("INCOMPLETE", None, 1)
    assert got["u", "benign_false_positives"] == ("INCOMPLETE", None, 1) and got["u", "minimum_ap_delta"] == ("INCOMPLETE", None, 2)
    assert all(got["v", m] == ("INCOMPLETE", None, 1) for m in evaluation.METRICS)  # a report that is missing is unknown
    gates = {(r.task, r.gate): r.status for r in evaluation.quality_gates(matrix).collect()}
    assert [gates["t", g] for g in ("ap_preferred", "ap_stretch", "p100", "no_ap_regression")] == ["PASS", "FAIL", "PASS", "PASS"] and gates["v", "ap_stretch"] == "NOT EVALUABLE" and len(gates) == 12


def test_risk_and_flags_against_pairs(spark):
    r = random.Random(5)
    risk = {f"w{i}": r.randrange(4) / 4 for i in range(40)}
    one = lambda names: spark.createDataFrame([(n,) for n in names], "wallet string")
    tainted, seeds = ["w1", "w2", "w3", "w9", "gone"], ["w3", "w4"]
    got = evaluation.risk_quality(spark.createDataFrame([(w, v) for w, v in risk.items() if v], "wallet string, risk double"), one(risk), one(tainted), one(seeds)).first()
    mine, rest = [risk.get(w, 0) for w in tainted if w not in seeds], [v for w, v in risk.items() if w not in tainted + seeds]
    auc = sum((x > y) + (x == y) / 2 for x in mine for y in rest) / len(mine) / len(rest)
    assert (got.tainted_wallets, got.reached, got.auc) == (4, sum(x > 0 for x in mine), pytest.approx(auc))
    assert tuple(evaluation.risk_quality(spark.createDataFrame([], "wallet string, risk double"), one([]), one([]), one([])).first()) == (0, 0, None, None)
    ref = lambda names: spark.createDataFrame([(n,) for n in names], "ref string")
    assert tuple(evaluation.flag_quality(ref("aabc"), ref("bcdd")).first()) == (3, 3, 2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert tuple(evaluation.flag_quality(ref(""), ref("b")).first()) == (0, 1, 0, 0.0, None)
    found = evaluation.scenario_coverage(spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", None), (3, "exchange", "a")], "scenario long, kind string, ref string"), ref("bb"))
    assert [tuple(x) for x in found.collect()] == [("k", 1, 2, 0.5)]


def test_counts_behind_a_row_without_one_task_a_key(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["h", "h", "h", "i", None]), r.randrange(40) * 1_000_000) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, us long")
    got = {x.id: x.n for x in windows.trailing_count(df, "k", "us", 5, "n").collect()}
    assert len(got) == 300 and all(got[i] == pytest.approx(log1p(0 if k is None else sum(q == k and t - 5_000_000 <= u < t for _, q, u in rows))) for i, k, t in rows)
    place = {x.id: x.n for x in windows.prior_index(df, "k", ["us", "id"], "n").collect()}
    assert len(place) == 300 and all(place[i] == sum(q == k and (u, j) < (t, i) for j, q, u in rows) for i, k, t in rows)
    assert windows.trailing_count(df.limit(0), "k", "us", 5, "n").count() == windows.prior_index(df.limit(0), "k", ["us"], "n").count() == 0


def test_recipients_before_a_transaction(spark):
    r = random.Random(7)
    rows = [(t, v, r.choice(["h", "h", "h", "i", "j", None]), (t // 3) * 1_000_000) for t in range(90) for v in range(r.randrange(1, 4))]
    got = {x.txid: x for x in windows.recipient_history(spark.createDataFrame(rows, "txid long, vout int, addr string, us long")).collect()}
    pairs = {(t, a, u) for t, _, a, u in rows if a}
    assert set(got) == {t for t, *_ in pairs}
    for t, x in got.items():
        past = [sorted(u for _, b, u in pairs if b == a and u < now) for own, a, now in pairs if own == t]
        want = (len(past), sum(bool(p) for p in past) / len(past), sum(map(len, past)) / len(past), max([(p[-1] - p[0]) / 1e6 for p in past if p], default=0.0))
        assert (x.recipients, x.prior_fraction, x.mean_prior_count, x.max_span) == pytest.approx(want)
