"""Queries on spend latency, histories, graph features, forests and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, stats
from .core import _RESOLVED
from .domain import Domain
from .measures import _REF, _SCORED
from .registry import query

_LATENCY = """, hz AS (SELECT max(us) AS h FROM tx), fs AS (SELECT prev_txid, prev_vout, min(t.us) AS us, arg_min(i.txid, t.us::HUGEINT * 100000000 + i.txid) AS spend_txid FROM tx_in i JOIN tx t USING (txid) GROUP BY prev_txid, prev_vout),
    lt AS (SELECT o.txid, o.vout, o.amount, greatest(0, (coalesce(fs.us, h) - o.us) // 1000000) AS duration, fs.us IS NOT NULL AS event, spend_txid FROM tx_out o LEFT JOIN fs ON fs.prev_txid = o.txid AND fs.prev_vout = o.vout, hz),
    qe AS (SELECT quantile_cont(ln(1 + amount), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lt), ls AS (SELECT lt.*, len(list_filter(edges, lambda e: e <= ln(1 + amount))) AS stratum FROM lt, qe),
    kt AS (SELECT stratum, duration, count(*) FILTER (event) AS d, count(*) AS c FROM ls GROUP BY stratum, duration), rk AS (SELECT *, sum(c) OVER (PARTITION BY stratum ORDER BY duration DESC ROWS UNBOUNDED PRECEDING) AS a FROM kt),
    sv AS (SELECT stratum, duration, CASE WHEN max((d = a)::INT) OVER u = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN d = a THEN 1 ELSE 1 - d / a END)) OVER u) END AS survival FROM rk WHERE d > 0 WINDOW u AS (PARTITION BY stratum ORDER BY duration ROWS UNBOUNDED PRECEDING))"""


@query(_LATENCY + "SELECT * FROM lt")
def latency_table(d: Domain):
    return anomaly.latency_table(d.tx_in, d.tx_out, d.tx)


@query(_LATENCY + "SELECT spend_txid AS txid, round(max(-ln(greatest(1e-12, least(1, 1 - survival)))), 6) + 0.0 AS surprise FROM ls JOIN sv USING (stratum, duration) WHERE event GROUP BY spend_txid")
def latency_surprise(d: Domain):
    return anomaly.latency_surprise(anomaly.latency_table(d.tx_in, d.tx_out, d.tx)).withColumn("surprise", F.round("surprise", 6) + 0.0)


_LAYER = _REF + """, ht AS (SELECT addr, us - us % 900000000 AS start_us, txid, sum(amount) AS value, max((fee >= 900)::INT) AS motif FROM (SELECT o.addr, o.us, o.txid, o.amount, tx.fee FROM tx_out o JOIN tx USING (txid)) WHERE addr IS NOT NULL GROUP BY ALL),
    hw AS (SELECT addr, start_us, count(*) AS events, sum(value) AS value, sum(motif) AS motif, min(txid) AS first_txid FROM ht GROUP BY addr, start_us),
    hh AS (SELECT addr, start_us, events, value, first_txid, row_number() OVER o - 1 AS prior_windows, coalesce(sum(events) OVER p, 0) AS prior_events, coalesce(sum(value) OVER p, 0) AS prior_value, coalesce(sum(motif) OVER p, 0) AS prior_motif, coalesce((start_us - lag(start_us) OVER o) / 1e6, -1) AS gap
        FROM hw WINDOW o AS (PARTITION BY addr ORDER BY start_us), p AS (PARTITION BY addr ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    hr AS (SELECT hh.*, is_ref FROM hh JOIN rf ON rf.txid = first_txid), pp AS (SELECT avg(events) FILTER (is_ref) AS pop, avg(ln(1 + value)) FILTER (is_ref) AS pop_value, stddev_pop(ln(1 + value)) FILTER (is_ref) AS spread, min(start_us) AS origin FROM hr),
    sl AS (SELECT addr, start_us, is_ref, events, (prior_events + 4 * pop) / (prior_windows + 4) AS rate, round(greatest(ln(1 + value) - CASE WHEN prior_windows > 0 THEN ln(1 + prior_value / prior_windows) ELSE pop_value END, 0) / greatest(spread, 1e-6), 9) + 0.0 AS value_surge,
        round(CASE WHEN prior_windows > 1 AND gap > 0 AND start_us > origin THEN ln(1 + gap / ((start_us - origin) / 1e6 / prior_windows)) ELSE 0 END, 9) + 0.0 AS reactivation, round(ln(1 + prior_motif), 9) + 0.0 AS recurrence FROM hr, pp),
    sa AS (SELECT *, round(-ln(greatest(1e-12, 1 - (SELECT sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) FROM generate_series(0, events - 1) s(i)))), 9) + 0.0 AS activity FROM sl),
    sr AS (SELECT *, sum(is_ref::INT) OVER (ORDER BY activity) / sum(is_ref::INT) OVER () AS rank_activity, sum(is_ref::INT) OVER (ORDER BY value_surge) / sum(is_ref::INT) OVER () AS rank_value_surge, sum(is_ref::INT) OVER (ORDER BY reactivation) / sum(is_ref::INT) OVER () AS rank_reactivation, sum(is_ref::INT) OVER (ORDER BY recurrence) / sum(is_ref::INT) OVER () AS rank_recurrence FROM sa),
    hl AS (SELECT *, (rank_activity + rank_value_surge + 0.5::DOUBLE * rank_reactivation + 0.5::DOUBLE * rank_recurrence) / 3 AS score FROM sr)"""


def _layer(d: Domain):
    rows = anomaly.history_rows(d.tx_out, d.tx.where("fee >= 900").select("txid"))
    return anomaly.history_layer(rows, stats.reference_set(d.tx))


@query(_LAYER + "SELECT addr, start_us, round(activity, 6) AS activity, round(value_surge, 6) AS value_surge, round(reactivation, 6) AS reactivation, round(recurrence, 6) AS recurrence FROM hl")
def history_signals(d: Domain):
    return _layer(d).select("addr", "start_us", *[F.round(c, 6).alias(c) for c in ("activity", "value_surge", "reactivation", "recurrence")])


@query(_LAYER + ", pd AS (SELECT DISTINCT txid, addr, us - us % 900000000 AS start_us FROM tx_out WHERE addr IS NOT NULL) SELECT txid, round(max(score), 6) AS score FROM pd JOIN hl USING (addr, start_us) GROUP BY txid")
def history_score(d: Domain):
    return anomaly.history_scores(_layer(d), d.tx_out).withColumn("score", F.round("score", 6))


@query(_RESOLVED + """, oo AS (SELECT o.txid, o.amount, CASE WHEN addr IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY addr ORDER BY tx.us, o.txid, vout) - 1 END AS prior FROM tx_out o JOIN tx USING (txid)), oa AS (SELECT txid, count(*) AS out_degree, sum(amount) AS value_out, avg(prior) AS reuse_mean, max(prior)::INT AS reuse_max, avg((prior > 0)::INT) AS seen_share FROM oo GROUP BY txid),
    ia AS (SELECT txid, count(*) AS in_degree, count(DISTINCT prev_txid) AS parents, sum(prev_amount) AS value_in FROM r WHERE prev_amount IS NOT NULL GROUP BY txid)
    SELECT txid, coalesce(in_degree, 0) AS in_degree, out_degree, (out_degree - coalesce(in_degree, 0)) / (out_degree + coalesce(in_degree, 0)) AS asymmetry, coalesce(parents, 0) AS parents, round(ln(1 + coalesce(value_in, 0)), 6) + 0.0 AS log_value_in, round(ln(1 + value_out), 6) + 0.0 AS log_value_out, round(reuse_mean, 9) AS reuse_mean, reuse_max, round(seen_share, 9) AS seen_share FROM oa LEFT JOIN ia USING (txid)""")
def graph_features(d: Domain):
    f = anomaly.graph_features(d.tx_in, d.tx_out, d.tx)
    return f.withColumns({c: F.round(c, 6) + 0.0 for c in ("log_value_in", "log_value_out")} | {c: F.round(c, 9) for c in ("reuse_mean", "seen_share")})


@query()
def isolation_scores(d: Domain):
    shapes = d.shapes
    columns = [c for c in shapes.columns if c != "txid"]
    return anomaly.isolation_forest(shapes.join(stats.reference_set(d.tx), "txid"), "txid", columns)


@query(_SCORED + ", kn AS (SELECT *, row_number() OVER (ORDER BY score DESC, txid) AS place FROM (SELECT fee / 1000 AS score, txid % 10 < fee // 150 AS label, txid FROM tx)) SELECT k, count(*) FILTER (label) / count(*) AS precision, count(*) FILTER (label) / (SELECT count(*) FILTER (label) FROM kn) AS recall FROM kn, (VALUES (10), (100), (500)) v(k) WHERE place <= k GROUP BY k")
def precision_at(d: Domain):
    rows = d.tx.select("txid", (F.col("fee") / 1000).alias("score"), (F.col("txid") % 10 < F.floor(F.col("fee") / 150)).alias("label"))
    return anomaly.precision_at(rows, "txid", [10, 100, 500])


# Knots of a calibration as a registry gives them.
_KNOTS = ([0.0, 0.2, 0.5, 0.9], [0.05, 0.1, 0.55, 0.8])


@query("SELECT txid, round(CASE WHEN fee / 1000 <= 0.0 THEN 0.05 WHEN fee / 1000 < 0.2 THEN 0.05 + 0.05 * (fee / 1000 - 0.0) / 0.2 WHEN fee / 1000 < 0.5 THEN 0.1 + 0.45 * (fee / 1000 - 0.2) / 0.3 WHEN fee / 1000 < 0.9 THEN 0.55 + 0.25 * (fee / 1000 - 0.5) / 0.4 ELSE 0.8 END, 6) AS confidence FROM tx")
def calibrated_confidence(d: Domain):
    return d.tx.select("txid", F.round(anomaly.interpolated(F.col("fee") / 1000, *_KNOTS), 6).alias("confidence"))


@query()
def calibration_knots(d: Domain):
    return anomaly.calibrate(d.tx.select(F.concat(F.lit("rule-"), (F.col("txid") % 4).cast("string")).alias("rule"), (F.col("fee") / 1000).alias("score"), (F.col("txid") * 31 % 1000 < F.col("fee")).alias("label")))
