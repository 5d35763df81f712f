"""Queries on histories, fusion, labels, flows and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers, stats, windows
from .core import _FEATURES, _RESOLVED, _rule
from .domain import Domain
from .measures import _REF
from .registry import query


@query(""", pa AS (SELECT DISTINCT i.txid, i.prev_txid AS parent FROM tx_in i JOIN tx_out o ON o.txid = i.prev_txid AND o.vout = i.prev_vout), ind AS (SELECT txid, count(*) AS d, count(DISTINCT prev_txid) AS p FROM tx_in GROUP BY txid), oud AS (SELECT txid, count(*) AS d FROM tx_out GROUP BY txid)
    SELECT o.txid, coalesce(i.d, 0) AS in_degree, o.d AS out_degree, (o.d - coalesce(i.d, 0)) / (o.d + coalesce(i.d, 0)) AS asymmetry, coalesce(p, 0) AS prev_txs,
    ((o.txid IN (SELECT txid FROM pa))::INT + (o.txid IN (SELECT a.txid FROM pa a WHERE a.parent IN (SELECT txid FROM pa)))::INT)::INT AS depth FROM oud o LEFT JOIN ind i USING (txid)""")
def chain_features(d: Domain):
    return layers.chain_features(d.tx_in, d.tx_out)


_HIST = ", hr AS (SELECT addr, us - us % 900000000 AS start_us, count(*) AS events, sum(amount)::BIGINT AS value FROM tx_out WHERE addr IS NOT NULL GROUP BY 1, 2), hs AS (SELECT addr, start_us, events, value, (row_number() OVER o - 1)::INT AS prior_windows, coalesce(sum(events) OVER p, 0)::BIGINT AS prior_events, coalesce(sum(value) OVER p, 0)::BIGINT AS prior_value, (start_us - lag(start_us) OVER o) / 1e6 AS gap FROM hr WINDOW o AS (PARTITION BY addr ORDER BY start_us), p AS (PARTITION BY addr ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(_HIST + "SELECT * FROM hs")
def history_table(d: Domain):
    return layers.history_table(d.tx_out)


@query(_HIST + ", ra AS (SELECT addr, start_us, events, (prior_events + 4 * (SELECT avg(events) FROM hs)) / (prior_windows + 4) AS rate FROM hs) SELECT addr, start_us, round(rate, 9) AS rate, round(-ln(greatest(1e-12, 1 - (SELECT sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) FROM generate_series(0, events - 1) s(i)))), 6) AS surprise FROM ra")
def history_surprise(d: Domain):
    h = layers.empirical_rate(layers.history_table(d.tx_out))
    return h.select("addr", "start_us", F.round("rate", 9).alias("rate"), F.round(layers.poisson_surprise(F.col("events"), F.col("rate")), 6).alias("surprise"))


@query()
def stouffer_fuse(d: Domain):
    rows = d.tx.select("txid", "fee", "us").join(stats.reference_set(d.tx), "txid")
    return layers.stouffer(rows, ["fee", "us"], [1.0, 0.5])


@query(", rv AS (SELECT l_linenumber AS id, l_orderkey AS finding, epoch_us(l_shipdate) AS us, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'dismissed' ELSE 'open' END AS decision, row_number() OVER (PARTITION BY l_orderkey ORDER BY epoch_us(l_shipdate) DESC, l_linenumber DESC, l_returnflag DESC) AS rn, l_shipdate FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01') SELECT finding, CASE decision WHEN 'confirmed' THEN 1 WHEN 'dismissed' THEN 0 END AS label FROM rv WHERE rn = 1")
def analyst_labels(d: Domain):
    flag = F.col("l_returnflag")
    decision = F.when(flag == "A", "confirmed").when(flag == "R", "dismissed").otherwise("open")
    r = d.star("lineitem").select(F.struct("l_linenumber", "l_returnflag").alias("id"), F.col("l_orderkey").alias("finding"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), decision.alias("decision"))
    return layers.latest_labels(r, 883612800000000)


@query(", cut AS (SELECT 1704067200000000 + 200 * 3600000000 AS c) SELECT i.txid, count(*) AS inputs FROM tx_in i JOIN tx t USING (txid), cut WHERE t.us <= c GROUP BY i.txid")
def as_of_view(d: Domain):
    _, ins = layers.as_of(d.tx, d.tx_in, 1704067200000000 + 200 * 3600000000)
    return ins.groupBy("txid").agg(F.count("*").alias("inputs"))


@query(", cut AS (SELECT 1704067200000000 + 200 * 3600000000 AS c), kn AS (SELECT txid, seq FROM tx, cut WHERE us <= c), fs AS (SELECT prev_txid, prev_vout, min_by(txid, (seq, vin)) AS spent_by FROM tx_in JOIN kn USING (txid) GROUP BY prev_txid, prev_vout) SELECT o.txid, o.vout, spent_by FROM tx_out o JOIN kn USING (txid) LEFT JOIN fs ON fs.prev_txid = o.txid AND fs.prev_vout = o.vout")
def as_of_outputs(d: Domain):
    return layers.as_of_outputs(d.tx, d.tx_in, d.tx_out, 1704067200000000 + 200 * 3600000000).select("txid", "vout", "spent_by")


_NET = ", nw AS (SELECT txid, min(src_ip) AS src_ip, min(asn) AS asn, min(country) AS country FROM obs JOIN tx USING (txid) GROUP BY txid), plc AS (SELECT txid, row_number() OVER (ORDER BY us, txid) - 1 AS i FROM tx)"


def _network(d: Domain):
    return d.obs.join(d.tx.select("txid"), "txid", "left_semi").groupBy("txid").agg(*[F.min(c).alias(c) for c in ("src_ip", "asn", "country")])


@query(_RESOLVED + _NET + ", ri AS (SELECT txid, vin, row_number() OVER (ORDER BY plc.i, txid, vin) - 1 AS k FROM r JOIN plc USING (txid) JOIN nw USING (txid) WHERE prev_us IS NOT NULL) SELECT txid, vin, CASE WHEN k % 20 = 0 THEN NULL ELSE prev_txid END AS prev_txid, CASE WHEN k % 20 = 0 THEN NULL ELSE prev_vout END AS prev_vout FROM tx_in LEFT JOIN ri USING (txid, vin)")
def stress_prevouts(d: Domain):
    return layers.stressed(d.tx, d.tx_in, d.tx_out, _network(d), "missing_network_prevouts")[1].select("txid", "vin", "prev_txid", "prev_vout")


@query(_NET + "SELECT txid, CASE WHEN i % 20 = 0 THEN NULL WHEN i % 4 = 0 THEN (SELECT min(src_ip) FROM nw) ELSE src_ip END AS src_ip, CASE WHEN i % 4 = 0 THEN (SELECT min(asn) FROM nw) ELSE asn END AS asn, country, us // 60000000 * 60000000 AS us FROM nw JOIN plc USING (txid) JOIN tx USING (txid)")
def stress_skew(d: Domain):
    tx, _, network = layers.stressed(d.tx, d.tx_in, d.tx_out, _network(d), "timing_endpoint_skew")
    return network.join(tx.select("txid", "us"), "txid").select("txid", "src_ip", "asn", "country", "us")


@query("SELECT txid, CASE WHEN row_number() OVER (ORDER BY us, txid) % 5 <> 0 THEN fee END AS fee FROM tx")
def stress_nulls(d: Domain):
    return layers.perturb(d.tx, "fee", 5, ["us", "txid"]).select("txid", "fee")


@query("SELECT sha256(concat(txid, ':', c)) AS txid, us + c * 3600000000 AS us, c AS copy FROM tx, (VALUES (0), (1), (2)) v(c)")
def scaled_copies(d: Domain):
    return layers.copies(d.tx, "txid", "us", 3, 3_600_000_000).select("txid", "us", "copy")


@query(_RESOLVED + """SELECT prev_addr AS addr, sum(prev_amount)::BIGINT AS amount, count(*) AS utxo_count, count(*) AS spent_count, 'in' AS side FROM r WHERE txid = 42 GROUP BY prev_addr
    UNION ALL SELECT addr, sum(amount)::BIGINT, count(*), count(*) FILTER (EXISTS (SELECT 1 FROM tx_in i WHERE i.prev_txid = 42 AND i.prev_vout = o.vout)), 'out' FROM tx_out o WHERE txid = 42 GROUP BY addr""".replace("count(*) FILTER (EXISTS (SELECT 1 FROM tx_in i WHERE i.prev_txid = 42 AND i.prev_vout = o.vout))", "count(sp)").replace("FROM tx_out o WHERE txid = 42", "FROM (SELECT o.*, s.v AS sp FROM tx_out o LEFT JOIN (SELECT DISTINCT prev_vout AS v FROM tx_in WHERE prev_txid = 42) s ON s.v = o.vout WHERE txid = 42)"))
def tx_flow(d: Domain):
    return layers.tx_flow(d.tx_in, d.tx_out, 42)


@query(", sg AS (SELECT addr, script_type AS family, amount::DOUBLE AS score, txid AS ord FROM tx_out) SELECT addr, family, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY addr, family ORDER BY score DESC, ord DESC) AS rn FROM sg) WHERE rn = 1")
def signal_merge(d: Domain):
    return layers.family_strongest(d.tx_out.select("addr", F.col("script_type").alias("family"), F.col("amount").cast("double").alias("score"), F.col("txid").alias("ord")))


@query(", ref AS (SELECT event_id AS ref, user_id AS source, event_id % 7 AS n, event_id % 3 AS hash FROM events), rc AS (SELECT user_id AS source, min(event_id) % 3 AS s, min(event_id) % 3 + 3 AS e, min(event_id) % 2 AS rh FROM events WHERE user_id % 4 > 0 GROUP BY user_id) SELECT ref, CASE WHEN s IS NULL THEN 'unknown_source' WHEN n BETWEEN s AND e AND hash = rh THEN 'receipt_approved' WHEN n BETWEEN s AND e THEN 'stale_source_hash' ELSE 'outside_receipts' END AS status FROM ref LEFT JOIN rc USING (source)")
def structured_evidence(d: Domain):
    e = d.star("events")
    refs = e.select(F.col("event_id").alias("ref"), F.col("user_id").alias("source"), (F.col("event_id") % 7).alias("n"), (F.col("event_id") % 3).alias("hash"))
    m = F.min("event_id")
    receipts = e.where("user_id % 4 > 0").groupBy(F.col("user_id").alias("source")).agg((m % 3).alias("start"), (m % 3 + 3).alias("end"), (m % 2).alias("received_hash"))
    return layers.evidence_check(refs, receipts)


@query(_FEATURES + ", q AS (" + _rule("concentrated_collection", 2, 25, 15, 86400) + ") SELECT q.addr, q.seconds, q.start_us, rule, count(DISTINCT m.txid) AS participation FROM q JOIN m ON m.addr = q.addr AND m.seconds = q.seconds AND m.start_us = q.start_us GROUP BY ALL")
def participation(d: Domain):
    members = windows.memberships(d.tx_out)
    return layers.window_findings(windows.count_rule(windows.window_features(members), "concentrated_collection", 2, 25, 15, 86400), members.select("addr", "seconds", "start_us", "txid"))


@query(_REF + "SELECT txid, (us - min(us) OVER (PARTITION BY is_ref)) // 1000000 AS age, CASE WHEN is_ref THEN 'train' ELSE 'test' END AS split FROM rf")
def time_split(d: Domain):
    from pyspark.sql import Window

    rows = d.tx.select("txid", "us").join(stats.reference_set(d.tx), "txid")
    return rows.select("txid", F.floor((F.col("us") - F.min("us").over(Window.partitionBy("is_ref"))) / 1_000_000).alias("age"), F.when(F.col("is_ref"), "train").otherwise("test").alias("split"))
