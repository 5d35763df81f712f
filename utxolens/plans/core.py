"""Queries on spends, windows and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spends, windows
from .domain import Domain
from .registry import query

_RESOLVED = ", r AS (SELECT i.*, o.amount AS prev_amount, o.addr AS prev_addr, o.address AS prev_address, o.us AS prev_us FROM tx_in i LEFT JOIN tx_out o ON i.prev_txid = o.txid AND i.prev_vout = o.vout)"
_FIRST = ", s AS (SELECT i.txid, i.vin, i.prev_txid, i.prev_vout, CASE WHEN i.txid = first_value(i.txid) OVER (PARTITION BY i.prev_txid, i.prev_vout ORDER BY t.seq, i.vin) THEN 'resolved' ELSE 'double_spend_conflict' END AS status FROM tx_in i JOIN tx t USING (txid) WHERE EXISTS (SELECT 1 FROM tx_out o WHERE o.txid = i.prev_txid AND o.vout = i.prev_vout))"
_STATS = _RESOLVED + ", st AS (SELECT txid, count(*) AS n_in, count(DISTINCT coalesce(nullif(address, ''), prev_addr)) AS n_addr FROM r GROUP BY txid), eq AS (SELECT txid, max(c) AS max_equal FROM (SELECT txid, coalesce(amount, 0) a, count(*) c FROM tx_out GROUP BY ALL) GROUP BY txid)"


@query(_RESOLVED + "SELECT txid, vin, prev_txid, prev_vout, prev_amount, prev_addr FROM r")
def prevout_resolve(d: Domain):
    return spends.resolve_inputs(d.tx_in, d.tx_out).select("txid", "vin", "prev_txid", "prev_vout", "prev_amount", "prev_addr")


@query("SELECT txid, vin FROM tx_in i WHERE EXISTS (SELECT 1 FROM tx_out o WHERE o.txid = i.prev_txid AND o.vout = i.prev_vout)")
def matched_inputs(d: Domain):
    return spends.matched_inputs(d.tx_in, d.tx_out).select("txid", "vin")


@query("SELECT txid, vin FROM tx_in i WHERE NOT EXISTS (SELECT 1 FROM tx_out o WHERE o.txid = i.prev_txid AND o.vout = i.prev_vout)")
def unresolved_inputs(d: Domain):
    return spends.unresolved_inputs(d.tx_in, d.tx_out).select("txid", "vin")


@query(_FIRST + "SELECT * FROM s")
def spend_resolution(d: Domain):
    return spends.spend_resolution(d.tx_in, d.tx_out, d.tx)


@query("SELECT prev_txid, prev_vout, min(txid) AS spend_txid FROM tx_in GROUP BY ALL HAVING count(DISTINCT txid) = 1".replace("GROUP BY ALL", "GROUP BY prev_txid, prev_vout"))
def unique_spend(d: Domain):
    return spends.unique_spends(d.tx_in)


@query(_STATS + "SELECT txid, n_in, n_addr FROM st")
def input_stats(d: Domain):
    return spends.input_stats(d.tx_in, d.tx_out)


@query(_STATS + "SELECT * FROM eq")
def max_equal_outputs(d: Domain):
    return spends.equal_outputs(d.tx_out)


@query(_STATS + "SELECT txid, n_in, n_addr, coalesce(max_equal, 0) AS max_equal, n_in >= 3 AND coalesce(max_equal, 0) >= 3 AS mixing FROM st LEFT JOIN eq USING (txid) WHERE n_addr >= 2")
def common_input_links(d: Domain):
    return spends.linking_transactions(d.tx_in, d.tx_out)


@query(_FIRST + """SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM tx_out) AS outputs, (SELECT count(DISTINCT addr) FROM tx_out) AS addresses,
    (SELECT count(*) FROM tx_in) AS inputs, (SELECT count(*) FROM tx_in i WHERE NOT EXISTS (SELECT 1 FROM tx_out o WHERE o.txid = i.prev_txid AND o.vout = i.prev_vout)) AS missing_prevouts,
    (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM s WHERE status = 'resolved') AS resolved_spends, (SELECT count(*) FROM s WHERE status <> 'resolved') AS double_spend_conflicts,
    (SELECT count(*) FROM tx_in i WHERE NOT EXISTS (SELECT 1 FROM tx_out o WHERE o.txid = i.prev_txid AND o.vout = i.prev_vout)) + (SELECT count(*) FROM s WHERE status <> 'resolved') = 0 AS spend_lineage_complete""")
def coverage(d: Domain):
    return spends.coverage(d.tx, d.tx_in, d.tx_out, d.obs)


@query(_RESOLVED + """, i AS (SELECT txid, bool_and(prev_amount IS NOT NULL) AS complete, sum(prev_amount)::BIGINT AS amount_in FROM r GROUP BY txid), o AS (SELECT txid, sum(amount)::BIGINT AS amount_out FROM tx_out GROUP BY txid)
    SELECT i.txid, complete, amount_in, amount_out, coalesce(complete AND amount_in < amount_out, false) AS violation FROM i LEFT JOIN o USING (txid)""")
def value_conservation(d: Domain):
    return spends.value_conservation(d.tx_in, d.tx_out)


_RAPID = _RESOLVED + ", rapid AS (SELECT prev_address AS address, prev_txid, prev_vout, r.txid, vin, prev_us AS received_us, t.us AS spent_us, t.us - prev_us AS delay_us FROM r JOIN tx t USING (txid) WHERE prev_address IS NOT NULL AND t.us - prev_us BETWEEN 0 AND 3600000000)"


@query(_RAPID + "SELECT * FROM rapid")
def rapid_spends(d: Domain):
    return spends.rapid_spends(d.tx_in, d.tx_out, d.tx)


_MEMBERS = ", m AS (SELECT addr, txid, vout, amount, us, seconds, us - us % (seconds::BIGINT * 1000000) AS start_us FROM tx_out, (VALUES (900), (3600), (86400)) v(seconds))"
_FEATURES = _MEMBERS + ", f AS (SELECT addr, seconds, start_us, count(*) AS outputs, count(DISTINCT txid) AS transactions, min(amount) AS min_value, max(amount) AS max_value, sum(amount)::BIGINT AS total_value, median(amount) AS median_value FROM m GROUP BY addr, seconds, start_us)"


@query(_MEMBERS + "SELECT * FROM m")
def window_memberships(d: Domain):
    return windows.memberships(d.tx_out)


@query(_FEATURES + "SELECT * FROM f")
def window_features(d: Domain):
    return windows.window_features(windows.memberships(d.tx_out))


@query(_MEMBERS + """, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY addr, seconds, start_us ORDER BY us)) / 1e6 AS gap FROM (SELECT DISTINCT addr, seconds, start_us, us FROM m))
    SELECT addr, seconds, start_us, count(*) AS gaps, min(gap) AS min_gap, max(gap) AS max_gap, median(gap) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY addr, seconds, start_us""")
def gap_features(d: Domain):
    return windows.gap_features(windows.memberships(d.tx_out))


@query(_FEATURES + """, h AS (SELECT *, row_number() OVER o - 1 AS n, (start_us - lag(start_us) OVER o) / 1e6 AS gap_seconds, sum(transactions) OVER p AS sc, sum(total_value) OVER p AS sv FROM f
        WINDOW o AS (PARTITION BY addr, seconds ORDER BY start_us), p AS (PARTITION BY addr, seconds ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT addr, seconds, start_us, transactions, total_value, n::INT AS prior_windows, gap_seconds, sc / nullif(n, 0) AS baseline_count, sv / nullif(n, 0) AS baseline_value,
        transactions / nullif(sc / nullif(n, 0), 0) AS surge_count, total_value / nullif(sv / nullif(n, 0), 0) AS surge_value FROM h""")
def address_history(d: Domain):
    return windows.address_history(windows.window_features(windows.memberships(d.tx_out)))


def _rule(rule, least, base, each, seconds):
    return f"SELECT addr, seconds, start_us, '{rule}' AS rule, least(100, {base} + {each} * transactions)::DOUBLE AS score, transactions FROM f WHERE seconds = {seconds} AND transactions >= {least}"


@query(_FEATURES + _rule("concentrated_collection", 3, 25, 15, 86400))
def concentrated_collection(d: Domain):
    return windows.count_rule(windows.window_features(windows.memberships(d.tx_out)), "concentrated_collection", 3, 25, 15, 86400)


# Hubs are looked for among parts, which recur more often than addresses.
@query(_FEATURES.replace("SELECT addr, txid, vout", "SELECT concat('p', part) AS addr, txid, vout") + _rule("emerging_hub", 4, 20, 10, 86400))
def emerging_hub(d: Domain):
    parts = d.tx_out.withColumn("addr", F.concat(F.lit("p"), F.col("part").cast("string")))
    return windows.count_rule(windows.window_features(windows.memberships(parts)), "emerging_hub", 4, 20, 10, 86400)


@query(_FEATURES + _RAPID + """, e AS (SELECT address AS addr, spent_us - spent_us % 86400000000 AS start_us, count(*) AS events, min(delay_us) / 1e6 AS shortest_delay, median(delay_us) / 1e6 AS median_delay FROM rapid GROUP BY ALL)
    SELECT f.addr, f.seconds, f.start_us, transactions, events, shortest_delay, median_delay, least(100, 45 + 10 * events)::DOUBLE AS score FROM f JOIN e ON f.addr = e.addr AND f.start_us = e.start_us WHERE seconds = 86400 AND transactions >= 3""")
def rapid_redistribution(d: Domain):
    return windows.rapid_redistribution(windows.window_features(windows.memberships(d.tx_out)), spends.rapid_spends(d.tx_in, d.tx_out, d.tx), 3, 86400)


# The rules at their own thresholds, over parts as addresses, which recur.
_PARTS = _FEATURES.replace("SELECT addr, txid, vout", "SELECT concat('p', part) AS addr, txid, vout")
_FOUND = _PARTS + ", found AS (" + " UNION ALL ".join(_rule(*r, s) for s in windows.SPANS for r in (("concentrated_collection", 3, 25, 15), ("emerging_hub", 4, 20, 10))) + ")"


def _found_windows(d: Domain):
    parts = d.tx_out.withColumn("addr", F.concat(F.lit("p"), F.col("part").cast("string")))
    return windows.findings(parts, d.tx_in, d.tx)


@query(_FOUND + """, c AS (SELECT *, start_us - start_us % 86400000000 AS day, row_number() OVER (PARTITION BY addr, rule, start_us - start_us % 86400000000 ORDER BY score DESC, transactions DESC, seconds, start_us) AS rn FROM found)
    SELECT addr, max(seconds) FILTER (rn = 1) AS seconds, max(start_us) FILTER (rn = 1) AS start_us, rule, max(score) FILTER (rn = 1) AS score, max(transactions) FILTER (rn = 1) AS transactions, count(*) - 1 AS matched_windows, coalesce(string_agg(concat(seconds, ':', start_us), ',' ORDER BY seconds, start_us) FILTER (rn > 1), '') AS matched FROM c GROUP BY addr, rule, day""")
def daily_collapse(d: Domain):
    return windows.daily_collapse(_found_windows(d))


@query(_FOUND + """, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY addr, rule ORDER BY score DESC, rule, addr, seconds, start_us) AS rn FROM found) WHERE rn = 1)
    SELECT addr, seconds, start_us, rule, score, transactions, row_number() OVER (ORDER BY score DESC, rule, addr, seconds, start_us)::INT AS rank FROM k""")
def dedupe_rank(d: Domain):
    ties = [F.col(c) for c in ("rule", "addr", "seconds", "start_us")]
    return windows.dedupe_and_rank(_found_windows(d), ["addr", "rule"], "score", ties)


@query("SELECT obs_id, ln(1 + count(*) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)) AS recent FROM obs")
def trailing_cooccurrence(d: Domain):
    return windows.trailing_count(d.obs, "src_ip", "us", 3600, "recent").select("obs_id", "recent")


@query("SELECT obs_id, (row_number() OVER (PARTITION BY src_ip ORDER BY us, obs_id) - 1)::INT AS prior FROM obs")
def prior_occurrence(d: Domain):
    return windows.prior_index(d.obs, "src_ip", ["us", "obs_id"], "prior").select("obs_id", F.col("prior").cast("int").alias("prior"))


@query("SELECT obs_id, -ln((row_number() OVER (PARTITION BY src_ip ORDER BY us, obs_id))::DOUBLE / (row_number() OVER (ORDER BY us, obs_id) - 1 + (SELECT count(DISTINCT src_ip) FROM obs))) AS rarity FROM obs")
def expanding_rarity(d: Domain):
    return windows.expanding_rarity(d.obs, "src_ip", ["us", "obs_id"]).select("obs_id", "rarity")


@query("""SELECT txid, count(*) AS recipients, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS prior_fraction, avg(n) AS mean_prior_count, coalesce(max(span), 0) AS max_span FROM (
    SELECT txid, count(*) OVER b AS n, (max(us) OVER b - min(us) OVER b) / 1e6 AS span FROM (SELECT txid, addr, min(us) AS us FROM tx_out GROUP BY txid, addr)
    WINDOW b AS (PARTITION BY addr ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY txid""")
def recipient_history(d: Domain):
    return windows.recipient_history(d.tx_out)


@query("""SELECT txid, addr, n AS prior_transactions, a // 1000000000 AS first_us, z // 1000000000 AS last_us, (a % 1000000000)::BIGINT AS first_txid, (z % 1000000000)::BIGINT AS last_txid FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY n DESC, addr) AS i FROM (
    SELECT txid, addr, count(*) OVER b AS n, min(us::HUGEINT * 1000000000 + txid) OVER b AS a, max(us::HUGEINT * 1000000000 + txid) OVER b AS z FROM (SELECT txid, concat('p', part) AS addr, min(us) AS us FROM tx_out GROUP BY ALL) WINDOW b AS (PARTITION BY addr ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE n >= 2 AND txid IN (SELECT txid FROM tx WHERE fee >= 900)) WHERE i <= 3""".replace("a // 1000000000 AS", "(a // 1000000000)::BIGINT AS").replace("z // 1000000000 AS", "(z // 1000000000)::BIGINT AS"))
def recurrent_recipients(d: Domain):
    parts = d.tx_out.withColumn("addr", F.concat(F.lit("p"), F.col("part").cast("string")))
    return windows.recurrent_recipients(parts, d.tx.where("fee >= 900"))
