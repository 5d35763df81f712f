"""Network findings on entity wallets, by the tests' own flags.

Observations of some entities' spends are laid onto one system and relay each, so that there is something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, network
from ..operators.spends import resolve_inputs
from ..session import keep
from .domain import Domain
from .graphs import _CC
from .measures import _BUYER, _RELAY
from .registry import query

_SEEN = _CC + """, w AS (SELECT a.addr, coalesce(entity_id, a.addr) AS wallet FROM (SELECT DISTINCT addr FROM tx_out) a LEFT JOIN cl USING (addr)), ws AS (SELECT DISTINCT wallet, txid FROM r JOIN w ON w.addr = r.prev_addr), mw AS (SELECT txid, min(wallet) AS m FROM ws GROUP BY txid),
    ob2 AS (SELECT obs.* REPLACE (CASE WHEN m LIKE 'E-0%' THEN concat('AS9', substr(m, 4, 1)) ELSE asn END AS asn, CASE WHEN m LIKE 'E-0%' THEN concat('10.9.9.', ascii(substr(m, 4, 1))) ELSE src_ip END AS src_ip) FROM obs LEFT JOIN mw USING (txid)), wp AS (SELECT DISTINCT wallet, asn AS key, txid FROM ws JOIN ob2 USING (txid) WHERE asn IS NOT NULL)"""
_TESTS = _BUYER[_BUYER.index(", ob AS") :].replace("FROM obs", "FROM ob2")
_RELAYS = _RELAY.replace("te AS (", "tr AS (").replace("FROM te)", "FROM tr)").replace("p FROM te", "p FROM tr").replace("FROM obs", "FROM ob2")


def _observed(d: Domain):
    ins = d.tx_in.join(d.obs.select("txid").distinct(), "txid", "left_semi")
    spends = graph.with_wallet(resolve_inputs(ins, d.tx_out).where("prev_addr is not null").select(F.col("prev_addr").alias("addr"), "txid"), d.entities)
    first = spends.groupBy("txid").agg(F.min("wallet").alias("m"))
    mine = F.coalesce(F.col("m").like("E-0%"), F.lit(False))
    letter = F.substring("m", 4, 1)
    rows = d.obs.join(first, "txid", "left").withColumns({"asn": F.when(mine, F.concat(F.lit("AS9"), letter)).otherwise(F.col("asn")), "src_ip": F.when(mine, F.concat(F.lit("10.9.9."), F.ascii(letter).cast("string"))).otherwise(F.col("src_ip"))})
    return d.derived("entity-observations", lambda: rows.drop("m"))


@query(_SEEN + _TESTS + "SELECT wallet, key, n, total, (SELECT count(*) FROM te) AS tested, round(least(1.0, p * (SELECT count(*) FROM te)), 9) AS adjusted, n / total >= 0.6 AND least(1.0, p * (SELECT count(*) FROM te)) < 1e-3 AS flagged FROM pv")
def entity_correlation(d: Domain):
    return network.network_correlation(d.tx_in, d.tx_out, _observed(d), "asn", wallets=d.entities).withColumn("adjusted", F.round("adjusted", 9))


@query(_SEEN + _TESTS + _RELAYS + """, ff AS (SELECT concat('wallet:', wallet) AS entity_ref, 'relay_concentration' AS rule, wallet AS a, key AS b, round(least(1.0, p * (SELECT count(*) FROM te)), 9) AS adjusted FROM pv WHERE n / total >= 0.6 AND least(1.0, p * (SELECT count(*) FROM te)) < 1e-3
    UNION ALL SELECT concat('endpoint:', ip), 'relay_flow_coherence', ip, NULL, round(least(1.0, p * tested), 9) FROM rp WHERE coherent >= 3 AND coherent / children >= 0.5 AND least(1.0, p * tested) < 1e-3), sc AS (SELECT *, least(50.0, -log10(greatest(adjusted, 1e-50))) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY adjusted, entity_ref) AS k FROM ff) WHERE k <= 500),
    ev AS (SELECT a, b, txid, us, row_number() OVER (PARTITION BY a, b ORDER BY us NULLS LAST, txid) AS i FROM (SELECT wallet AS a, key AS b, txid FROM wp UNION SELECT src_ip, NULL, txid FROM ob2) LEFT JOIN tx USING (txid)),
    el AS (SELECT a, b, string_agg(txid, ',' ORDER BY i) AS transactions FROM ev WHERE i <= CASE WHEN b IS NULL THEN 200 ELSE 25 END GROUP BY a, b)
    SELECT entity_ref, rule, adjusted, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, entity_ref, rule)::INT AS rank, transactions FROM sc LEFT JOIN el ON el.a = sc.a AND el.b IS NOT DISTINCT FROM sc.b""")
def network_findings(d: Domain):
    obs = _observed(d)
    seen = keep(network.wallet_observations(d.tx_in, d.tx_out, obs, "asn", d.entities), "seen")
    wallets = network.network_correlation(d.tx_in, d.tx_out, obs, "asn", pairs=seen).withColumn("adjusted", F.round("adjusted", 9))
    relays = network.relay_flags(network.relay_coherence(d.tx_in, d.tx_out, obs)).withColumn("adjusted", F.round("adjusted", 9))
    return network.network_findings(wallets, relays, seen, obs, d.tx).withColumn("score", F.round(F.col("score") + 0.0, 6))
