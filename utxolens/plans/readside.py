"""Queries of the read side: entities, endpoints, pages, states and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, network, readside
from .core import _RESOLVED
from .domain import Domain
from .flows import _RISK, _scores
from .graphs import _CC
from .measures import _SCORED
from .registry import query
from .review import _FND, _found

_SIZES = _CC + ", mb AS (SELECT entity_id, count(*) AS address_count FROM cl GROUP BY entity_id)"


def _clusters(d: Domain):
    return d.clusters


def _sizes(d: Domain):
    return _clusters(d).groupBy("entity_id").agg(F.count("*").alias("address_count"))


@query(_SIZES + "SELECT entity_id, address_count, (SELECT count(*) FROM mb WHERE address_count >= 3) AS total FROM mb WHERE address_count >= 3 ORDER BY address_count DESC, entity_id LIMIT 40 OFFSET 10")
def entity_list(d: Domain):
    return readside.entity_list(_sizes(d), 3, 40, 10)


_DETAIL = _SIZES + """, pk AS (SELECT entity_id FROM mb ORDER BY address_count DESC, entity_id LIMIT 1), oa AS (SELECT addr FROM cl WHERE entity_id = (SELECT entity_id FROM pk)),
    ln AS (SELECT DISTINCT st.txid FROM st LEFT JOIN eq USING (txid) JOIN r ON r.txid = st.txid WHERE n_addr >= 2 AND NOT (n_in >= 3 AND coalesce(max_equal, 0) >= 3) AND coalesce(nullif(r.address, ''), r.prev_addr) IN (SELECT addr FROM oa))"""


@query(_DETAIL + "(SELECT 'address' AS part, addr AS item, NULL::BIGINT AS us, (SELECT count(*) FROM oa) AS total FROM oa ORDER BY addr LIMIT 200) UNION ALL (SELECT 'link', txid::VARCHAR, us, (SELECT count(*) FROM ln) FROM ln LEFT JOIN tx USING (txid) ORDER BY us NULLS LAST, txid LIMIT 100)")
def entity_detail(d: Domain):
    clusters = _clusters(d)
    largest = clusters.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").first()
    return readside.entity_detail(clusters, d.tx_in, d.tx_out, d.tx, largest.entity_id if largest else "")


_POINTS = _CC + ", w AS (SELECT a.addr, coalesce(entity_id, a.addr) AS wallet FROM (SELECT DISTINCT addr FROM tx_out) a LEFT JOIN cl USING (addr)), we AS (SELECT wallet, ip, count(*) AS spends FROM (SELECT DISTINCT wallet, txid FROM r JOIN w ON w.addr = r.prev_addr) s JOIN (SELECT DISTINCT txid, src_ip AS ip FROM obs) o USING (txid) GROUP BY wallet, ip)"


def _points(d: Domain, ip: str | None = None):
    obs = d.obs if ip is None else d.obs.where(F.col("src_ip") == ip)
    return readside.wallet_endpoints(d.tx_in, d.tx_out, obs, d.entities)


@query(_POINTS + "SELECT * FROM we")
def wallet_endpoints(d: Domain):
    return _points(d)


@query(_POINTS + "SELECT * FROM we WHERE ip = '10.1.1.1' ORDER BY spends DESC, wallet LIMIT 50")
def endpoint_view(d: Domain):
    return readside.endpoint_view(_points(d, "10.1.1.1"), "10.1.1.1")


@query("SELECT src_ip, count(*) AS observations, count(DISTINCT txid) AS transactions FROM obs GROUP BY src_ip ORDER BY transactions DESC, src_ip LIMIT 25")
def top_endpoints(d: Domain):
    return readside.top_endpoints(network.endpoint_rollup(d.obs, d.tx).select("src_ip", "observations", "transactions"))


@query(_RISK + ", mb AS (SELECT entity_id AS wallet, count(*) AS address_count FROM cl GROUP BY entity_id) SELECT addr, wallet, coalesce(address_count, 1) AS address_count, risk FROM w LEFT JOIN mb USING (wallet) LEFT JOIN rs USING (wallet)")
def annotate_wallets(d: Domain):
    return readside.annotate_wallets(d.tx_out, _clusters(d), _sizes(d), _scores(d))


@query(_FND + ", nd AS (SELECT DISTINCT c_custkey AS node FROM customer) SELECT node, coalesce(n, 0) AS open FROM nd LEFT JOIN (SELECT entity AS node, count(*) AS n FROM fd WHERE status <> 'dismissed' GROUP BY entity) USING (node)")
def open_counts(d: Domain):
    return readside.open_counts(d.star("customer").select(F.col("c_custkey").alias("node")).distinct(), _found(d).withColumnRenamed("entity", "node"))


@query(_FND + "SELECT id, rule, status, score, entity AS node FROM fd WHERE entity IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY score DESC, id LIMIT 100")
def findings_for_refs(d: Domain):
    return readside.findings_for(_found(d).withColumnRenamed("entity", "node"), d.star("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("node")))


@query(_SIZES + "SELECT entity_id, address_count, address_count >= greatest(20, 0.1 * (SELECT sum(address_count) FROM mb)) AS caution FROM mb")
def cluster_caution(d: Domain):
    return readside.cluster_caution(_sizes(d), 20)


_RUNS = ", jb AS (SELECT o_custkey AS job, concat('s', o_orderkey % 4) AS stage, o_orderkey AS id, us, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'running' ELSE 'success' END AS status FROM orders JOIN tx ON txid = o_orderkey), la AS (SELECT job, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY job, stage ORDER BY us DESC, id DESC) AS rn FROM jb) WHERE rn = 1)"


def _runs(d: Domain):
    o = d.star("orders").join(d.tx.select(F.col("txid").alias("o_orderkey"), "us"), "o_orderkey")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("job"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("stage"), k.alias("id"), "us", F.when(k % 11 == 0, "failed").when(k % 13 == 0, "running").otherwise("success").alias("status"))


@query(_RUNS + "SELECT * FROM la")
def latest_of(d: Domain):
    return readside.latest_of(_runs(d), ["job", "stage"], ["us", "id"], ["status"])


@query(_RUNS + """, ct AS (SELECT job, count(*) FILTER (stage IN ('s0', 's1') AND status = 'success') AS done, count(*) FILTER (stage IN ('s0', 's1') AND status = 'failed') AS lost, count(*) FILTER (status = 'running') AS runs, count(*) FILTER (stage NOT IN ('s0', 's1') AND status = 'failed') AS other FROM la GROUP BY job)
    SELECT job, CASE WHEN lost > 0 THEN 'failed' WHEN done = 2 AND other > 0 THEN 'degraded' WHEN done = 2 THEN 'complete' WHEN runs > 0 THEN 'running' ELSE 'unknown' END AS state FROM ct""")
def analysis_state(d: Domain):
    return readside.analysis_state(_runs(d), ["s0", "s1"])


@query("SELECT txid, round(CASE txid % 3 WHEN 0 THEN (0.0 + 0.2 * least(1, coalesce(fee / nullif(1000, 0), 0))) * 100 WHEN 1 THEN (0.2 + 0.5 * least(1, fee / 500)) * 100 END, 6) AS percent FROM tx")
def job_progress(d: Domain):
    rows = d.tx.select("txid", F.concat(F.lit("s"), (F.col("txid") % 3).cast("string")).alias("stage"), F.col("fee").alias("seen"), F.when(F.col("txid") % 3 == 0, 1000).otherwise(500).alias("total"))
    return rows.select("txid", F.round(readside.progress(rows, {"s0": (0.0, 0.2), "s1": (0.2, 0.7)}), 6).alias("percent"))


@query("SELECT txid, array_to_string(list_transform(list_slice(list_sort([struct_pack(v := -fee::DOUBLE, c := 'fee'), struct_pack(v := -(txid % 997)::DOUBLE, c := 'residue'), struct_pack(v := -(us // 3600000000 % 24 * 40)::DOUBLE, c := 'time')]), 1, 2), lambda x: x.c), ',') AS top FROM tx")
def top_contributions(d: Domain):
    rows = d.tx.select("txid", "fee", (F.col("txid") % 997).alias("residue"), (F.floor(F.col("us") / 3600000000) % 24 * 40).alias("time"))
    return readside.top_contributions(rows, "txid", ["fee", "residue", "time"], 2)


@query(_FND + """, wf AS (SELECT id, rule, status, score, CASE status WHEN 'escalated' THEN 0 WHEN 'dismissed' THEN 2 ELSE 1 END AS band, row_number() OVER (PARTITION BY rule ORDER BY score DESC, id)::INT AS family_rank FROM (SELECT id, rule, CASE WHEN id % 5 = 0 THEN 'dismissed' ELSE status END AS status, score FROM fd))
    SELECT id, rule, status, score, band, family_rank, (SELECT count(*) FROM wf) AS total, (SELECT count(*) FROM wf WHERE status <> 'dismissed') AS open_total FROM wf ORDER BY band, family_rank, rule, id LIMIT 60 OFFSET 40""")
def workflow_page(d: Domain):
    found = _found(d).withColumn("status", F.when(F.col("id") % 5 == 0, "dismissed").otherwise(F.col("status"))).drop("entity")
    return readside.page_with_totals(found, 40, 60)


@query(_SCORED + "SELECT txid, fee / 1000 AS score FROM tx ORDER BY fee DESC, txid LIMIT (SELECT greatest(1, ceil(count(*) * 0.015::DOUBLE))::BIGINT FROM tx)")
def candidate_retention(d: Domain):
    return readside.keep_budget(d.tx.select("txid", (F.col("fee") / 1000).alias("score")), "txid", 0.015)


_PATHS = ", pth AS (SELECT txid AS id, txid % 50 AS case_id, [part % 40, part % 7, vout] AS nodes FROM tx_out WHERE vout = 0), abt AS (SELECT txid AS id, txid % 50 AS case_id, txid % 40 AS node, fee >= 300 AS open FROM tx)"


@query(_PATHS + ", ex AS (SELECT DISTINCT id, case_id, unnest(nodes) AS node FROM pth), ht AS (SELECT ex.id, count(DISTINCT ex.node) AS hits FROM ex JOIN abt ON abt.case_id = ex.case_id AND abt.node = ex.node AND abt.id <> ex.id AND abt.open GROUP BY ex.id) SELECT id, coalesce(hits, 0) / count(*) AS share FROM ex LEFT JOIN ht USING (id) GROUP BY id, hits")
def path_signals(d: Domain):
    paths = d.tx_out.where("vout = 0").select(F.col("txid").alias("id"), (F.col("txid") % 50).alias("case"), F.array((F.col("part") % 40).cast("long"), (F.col("part") % 7).cast("long"), F.col("vout").cast("long")).alias("nodes"))
    found = d.tx.select(F.col("txid").alias("id"), (F.col("txid") % 50).alias("case"), (F.col("txid") % 40).alias("entity_ref"), F.when(F.col("fee") >= 300, "open").otherwise("dismissed").alias("status"))
    return readside.path_signals(paths, found)


@query("SELECT addr AS node, min(txid * 100 + vout) AS first_at, max_by(amount, txid * 100 + vout) AS value FROM tx_out GROUP BY addr ORDER BY first_at, node LIMIT 500")
def page_merge(d: Domain):
    return readside.page_merge(d.tx_out.select(F.col("addr").alias("node"), (F.col("txid") * 100 + F.col("vout")).alias("at"), F.col("amount").alias("value")))


@query(", sp AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 10 < 7 THEN 'fit' WHEN o_orderkey % 10 = 7 THEN 'check' ELSE 'test' END AS split FROM orders) SELECT a.split, b.split AS other, count(*) AS shared FROM sp a JOIN sp b USING (o_custkey) WHERE a.split < b.split GROUP BY a.split, b.split")
def split_overlap(d: Domain):
    k = F.col("o_orderkey") % 10
    return readside.split_overlap(d.star("orders").select("o_custkey", F.when(k < 7, "fit").when(k == 7, "check").otherwise("test").alias("split")), "o_custkey", "split")


@query(_RESOLVED + "SELECT txid, CASE WHEN count(*) = count(prev_amount) THEN sum(prev_amount)::BIGINT END AS total FROM r GROUP BY txid")
def poisoned_total(d: Domain):
    from ..operators.spends import resolve_inputs

    return readside.poisoned_total(resolve_inputs(d.tx_in, d.tx_out), "txid", "prev_amount")


@query(_RESOLVED + ", fl AS (SELECT o.addr AS party, CASE WHEN min(txid) % 5 > 0 THEN sum(amount)::BIGINT END AS amount FROM tx_out o GROUP BY o.addr) SELECT party, amount, greatest(0, (SELECT count(*) FROM fl) - 20) AS truncated FROM fl ORDER BY amount DESC NULLS LAST, party LIMIT 20")
def counterparties(d: Domain):
    flows = d.tx_out.groupBy(F.col("addr").alias("party")).agg(F.when(F.min("txid") % 5 > 0, F.sum("amount")).alias("amount"))
    return readside.counterparties(flows)


@query(", gm AS (SELECT o_custkey % 300 AS g, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 150 + (o_orderkey % 97 = 0)::INT END AS label FROM orders), gg AS (SELECT g, count(DISTINCT label) AS labels, count(*) FILTER (label IS NULL) AS u FROM gm GROUP BY g) SELECT count(*) FILTER (labels = 1 AND u = 0) AS pure, count(*) FILTER (labels > 1) AS mixed, count(*) FILTER (labels = 0) AS unknown, count(*) AS groups, (SELECT count(*) FROM (SELECT label FROM gm WHERE label IS NOT NULL GROUP BY label HAVING count(DISTINCT g) > 1)) AS split_labels FROM gg")
def group_quality(d: Domain):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return readside.group_quality(d.star("orders").select((c % 300).alias("group"), F.when(k % 9 > 0, c % 150 + (k % 97 == 0).cast("int")).alias("label")))
