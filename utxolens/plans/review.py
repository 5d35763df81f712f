"""Queries on intake, queues, pages, sets and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import groups, intake, ranking
from ..session import keep, prepare
from ..sources import files
from .domain import Domain
from .registry import query

_FND = ", fd AS (SELECT o_orderkey AS id, o_orderpriority AS rule, CASE o_orderstatus WHEN 'F' THEN 'escalated' WHEN 'O' THEN 'open' ELSE 'needs_data' END AS status, (o_custkey * 37 % 101)::DOUBLE AS score, o_custkey AS entity FROM orders)"


def _found(d: Domain):
    o = d.star("orders")
    status = F.when(F.col("o_orderstatus") == "F", "escalated").when(F.col("o_orderstatus") == "O", "open").otherwise("needs_data")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("rule"), status.alias("status"), (F.col("o_custkey") * 37 % 101).cast("double").alias("score"), F.col("o_custkey").alias("entity"))


@query(_FND + "SELECT * FROM fd ORDER BY score DESC, id LIMIT 50 OFFSET 100")
def findings_page(d: Domain):
    return ranking.page(_found(d), [F.desc("score"), F.col("id")], 100, 50)


@query(_FND + "SELECT id, rule, row_number() OVER (PARTITION BY rule ORDER BY score DESC, id)::INT AS family_rank, count(*) OVER (PARTITION BY rule) AS family_total FROM fd")
def family_rank(d: Domain):
    return ranking.family_rank(_found(d), ["rule"], [F.desc("score"), F.col("id")]).select("id", "rule", "family_rank", "family_total")


@query(_FND + """, b AS (SELECT *, CASE status WHEN 'escalated' THEN 0 WHEN 'needs_data' THEN 1 ELSE 2 END AS band FROM fd), f AS (SELECT *, row_number() OVER (PARTITION BY band, rule ORDER BY score DESC, id)::INT AS family_rank FROM b)
    SELECT id, band, family_rank, row_number() OVER (ORDER BY band, family_rank, rule, id)::INT AS position, row_number() OVER (ORDER BY band, family_rank, rule, id) <= 200 AS queued FROM f""")
def group_queue(d: Domain):
    return ranking.workflow_queue(_found(d), 200).select("id", "band", "family_rank", "position", "queued")


@query(_FND + "SELECT entity, max(score) AS score FROM fd GROUP BY entity ORDER BY score DESC, entity LIMIT 100")
def review_queue(d: Domain):
    return ranking.review_queue(_found(d), "entity", "score", 100)


@query(_FND + "SELECT id, score FROM fd WHERE score >= (SELECT quantile_cont(score, 0.99) FROM fd WHERE id % 10 < 7)")
def quantile_retention(d: Domain):
    return ranking.retain_by_budget(_found(d).withColumn("is_ref", F.col("id") % 10 < 7), "score", 0.99).select("id", "score")


@query(_FND + "SELECT status, count(*) AS n FROM fd GROUP BY status")
def status_histogram(d: Domain):
    return _found(d).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 9) AS similarity FROM embeddings, q WHERE vec_id <> 7 ORDER BY similarity DESC, vec_id LIMIT 20", plain=True)
def similar_wallets(d: Domain):
    return ranking.cosine_top_k(d.star("embeddings"), 7, 20)


@query("SELECT addr FROM tx_out UNION SELECT address FROM tx_in WHERE address IS NOT NULL")
def address_union(d: Domain):
    return d.tx_out.select("addr").union(d.tx_in.where("address is not null").select("address")).distinct()


@query("SELECT DISTINCT txid FROM obs WHERE txid NOT IN (SELECT txid FROM tx)")
def observed_unknown(d: Domain):
    return d.obs.select("txid").distinct().join(d.tx, "txid", "left_anti")


@query("SELECT src_ip AS ip FROM obs UNION SELECT dst_ip FROM obs")
def endpoint_union(d: Domain):
    return d.obs.select(F.col("src_ip").alias("ip")).union(d.obs.select("dst_ip")).distinct()


@query("SELECT addr AS address, count(DISTINCT txid) AS transactions, count(*) AS participations FROM tx_out WHERE addr IS NOT NULL GROUP BY addr")
def address_activity(d: Domain):
    return d.tx_out.where("addr is not null").groupBy(F.col("addr").alias("address")).agg(F.count_distinct("txid").alias("transactions"), F.count("*").alias("participations"))


@query("SELECT coalesce(country, '??') AS country, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, country LIMIT 20")
def country_summary(d: Domain):
    return d.obs.groupBy(F.coalesce("country", F.lit("??")).alias("country")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(20)


@query("SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('click'), ('error'), ('view'), ('none')) k(kind) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON event_type = kind", plain=True)
def receipt_counts(d: Domain):
    kinds = d.spark.createDataFrame([("click",), ("error",), ("view",), ("none",)], "kind string")
    return kinds.join(d.star("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS n, (sum(('0x' || substr(md5(concat_ws('|', obs_id, txid, src_ip)), 1, 12))::BIGINT) % 2305843009213693951)::BIGINT AS digest FROM obs")
def multiset_fingerprint(d: Domain):
    return ranking.multiset_fingerprint(d.obs.select("obs_id", "txid", "src_ip"))


@query("SELECT txid, us, coalesce(lag(us) OVER (ORDER BY us, txid) < us, true) AS later, min(us) OVER () AS first_us FROM tx")
def source_bounds(d: Domain):
    # Not later than its predecessor is who shares its time with one: no global order is needed.
    later = F.col("us").isNull() | (F.row_number().over(Window.partitionBy("us").orderBy("txid")) == 1)
    return d.tx.select("txid", "us", later.alias("later")).crossJoin(F.broadcast(d.tx.agg(F.min("us").alias("first_us"))))


# Raw records made from orders: sound ones, and one kind of fault for each remainder.
def _raw(d: Domain):
    k, o = F.col("o_orderkey"), d.star("orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    seconds = (us / 1_000_000).cast("long").cast("string")
    iso = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    ts = F.when(k % 13 == 1, iso).when(k % 5 == 0, F.concat(iso, F.lit("Z"))).when(k % 5 == 1, F.concat(F.regexp_replace(iso, "T", " "), F.lit(" UTC"))).otherwise(seconds)
    coins = F.round("o_totalprice").cast("long").cast("string")
    amounts = F.when(k % 17 == 2, "").when(k % 17 == 3, "0.1;x").when(k % 17 == 4, F.concat(F.lit("-"), coins, F.lit(";1"))).otherwise(F.concat(coins, F.lit(";0.5")))
    txid = F.when(k % 19 == 5, "zz").otherwise(F.sha2((k - F.when(k % 23 == 7, 23).otherwise(0)).cast("string").cast("binary"), 256))
    return o.select((k + 1).alias("logical_record"), ts.alias("timestamp"), txid.alias("txid"), F.lit("mainnet").alias("network"), F.lit(" ").alias("input_addresses"), F.when(k % 29 == 9, "a").otherwise(F.concat(F.lit("[\"a\", \"b"), (k % 9).cast("string"), F.lit("\"]"))).alias("output_addresses"), amounts.alias("output_amounts"), F.when(k % 3 == 0, "10.0.0.1").alias("src_ip"), F.when(k % 31 == 11, "70000").otherwise("8333").alias("src_port"))


_ERR = """, rw AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS us, round(o_totalprice)::BIGINT AS c FROM orders), er AS (SELECT *, CASE WHEN k % 19 = 5 THEN 'txid is not 64 hex digits' WHEN k % 13 = 1 THEN 'no time zone' WHEN k % 17 = 2 THEN 'no outputs'
    WHEN k % 29 = 9 THEN 'array lengths differ' WHEN k % 17 = 3 THEN 'not a number' WHEN k % 17 = 4 THEN 'negative amount' WHEN k % 31 = 11 THEN 'not a port' END AS error FROM rw)"""


@query(_ERR + "SELECT k + 1 AS logical_record, error AS reason FROM er WHERE error IS NOT NULL")
def quarantine_split(d: Domain):
    return intake.quarantined(intake.normalize(_raw(d)))


@query(_ERR + "SELECT coalesce(error, 'accepted') AS reason, count(*) AS n FROM er GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def intake_inspection(d: Domain):
    return intake.inspection(intake.normalize(_raw(d)))


@query(_ERR + ", ok AS (SELECT sha256((k - CASE WHEN k % 23 = 7 THEN 23 ELSE 0 END)::VARCHAR) AS txid, k, c, us FROM er WHERE error IS NULL) SELECT k + 1 AS logical_record, txid, us, v.vout, CASE v.vout WHEN 0 THEN 'a' ELSE 'b' || (k % 9) END AS address, CASE v.vout WHEN 0 THEN c * 100000000 ELSE 50000000 END AS amount_sats FROM ok, (VALUES (0), (1)) v(vout)")
def normalize_row(d: Domain):
    rows = intake.accepted(intake.normalize(_raw(d)))
    outs = rows.select("logical_record", "txid", F.col("t.us").alias("us"), F.posexplode(F.arrays_zip(F.col("out_addr").alias("a"), F.col("sats").alias("s"))).alias("vout", "z"))
    return outs.select("logical_record", "txid", "us", "vout", F.col("z.a").alias("address"), F.col("z.s.value").alias("amount_sats"))


@query(_ERR + """, ok AS (SELECT k + 1 AS logical_record, sha256((k - CASE WHEN k % 23 = 7 THEN 23 ELSE 0 END)::VARCHAR) AS txid, c FROM er WHERE error IS NULL), f AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY logical_record) AS rn, first_value(c) OVER (PARTITION BY txid ORDER BY logical_record) AS fc FROM ok)
    SELECT logical_record, txid, CASE WHEN rn = 1 THEN 'accepted' WHEN c = fc THEN 'duplicate' ELSE 'conflicting variant' END AS verdict FROM f""")
def dedupe_txid(d: Domain):
    rows = intake.accepted(intake.normalize(_raw(d)))
    return intake.dedupe_txid(rows, F.md5(F.to_json("sats").cast("binary"))).select("logical_record", "txid", "verdict")


_FILE_SQL = "SELECT row_number() OVER (ORDER BY n_nationkey) AS logical_record, n_nationkey::VARCHAR AS k, n_name AS name FROM nation"


def _scanned(d: Domain, kind: str):
    spark, df = prepare(d.spark), d.star("nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")).orderBy(F.col("k").cast("int")).coalesce(1)
    path = keep(df, "nation").inputFiles()[0].rsplit("/", 1)[0] + f"-{kind}"
    if kind == "csv":
        df.write.csv(path, header=True)
    elif kind == "xml":
        df.write.format("xml").option("rowTag", "record").save(path)
    else:
        lines = df.select(F.to_json(F.struct("*")).alias("value"))
        (lines if kind == "ndjson" else lines.agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("value")), F.lit("]")).alias("value"))).write.text(path)
    out = files.scan(spark, path, kind, "k string, name string")
    return out.select("logical_record", F.col("value")["k"].alias("k"), F.col("value")["name"].alias("name"))


@query(_FILE_SQL, plain=True)
def scan_csv(d: Domain):
    return _scanned(d, "csv")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS logical_record, doc_id, length(text) AS characters, md5(text) AS digest FROM documents WHERE text <> ''", plain=True)
def scan_csv_line_breaks(d: Domain):
    """Whole texts, with their quotes and line breaks, written as CSV and read again by byte ranges."""
    rows = d.star("documents").where("text <> ''").select("doc_id", "text").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    path = keep(rows.limit(0), "texts").kept_path + "-csv"
    rows.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    v = F.col("value")
    return files.scan_csv(prepare(d.spark), path).select("logical_record", v["doc_id"].cast("long").alias("doc_id"), F.length(v["text"]).cast("long").alias("characters"), F.md5(v["text"]).alias("digest"))


@query("SELECT 'csv' AS kind, count(*) AS n FROM documents WHERE text <> '' UNION ALL SELECT 'ndjson', count(*) FROM documents WHERE text <> ''", plain=True)
def count_source_records(d: Domain):
    """Records counted without building them."""
    rows = d.star("documents").where("text <> ''").select("doc_id", "text")
    path, spark = keep(rows.limit(0), "texts").kept_path, prepare(d.spark)
    rows.write.csv(path + "-csv", header=True, quoteAll=True, escape='"')
    rows.write.json(path + "-ndjson")
    return spark.createDataFrame([(k, files.count_records(spark, f"{path}-{k}", k)) for k in ("csv", "ndjson")], "kind string, n long")


@query(_FILE_SQL, plain=True)
def scan_ndjson(d: Domain):
    return _scanned(d, "ndjson")


@query(_FILE_SQL, plain=True)
def scan_json_array(d: Domain):
    return _scanned(d, "json_array")


@query(_FILE_SQL, plain=True)
def scan_xml(d: Domain):
    return _scanned(d, "xml")


def _episodes(d: Domain):
    """Walk findings tied by spends, and window findings tied by the transactions they rest on."""
    spends = d.tx_in.select(F.col("txid").alias("id"), "prev_txid", "txid")
    times = d.tx.select(F.col("txid").alias("id"), F.col("us").alias("start_us"), (F.col("us") + 900_000_000).alias("end_us"))
    walks = times.join(spends.select("id").distinct(), "id", "left_semi").select("*", F.lit("peeling_chain_candidate").alias("rule"), F.concat(F.lit("tx:"), F.col("id").cast("string")).alias("entity_ref"))
    # A window and part in one number: (1 << 40) + w * 100000 + part, and (1 << 41) more for each 100000 parts.
    w, part = F.floor(F.col("us") / 900_000_000), F.col("part")
    number = (1 << 40) + w * 100_000 + part % 100_000 + F.greatest(F.floor(part / 100_000), F.lit(0)) * (1 << 41)
    o = d.tx_out.where("addr is not null and part is not null").select(number.alias("id"), "part", "txid", w.alias("w"))
    found = o.select("id", "part", "w").distinct().select("id", (F.col("w") * 900_000_000).alias("start_us"), ((F.col("w") + 1) * 900_000_000).alias("end_us"), F.lit("fan_out").alias("rule"), F.concat(F.lit("address:p"), F.col("part").cast("string")).alias("entity_ref"))
    refs = o.select("id", F.lit("e").alias("evidence_id"), F.concat(F.lit("/"), (F.col("txid") % 97).cast("string")).alias("locator"), F.lit("h").alias("sha256"))
    return groups.finding_anchors(walks.unionByName(found), spends, refs)


@query()
def investigation_groups(d: Domain):
    return groups.review_groups(_episodes(d))


@query()
def investigation_coverage(d: Domain):
    found = _episodes(d)
    return groups.group_coverage(groups.review_groups(found), found)
