"""Queries on structured records, address scopes, verdicts and source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ip_number, ip_scope_any
from ..operators import records
from ..session import keep
from ..sources import files
from .domain import Domain
from .registry import query

_HEX = "sha256(o_orderkey::VARCHAR)"


def _raw(d: Domain):
    """Records made from orders: objects, parallel lists or plain lists, each with some faults."""
    k = F.col("o_orderkey")
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    coins = F.round("o_totalprice").cast("long")
    ins = F.concat(F.lit('[{"prev_txid": "'), F.when(k % 37 == 1, "zz").otherwise(F.upper(sha(k - 1))), F.lit('", "prev_vout": '), F.when(k % 41 == 2, "-1").otherwise((k % 3).cast("string")), F.lit(', "amount": "0.5"}, {"address": "in a"}]'))
    outs = F.concat(F.lit('[{"amount_sats": '), coins.cast("string"), F.lit(', "address": "out, b", "script_id": "s1"}, {"value": "'), F.when(k % 43 == 3, "").otherwise("1.25"), F.lit('", "script_type": "p2sh"}]'))
    shape = k % 3
    return d.star("orders").select(
        (k + 1).alias("Logical"), sha(k).alias("Tx Hash"), F.lit("bitcoin-mainnet").alias("chain"), F.lit("2026-01-01T00:00:00Z").alias("time"), F.when(k % 5 == 0, "1767225600").alias("block_time"), F.when(shape == 0, ins).when(shape == 1, '["a b", "c"]').alias("inputs"), F.when(shape == 0, outs).alias("outputs"),
        F.when(shape == 2, F.when(k % 47 == 4, "[broken").otherwise("x;y")).alias("From Addresses"), F.when(shape == 2, "1|2").alias("input amounts sats"), F.when(shape > 0, "['q', 'r']").alias("receivers"), F.when(shape > 0, F.concat(coins.cast("string"), F.lit(" 0.5"))).alias("output_amounts"),
        F.lit("p2pkh").alias("script"), F.when(k % 4 == 0, "2001:db8::1").alias("Source IP"), F.when(k % 6 == 0, "8333").alias("dport"), F.when(k % 7 == 0, "DE").alias("country"), F.lit("0.0001").alias("fees"))


_REC = f""", rc AS (SELECT o_orderkey AS k, o_orderkey % 3 AS shape, {_HEX} AS txid, round(o_totalprice)::BIGINT AS coins FROM orders), re AS (SELECT *, CASE WHEN shape = 2 AND k % 47 = 4 THEN 'not an array' WHEN shape = 0 AND k % 37 = 1 THEN 'previous txid is not 64 hex digits' WHEN shape = 0 AND k % 41 = 2 THEN 'previous vout is negative' WHEN shape = 0 AND k % 43 = 3 THEN 'an output needs an amount' END AS error FROM rc), ra AS (SELECT * FROM re WHERE error IS NULL)"""


def _records(d: Domain):
    raw = _raw(d)
    return records.normalize_records(files.canonicalize(raw.withColumnRenamed("Logical", "logical_record")))


@query(_REC + "SELECT k + 1 AS logical_record, error FROM re WHERE error IS NOT NULL")
def record_errors(d: Domain):
    return _records(d).where("error is not null").select("logical_record", "error")


@query(_REC + "SELECT k + 1 AS logical_record, txid, 'bitcoin-mainnet' AS network, 1767225600000000 AS us, 10000 AS fee_sats, CASE WHEN k % 5 = 0 THEN 'block_time' ELSE 'unknown' END AS time_meaning FROM ra")
def transaction_facts(d: Domain):
    return records.transaction_facts(_records(d)).drop("block_height", "block_hash")


@query(_REC + """SELECT k + 1 AS logical_record, txid, 0 AS vin, CASE shape WHEN 0 THEN sha256((k - 1)::VARCHAR) END AS prev_txid, CASE shape WHEN 0 THEN (k % 3)::INT END AS prev_vout, CASE shape WHEN 1 THEN 'a b' WHEN 2 THEN 'x' END AS address, CASE shape WHEN 0 THEN 50000000 WHEN 2 THEN 1 END AS amount_sats FROM ra
    UNION ALL SELECT k + 1, txid, 1, NULL, NULL, CASE shape WHEN 0 THEN 'in a' WHEN 1 THEN 'c' ELSE 'y' END, CASE shape WHEN 2 THEN 2 END FROM ra""")
def input_facts(d: Domain):
    return records.input_facts(_records(d))


@query(_REC + """SELECT k + 1 AS logical_record, txid, 0 AS vout, CASE shape WHEN 0 THEN coins ELSE coins * 100000000 END AS amount_sats, CASE shape WHEN 0 THEN 's1' END AS script_id, 'p2pkh' AS script_type, CASE shape WHEN 0 THEN 'out, b' ELSE 'q' END AS address FROM ra
    UNION ALL SELECT k + 1, txid, 1, CASE shape WHEN 0 THEN 125000000 ELSE 50000000 END, NULL, CASE shape WHEN 0 THEN 'p2sh' ELSE 'p2pkh' END, CASE shape WHEN 0 THEN NULL ELSE 'r' END FROM ra""")
def output_facts(d: Domain):
    return records.output_facts(_records(d))


@query(_REC + "SELECT concat('source:', k + 1) AS observation_id, txid, 'source-unspecified' AS observer_id, CASE WHEN k % 4 = 0 THEN '2001:db8::1' END AS src_ip, CASE WHEN k % 6 = 0 THEN 8333 END AS dst_port, CASE WHEN k % 7 = 0 THEN 'DE' END AS geo_country FROM ra WHERE k % 4 = 0 OR k % 6 = 0 OR k % 7 = 0")
def observation_facts(d: Domain):
    return records.observation_facts(_records(d), "source").select("observation_id", "txid", "observer_id", "src_ip", "dst_port", "geo_country")


_SCOPES = (("", "missing"), ("x.y", "invalid"), ("203.0.113.9", "documentation"), ("2001:db8::5", "documentation"), ("0.0.0.0", "unspecified"), ("::", "unspecified"), ("127.0.0.1", "loopback"), ("::1", "loopback"), ("169.254.1.1", "link_local"), ("fe80::1", "link_local"), ("224.0.0.1", "multicast"),
           ("ff02::1", "multicast"), ("10.1.1.1", "private"), ("fd00::1", "private"), ("::ffff:10.0.0.1", "private"), ("100.64.0.1", "reserved"), ("8.8.8.8", "public"), ("2600::1", "public"), ("::ffff:8.8.4.4", "public"))


@query("SELECT c_custkey AS id, ip, scope FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{s}')" for i, (a, s) in enumerate(_SCOPES)) + f") v(i, ip, scope) ON i = c_custkey % {len(_SCOPES)}", plain=True)
def ip_scopes_any(d: Domain):
    ips = d.spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_SCOPES)], "i int, ip string")
    scoped = ips.withColumn("scope", ip_scope_any(F.col("ip")))
    rows = d.star("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(_SCOPES)).alias("i"))
    return rows.join(F.broadcast(scoped), "i").select("id", "ip", "scope")


@query("SELECT 167772160 + n_nationkey * 256 AS start, 167772160 + n_nationkey * 256 + 255 AS \"end\", substr(n_name, 1, 2) AS country FROM nation WHERE n_nationkey % 4 > 0", plain=True)
def geo_ranges(d: Domain):
    """A country table with a header, dotted and whole bounds, and an unknown country, written and read again."""
    k = F.col("n_nationkey")
    line = F.concat_ws(",", F.concat(F.lit("10.0."), k.cast("string"), F.lit(".0")), (167772160 + k * 256 + 255).cast("string"), F.when(k % 4 > 0, F.substring("n_name", 1, 2)).otherwise("ZZ"))
    lines = d.star("nation").select(line.alias("value"))
    path = keep(lines, "ranges").kept_path + "-text"
    d.spark.createDataFrame([("start,end,country",)], "value string").unionByName(lines).write.text(path)
    return files.read_geo_ranges(d.spark, path, "country").select(ip_number(F.col("start")).alias("start"), ip_number(F.col("end")).alias("end"), "country")


@query("SELECT column_name, canonical FROM (VALUES ('Tx Hash', 'txid'), ('chain', 'network'), ('time', 'timestamp'), ('block_time', 'block_time'), ('inputs', 'inputs'), ('outputs', 'outputs'), ('From Addresses', 'input_addresses'), ('input amounts sats', 'input_amounts_sats'), ('receivers', 'output_addresses'), ('output_amounts', 'output_amounts'), ('script', 'script_type'), ('Source IP', 'src_ip'), ('dport', 'dst_port'), ('country', 'geo_country'), ('fees', 'fee')) v(column_name, canonical)", plain=True)
def header_renames(d: Domain):
    return d.spark.createDataFrame(list(files.renames(_raw(d).columns).items()), "column_name string, canonical string")


@query("WITH a AS (SELECT o_orderkey - CASE WHEN o_orderkey % 23 = 7 THEN 23 ELSE 0 END AS t, o_orderkey AS k, o_orderkey % 4 AS i, o_orderkey % 3 + 1 AS o FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY k) AS rn FROM a) SELECT count(*) AS source_rows, count(*) FILTER (rn = 1) AS transactions, sum(i) FILTER (rn = 1)::BIGINT AS inputs, sum(o) FILTER (rn = 1)::BIGINT AS outputs, count(*) FILTER (rn = 1) AS network_observations, count(*) FILTER (rn > 1) AS quarantine FROM f", plain=True)
def source_recount(d: Domain):
    """Records written as JSON lines, some with a txid that came before, counted apart from the intake."""
    k = F.col("o_orderkey")
    upto = lambda n: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), n.cast("int"))
    rows = d.star("orders").select(k.alias("n"), F.sha2((k - F.when(k % 23 == 7, 23).otherwise(0)).cast("string").cast("binary"), 256).alias("txid"), upto(k % 4).alias("inputs"), upto(k % 3 + 1).alias("outputs"))
    path = keep(rows.limit(0), "recount").kept_path + "-json"
    rows.write.json(path)
    back = d.spark.read.schema("n long, txid string, inputs array<string>, outputs array<string>").json(path)
    return files.recount(back.withColumnRenamed("n", "logical_record"))
