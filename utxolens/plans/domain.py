"""The canonical tables derived from a star schema, once for Spark and once for the SQL oracle.

An order is a transaction, its lines are outputs, and a line spends the previous line of the same
part; the line after one line in 97 claims that line's outpoint a second time, and one transaction in 173 also claims an outpoint
that is not in the ledger. Events are network observations. One template serves both dialects; they differ in epoch arithmetic only.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, stats
from ..session import keep, prepare

_TEMPLATE = {
    "tx": """SELECT o_orderkey AS seq, o_orderkey AS txid,
        1704067200000000 + (DIV(US(o_orderdate), 86400000000) % 400 * 3600 + o_orderkey * 7919 % 3600) * 1000000 AS us,
        CAST(round(o_totalprice) AS BIGINT) % 1000 AS fee FROM orders""",
    "tx_out": """SELECT txid, vout, part, CASE WHEN part % 17 = 0 THEN NULL ELSE addr END AS address,
        CASE WHEN part % 17 = 0 THEN addr END AS script_id, addr, script_type, amount, us FROM (
        SELECT l_orderkey AS txid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INT) AS vout, l_partkey AS part,
        concat('a', CAST(l_partkey * 100 + l_suppkey AS STRING)) AS addr, l_returnflag AS script_type,
        (DIV(CAST(round(l_extendedprice * 100) AS BIGINT), 1000000) + 1) * 1000000 AS amount, tx.us
        FROM lineitem JOIN tx ON tx.txid = l_orderkey) lines""",
    "tx_in": """SELECT txid, CAST(row_number() OVER (PARTITION BY txid ORDER BY prev_txid, prev_vout) - 1 AS INT) AS vin, prev_txid, prev_vout,
        CASE WHEN txid % 7 = 0 THEN prev_addr END AS address FROM (
        SELECT DISTINCT txid, prev_txid, prev_vout, prev_addr FROM (
        SELECT txid, lag(txid) OVER w AS prev_txid, lag(vout) OVER w AS prev_vout, lag(addr) OVER w AS prev_addr FROM tx_out
            WINDOW w AS (PARTITION BY part ORDER BY us, txid, vout)
        UNION ALL
        SELECT CASE WHEN (txid * 31 + vout) % 97 = 0 THEN lead(txid) OVER w END AS txid, lag(txid) OVER w AS prev_txid, lag(vout) OVER w AS prev_vout, lag(addr) OVER w AS prev_addr FROM tx_out
            WINDOW w AS (PARTITION BY part ORDER BY us, txid, vout)
        UNION ALL
        SELECT txid, -1 - txid AS prev_txid, 0 AS prev_vout, NULL AS prev_addr FROM tx_out WHERE vout = 0 AND txid % 173 = 0) claims
        WHERE prev_txid IS NOT NULL AND txid IS NOT NULL AND txid <> prev_txid) spends""",
    "obs": """SELECT event_id AS seq, event_id AS obs_id, event_id * 7 % 15013 AS txid,
        concat('10.', CAST(user_id % 5 AS STRING), '.', CAST(user_id % 40 AS STRING), '.1') AS src_ip,
        concat('203.0.113.', CAST(user_id % 50 AS STRING)) AS dst_ip,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('AS', CAST(100 + (user_id + event_id % 11 % 2) % 5 AS STRING)) END AS asn,
        CASE WHEN event_id % 10 = 0 THEN NULL WHEN (user_id + event_id % 7) % 4 = 0 THEN 'US' WHEN user_id % 4 = 1 THEN 'DE' ELSE 'FR' END AS country,
        US(ts) AS us FROM events""",
}

def _spell(text: str, duck: bool) -> str:
    out, i = "", 0
    while i < len(text):
        for name in ("DIV(", "US("):
            if text.startswith(name, i) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                depth, j, args = 1, i + len(name), [""]
                while depth:
                    c = text[j]
                    depth += (c == "(") - (c == ")")
                    if depth == 1 and c == ",":
                        args.append("")
                    elif depth:
                        args[-1] += c
                    j += 1
                args = [_spell(a.strip(), duck) for a in args]
                if name == "DIV(":
                    out += f"(({args[0]}) {'//' if duck else 'div'} {args[1]})"
                else:
                    out += f"epoch_us({args[0]})" if duck else f"unix_micros(CAST({args[0]} AS TIMESTAMP))"
                i = j
                break
        else:
            out += text[i]
            i += 1
    return out


#: What an oracle begins with; it goes on with ", more AS (...) SELECT ..." or "SELECT ...".
ORACLE_PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({_spell(sql, True)})" for name, sql in _TEMPLATE.items()) + "\n"


def _spends(tx_out: DataFrame) -> DataFrame:
    """tx_in as its SQL has it: one shuffle by part gives a line all it claims and leads to, one by transaction tells claims apart and numbers them."""
    line = Window.partitionBy("part").orderBy("us", "txid", "vout")
    before = [F.lag(c).over(line).alias(f"prev_{c}") for c in ("txid", "vout", "addr")]
    rows = tx_out.select("txid", "vout", *before, F.lead("txid").over(line).alias("after"))
    claim = lambda txid, *prev: F.struct(txid.alias("txid"), *[p.alias(n) for p, n in zip(prev, ("prev_txid", "prev_vout", "prev_addr"))])
    txid, prev = F.col("txid"), [F.col(c) for c in ("prev_txid", "prev_vout", "prev_addr")]
    second = F.when((txid * 31 + F.col("vout")) % 97 == 0, F.col("after"))
    missing = F.when((F.col("vout") == 0) & (txid % 173 == 0), -1 - txid)
    claims = rows.select(F.explode(F.array(claim(txid, *prev), claim(second, *prev), claim(txid, missing, F.lit(0), F.lit(None).cast("string")))).alias("c")).select("c.*")
    spends = claims.where("prev_txid is not null and txid is not null and txid <> prev_txid").repartition("txid").distinct()
    vin = F.row_number().over(Window.partitionBy("txid").orderBy("prev_txid", "prev_vout")) - 1
    return spends.select("txid", vin.cast("int").alias("vin"), "prev_txid", "prev_vout", F.when(txid % 7 == 0, F.col("prev_addr")).alias("address"))


class Domain:
    """A snapshot of the star tables and the derived ones: each of these is written once for a session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def star(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derive(self, name: str, **tables: DataFrame) -> DataFrame:
        known = self.spark.__dict__.setdefault("_utxolens_snapshots", {})
        if (self.sf_dir, name) not in known:
            sql = _spell(_TEMPLATE[name], False)
            for t in tables:
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
            known[self.sf_dir, name] = keep(self.spark.sql(sql, **tables), name)
        return known[self.sf_dir, name]

    def derived(self, name: str, make) -> DataFrame:
        """A table made from this snapshot, written once for a session and folder."""
        known = self.spark.__dict__.setdefault("_utxolens_snapshots", {})
        if (self.sf_dir, name) not in known:
            known[self.sf_dir, name] = keep(make(), name)
        return known[self.sf_dir, name]

    @cached_property
    def clusters(self) -> DataFrame:
        """Addresses and the entities that common inputs make of them."""
        return self.derived("clusters", lambda: graph.common_input_clusters(self.tx_in, self.tx_out))

    @property
    def entities(self) -> DataFrame:
        """(addr, wallet) of the addresses that have an entity; all others are their own wallets."""
        return self.clusters.withColumnRenamed("entity_id", "wallet")

    @cached_property
    def wallets(self) -> DataFrame:
        """Every address with its entity, or itself."""
        return self.derived("wallets", lambda: graph.wallets(self.clusters, self.tx_out.select("addr").distinct()))

    @cached_property
    def shapes(self) -> DataFrame:
        """Shape features of every transaction."""
        return self.derived("shapes", lambda: stats.shape_features(self.tx_in, self.tx_out, self.tx))

    @cached_property
    def tx(self) -> DataFrame:
        return self._derive("tx", orders=self.star("orders"))

    @cached_property
    def tx_out(self) -> DataFrame:
        return self._derive("tx_out", lineitem=self.star("lineitem"), tx=self.tx)

    @cached_property
    def tx_in(self) -> DataFrame:
        return self.derived("tx_in", lambda: _spends(self.tx_out))

    @cached_property
    def obs(self) -> DataFrame:
        return self._derive("obs", events=self.star("events"))
