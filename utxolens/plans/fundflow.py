"""Fund flow of the largest transactions and the busiest addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fundflow import fund_flow as flow
from .core import _FIRST
from .domain import Domain
from .registry import query

_COINS = _FIRST + """, co AS (SELECT concat('out:', o.txid, ':', o.vout) AS coin, concat('tx:', o.txid) AS made, concat('address:', addr) AS lock, amount, CASE WHEN sp.t IS NOT NULL THEN concat('tx:', sp.t) END AS spender FROM tx_out o LEFT JOIN (SELECT prev_txid, prev_vout, min(txid) AS t FROM s WHERE status = 'resolved' GROUP BY ALL) sp ON sp.prev_txid = o.txid AND sp.prev_vout = o.vout),
    ce AS ((SELECT made AS centre FROM co GROUP BY made ORDER BY sum(amount) DESC, made LIMIT 20) UNION ALL (SELECT lock FROM co GROUP BY lock ORDER BY count(*) DESC, lock LIMIT 20)),
    rw AS (SELECT centre, 'in' AS side, lock AS id, coin, amount, true AS spent, made AS way FROM co JOIN ce ON centre = spender UNION ALL SELECT centre, 'out', lock, coin, amount, spender IS NOT NULL, spender FROM co JOIN ce ON centre = made
        UNION ALL SELECT centre, 'in', made, coin, amount, spender IS NOT NULL, coin FROM co JOIN ce ON centre = lock UNION ALL SELECT centre, 'out', spender, coin, amount, true, coin FROM co JOIN ce ON centre = lock WHERE spender IS NOT NULL),
    en AS (SELECT centre, side, id, sum(amount)::BIGINT AS amount, count(*) AS utxo_count, count(*) FILTER (spent) AS spent_count, coalesce(array_to_string(list_slice(list(way ORDER BY coin) FILTER (way IS NOT NULL), 1, 5), ','), '') AS via FROM rw GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY centre, side ORDER BY amount DESC, id)::INT AS place FROM en), tt AS (SELECT lock AS id, made AS t FROM co UNION SELECT lock, spender FROM co WHERE spender IS NOT NULL), lg AS (SELECT made AS id, lock FROM co UNION ALL SELECT spender, lock FROM co WHERE spender IS NOT NULL),
    ow AS (SELECT centre, side, p.id, count(*) FILTER (t <> centre) AS onward FROM pl p JOIN tt USING (id) WHERE place <= 40 GROUP BY centre, side, p.id UNION ALL SELECT centre, side, p.id, count(*) FILTER (lock IS DISTINCT FROM centre) FROM pl p JOIN lg USING (id) WHERE place <= 40 GROUP BY centre, side, p.id),
    fl AS (SELECT p.*, coalesce(onward, 0) AS onward, coalesce(onward, 0) > 0 AS selectable FROM pl p LEFT JOIN ow USING (centre, side, id) WHERE place <= 40)"""


def _flow(d: Domain):
    amounts = d.tx_out.groupBy("txid").agg(F.sum("amount").alias("n")).orderBy(F.desc("n"), F.concat(F.lit("tx:"), F.col("txid").cast("string"))).limit(20)
    busy = d.tx_out.groupBy("addr").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "addr").limit(20)
    centres = amounts.select(F.concat(F.lit("tx:"), F.col("txid").cast("string")).alias("node")).unionByName(busy.select(F.concat(F.lit("address:"), "addr").alias("node")))
    return flow(d.tx_in, d.tx_out, d.tx, centres)


@query(_COINS + "SELECT centre, side, place, id, amount, utxo_count, spent_count, via, onward, selectable FROM fl")
def fund_flow(d: Domain):
    return _flow(d)[0].select("centre", "side", "place", "id", "amount", "utxo_count", "spent_count", "via", "onward", "selectable")


@query(_COINS + """, ct AS (SELECT centre, count(*) FILTER (side = 'in') AS input_count, count(*) FILTER (side = 'out') AS output_count, coalesce(sum(amount) FILTER (side = 'in'), 0)::BIGINT AS input_sats, coalesce(sum(amount) FILTER (side = 'out'), 0)::BIGINT AS output_sats, count(DISTINCT id) AS ids FROM en GROUP BY centre),
    de AS (SELECT centre, count(*) FILTER (side = 'in' AND NOT selectable) AS dead_end_inputs, count(*) FILTER (side = 'out' AND NOT selectable) AS dead_end_outputs FROM fl GROUP BY centre)
    SELECT centre, input_count, output_count, input_sats, output_sats, dead_end_inputs, dead_end_outputs, greatest(input_count - 40, 0) AS truncated_inputs, greatest(output_count - 40, 0) AS truncated_outputs, CASE WHEN centre LIKE 'address:%' THEN ids END AS transaction_count FROM ct JOIN de USING (centre)""")
def fund_flow_totals(d: Domain):
    return _flow(d)[1].drop("asked")
