"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row gets the exponential key -ln(u)/weight with u from a hash of its id, so reruns agree. A
source's target is met by complete epochs first; what remains is a budget of words that goes to its
smallest keys. The prefix sum behind that is not a sort of the source: keys fall into 1024 ordered
buckets, the bucket where the budget ends into 1024 more, and only rows of that last bucket are put
in order. A bucket's totals combine map-side, so a hot source costs no more per task than any other.

Defined results: null text has size zero; a null source is a source, last in order; rows that repeat
an id share a key and are ordered by size; a source without words takes none; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: What parts words, and the weights that sources get in turn.
WORD, WEIGHTS = r"[^\x20\x09-\x0D]+", (3, 1, 2)
_BUCKETS = 1024


def prose_weight(text: Column, size: Column) -> Column:
    """Quality weight: how near a document's mean word length is to that of running prose."""
    return 1 / (1 + F.abs(F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1)) - 6))


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(g, source_size, target) for each source: weighted shares that stop at `most` times its size, the excess reshared.

    In the order of cap to weight a source is capped if its cap is below its share of what the
    capped ones before it leave; that fixpoint needs one window over the table of sources.
    """
    s = sized.groupBy("g", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(whole) * F.lit(share), "all_w": F.sum("w").over(whole), "cap_b": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_b": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_b")) <= F.col("w") * (F.col("total") - F.col("cap_b")))
    s = s.withColumns({"cap_c": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0)), "w_c": F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(whole), F.lit(0.0))})
    free = F.col("w") * (F.col("total") - F.col("cap_c")) / (F.col("all_w") - F.col("w_c"))
    return s.select("g", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free).alias("target"))


def _budget_end(rows: DataFrame, plan: DataFrame, bucket: str, room: str, out: str, left: str) -> DataFrame:
    """plan with the bucket in which `room` words end (out) and the words left for it (left)."""
    totals = rows.groupBy("g", bucket).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("g").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = totals.join(plan.select("g", room), "g").where(F.col("before") <= F.col(room)).where(F.col(room) < F.col("before") + F.col("n"))
    ends = ends.select("g", F.col(bucket).alias(out), (F.col(room) - F.col("before")).alias(left))
    return plan.join(ends, "g", "left")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weight=prose_weight, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, carry: tuple = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the carried columns for each row; taken counts words, repeats and a cut last document included."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(text_col).cast("string").alias("t"), *carry)
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    rows = rows.select(*carry, "doc_id", "source", "size", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("g"), (-F.log(u) / weight(F.col("t"), F.col("size"))).alias("key"))
    at = F.floor(F.col("key") / (1 + F.col("key")) * _BUCKETS * _BUCKETS)
    rows = keep(rows.withColumn("b1", F.floor(at / _BUCKETS).cast("int")).withColumn("b2", F.pmod(at, F.lit(_BUCKETS)).cast("int")), "keys")
    plan = source_targets(rows, share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs).withColumn("room", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = _budget_end(rows, plan, "b1", "room", "e1", "room1")
    inner = rows.join(plan.select("g", "e1"), "g").where("b1 = e1").drop("e1")
    plan = keep(_budget_end(inner, plan, "b2", "room1", "e2", "room2"), "mix-plan")
    placed = rows.join(plan, "g")
    last = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    full = (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2")))
    even = placed.where(~F.coalesce(last, F.lit(False))).withColumn("part", F.when(full, F.col("size")).otherwise(0))
    before = Window.partitionBy("g").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(last).withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("room2") - F.coalesce(F.sum("size").over(before), F.lit(0)))))
    columns = ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *carry]
    return even.select(columns).unionByName(edge.select(columns))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / (1 / (1 + abs(chars::DOUBLE / greatest(size, 1) - 6))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0) AS cap_b, coalesce(sum(w) OVER o, 0) AS w_b FROM w
    WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (all_w - w_b) <= w * (total - cap_b) AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (all_w - coalesce(sum(w) FILTER (capped) OVER (), 0)) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size) AS room,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, room - before)))::BIGINT AS taken FROM r
"""
