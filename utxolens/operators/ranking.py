"""Queues, pages, top-k, set operations and review groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def family_rank(found: DataFrame, family: list[str], order: list[Column]) -> DataFrame:
    """Rank within a family and the family's size."""
    w = Window.partitionBy(*family)
    return found.withColumn("family_rank", F.row_number().over(w.orderBy(*order))).withColumn("family_total", F.count("*").over(w))


def band(status: Column) -> Column:
    return F.when(status == "escalated", 0).when(status == "needs_data", 1).otherwise(2)


def workflow_queue(found: DataFrame, capacity: int) -> DataFrame:
    """Round robin over families inside each band: the first `capacity` are the queue, the rest the backlog."""
    rows = found.withColumn("band", band(F.col("status"))).withColumn("family_rank", F.row_number().over(Window.partitionBy("band", "rule").orderBy(F.desc("score"), "id")))
    placed = ranked(rows, [F.col(c) for c in ("band", "family_rank", "rule", "id")], "position")
    return placed.withColumn("position", F.col("position").cast("int")).withColumn("queued", F.col("position") <= capacity)


def review_queue(scored: DataFrame, entity: str, score: str, capacity: int) -> DataFrame:
    """Best score of each entity, best first."""
    best = scored.groupBy(entity).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), entity).limit(capacity)


def retain_by_budget(scored: DataFrame, score: str, quantile: float) -> DataFrame:
    """Rows at or above the reference's quantile (linear between neighbours)."""
    cut = scored.where("is_ref").agg(F.percentile(score, F.lit(quantile)).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("cut")).drop("cut")


def cosine_top_k(vectors: DataFrame, seed_id: int, k: int) -> DataFrame:
    """The k nearest to one stated vector by cosine, smaller id first on a tie."""
    seed = vectors.where(F.col("vec_id") == seed_id).select(F.col("embedding").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sim = dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    return vectors.where(F.col("vec_id") != seed_id).crossJoin(F.broadcast(seed)).select("vec_id", F.round(sim, 9).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def multiset_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest: the sum of row hashes modulo 2**61 - 1, so nothing is gathered."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("total")).select("n", F.pmod("total", F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long").alias("digest"))
