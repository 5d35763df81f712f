"""Transaction shapes and the anomaly layers on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .ordered import ranked, running
from .spends import resolve_inputs


def shape_features(tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame, earlier: bool = False) -> DataFrame:
    """The 32 shape features of every transaction with outputs, from two aggregations and no self-join; `earlier` leaves out inputs whose output is not strictly earlier."""
    tolerance = lambda tol: F.count("*").over(Window.partitionBy("txid").orderBy("amount").rangeBetween(-tol, 0))
    rank = Window.partitionBy("txid").orderBy("amount", "vout")
    o = tx_out.select("txid", "vout", "amount", "script_type", *[tolerance(t).alias(f"eq{t}") for t in (0, 10, 100, 1000)], F.row_number().over(rank).alias("i"), F.row_number().over(Window.partitionBy("txid").orderBy(F.desc("amount"), "vout")).alias("r"), F.sum("amount").over(Window.partitionBy("txid")).alias("total"))
    p = F.col("amount") / F.col("total")
    outs = o.groupBy("txid").agg(
        F.count("*").alias("n_outputs"), *[F.max(f"eq{t}").alias(f"equal_tol_{t}") for t in (0, 10, 100, 1000)], F.size(F.collect_set("amount")).alias("value_classes"),
        (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy0"), F.sum(F.col("i") * F.col("amount")).alias("ix"), F.sum("amount").alias("out_total"), F.max("amount").alias("out_max"), F.min("amount").alias("out_min"),
        F.median("amount").alias("out_median"), F.max_by("amount", F.struct("amount", F.col("vout"))).alias("first"), F.count_if(F.col("amount") % 100000 == 0).alias("round_outputs"), F.size(F.collect_set("script_type")).alias("script_types"), F.max(F.when(F.col("r") == 2, F.col("amount"))).alias("second"))
    age = (F.col("us") - F.col("prev_us")) / 1e6
    spent = resolve_inputs(tx_in, tx_out).where("prev_amount is not null").select("txid", "prev_amount", "prev_us").join(tx.select("txid", "us"), "txid")
    ins = (spent.where("prev_us < us") if earlier else spent).groupBy("txid").agg(
        F.count("*").alias("n_inputs"), F.sum("prev_amount").alias("in_total"), F.max("prev_amount").alias("in_max"), F.min(F.greatest(age, F.lit(0.0))).alias("age_min"), F.median(F.greatest(age, F.lit(0.0))).alias("age_median"), F.avg((F.greatest(age, F.lit(0.0)) <= 3600).cast("double")).alias("young_share"))
    t = outs.join(ins, "txid", "left").join(tx.select("txid", F.coalesce("fee", F.lit(0)).alias("fee")), "txid").fillna(0, ["n_inputs", "in_total", "in_max", "age_min", "age_median", "young_share"])
    n, total, d = F.col("n_outputs"), F.col("out_total"), lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ratio = d(F.coalesce("second", F.lit(0)), F.col("out_max"))
    lg = lambda c: F.log1p(F.col(c).cast("double"))
    return t.select(
        "txid", "n_inputs", "n_outputs", lg("n_inputs").alias("log_inputs"), lg("n_outputs").alias("log_outputs"), *[f"equal_tol_{t_}" for t_ in (0, 10, 100, 1000)], (F.col("equal_tol_0") / n).alias("equal_fraction"), "value_classes",
        (F.col("value_classes") / n).alias("class_fraction"), F.when(n < 2, 0.0).otherwise(F.col("entropy0")).alias("entropy"), (2 * F.col("ix") / (n * total) - (n + 1) / n).alias("gini"), (F.col("out_max") / total).alias("max_share"), ratio.alias("second_ratio"),
        lg("out_total").alias("log_total"), lg("out_max").alias("log_max"), lg("out_min").alias("log_min"), lg("out_median").alias("log_median"), lg("fee").alias("log_fee"), d(F.col("fee"), F.col("in_total")).alias("fee_share"), d(F.col("out_max"), F.col("in_total")).alias("largest_over_in"),
        ((n == 2) & (ratio < 0.25)).cast("int").alias("one_big_one_small"), "round_outputs", (F.col("round_outputs") / n).alias("round_share"), "script_types", d(F.col("in_max"), F.col("in_total")).alias("in_max_share"), lg("in_total").alias("log_in"),
        d(F.col("out_total"), F.col("in_total")).alias("out_over_in"), lg("age_min").alias("log_age_min"), lg("age_median").alias("log_age_median"), "young_share")


def motif_flags(shapes: DataFrame) -> DataFrame:
    """Mixing-like and one-big-one-small flags, and the rule baseline's score."""
    mixing = (F.col("equal_tol_100") >= 3) & (F.col("n_inputs") >= 3) & (F.col("n_outputs") >= 3)
    exact = (F.col("equal_tol_0") >= 3) & (F.col("n_inputs") >= 3) & (F.col("n_outputs") >= 3)
    top = shapes.agg(F.max("equal_tol_0").alias("top"))
    score = F.when(exact, 1 + F.col("equal_tol_0") / F.col("top")).when(F.col("one_big_one_small") == 1, 0.5).otherwise(0.0)
    return shapes.crossJoin(F.broadcast(top)).select("txid", mixing.alias("mixing_like"), (F.col("one_big_one_small") > 0).alias("peel_like"), score.alias("baseline"))


def reference_set(tx: DataFrame, share: float = 0.7) -> DataFrame:
    """The earliest floor(share * n) transactions (one at least) by (second, txid): txid and whether it is in.

    Found by counting whole seconds first, so only the boundary second is put in order.
    """
    second = F.floor(F.col("us") / 1_000_000)
    counts = tx.groupBy(second.alias("second")).agg(F.count("*").alias("n"))
    before = Window.orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy()) * share)) - F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = tx.select("txid", second.alias("second")).join(counts.select("second", room.alias("room")), "second")
    return placed.select("txid", (F.row_number().over(Window.partitionBy("second").orderBy("txid")) <= F.col("room")).alias("is_ref"))


def reference_rank(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Share of reference values at or below each value: distinct values are counted first, so the order is over those."""
    return with_rank(rows, value_ranks(rows, value, group), [*(group or []), value])


def value_ranks(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, value, rank, _deal, often): the rank of every distinct value, and whether a thousandth of all rows or more have it."""
    g = group or []
    counts = rows.groupBy(*g, value).agg(F.count_if("is_ref").alias("n"), F.count("*").alias("_rows"))
    if not g:
        ranks = running(counts, [F.col(value)], {"up": "n"}).crossJoin(F.broadcast(rows.agg(F.count_if("is_ref").alias("whole"))))
        rank = F.col("up") / F.col("whole")
    else:
        whole = Window.partitionBy(*g)
        ranks, rank = counts, F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)
    ranks = keep(ranks.select(*g, value, "_rows", rank.alias("rank"), F.lit(0).cast("long").alias("_deal")), "ranks")  # read back, 0 stays a key of the join
    return ranks.crossJoin(F.broadcast(ranks.agg(F.sum("_rows").alias("_all")))).select(*g, value, "rank", "_deal", (F.col("_rows") * 1000 >= F.col("_all")).alias("often"))


def with_rank(rows: DataFrame, ranks: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """rows with the ranks of their values: those of frequent values (zeros, mostly) go to every task, so that their rows never meet in one."""
    near = rows.join(F.broadcast(ranks.where("often").select(*key, F.col("rank").alias("_near"))), key, "left")
    near = near.withColumn("_deal", F.when(F.col("_near").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1).cast("long"))))
    far = ranks.where("not often").select(*key, "_deal", F.col("rank").alias("_far"))
    found = near.join(far, [*key, "_deal"], "left").withColumn(name, F.coalesce("_near", "_far")).where(F.col(name).isNotNull())
    return found.select(*key, *[c for c in rows.columns if c not in key], name)


def ecod(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier score from empirical tails: for each column the larger of -ln of both tails and of the skewed one, summed."""
    long = rows.select("txid", "is_ref", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("txid", "is_ref", "x.c", "x.v")
    # One running total over all columns' values; a column's own starts at what the columns before it hold.
    counts = running(long.groupBy("c", "v").agg(F.count_if("is_ref").alias("n")), [F.col("c"), F.col("v")], {"up": "n"})
    totals = long.groupBy("c").agg(F.count_if("is_ref").alias("total"))
    totals = totals.withColumn("start", F.coalesce(F.sum("total").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at_most, total = F.col("up") - F.col("start"), F.col("total")
    tails = counts.join(F.broadcast(totals), "c").select("c", "v", F.greatest(at_most / total, 1 / total).alias("left"), F.greatest((total - at_most + F.col("n")) / total, 1 / total).alias("right"))
    skew = long.where("is_ref").groupBy("c").agg(F.skewness("v").alias("skew"))
    scored = long.join(tails, ["c", "v"]).join(F.broadcast(skew), "c")
    chosen = F.when(F.coalesce("skew", F.lit(0.0)) < 0, F.col("left")).otherwise(F.col("right"))
    return scored.groupBy("txid").agg(F.sum(-F.log(F.least(chosen, "left", "right"))).alias("score"))


def hbos(rows: DataFrame, columns: list[str], bins: int = 32) -> DataFrame:
    """Histogram score on the reference: -ln of a value's bin density over its column's largest, empty bins counting one row; summed over columns."""
    long = rows.select("txid", "is_ref", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("txid", "is_ref", "x.c", "x.v")
    edges = long.where("is_ref").groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))))
    placed = long.join(F.broadcast(edges), "c").withColumn("bin", at)
    counts = placed.groupBy("c", "bin").agg(F.greatest(F.count_if("is_ref"), F.lit(1)).alias("k"))
    counts = counts.join(F.broadcast(counts.groupBy("c").agg(F.max("k").alias("top"))), "c")
    return placed.join(F.broadcast(counts), ["c", "bin"]).groupBy("txid").agg(F.sum(-F.log(F.col("k") / F.col("top"))).alias("score"))


def kaplan_meier(durations: DataFrame) -> DataFrame:
    """(stratum, duration, survival) at every event time from (stratum, duration, event)."""
    at = durations.groupBy("stratum", "duration").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count("*").alias("c"))
    later = Window.partitionBy("stratum").orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    risk = at.withColumn("at_risk", F.sum("c").over(later)).where("d > 0")
    up = Window.partitionBy("stratum").orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(up) == 1
    return risk.select("stratum", "duration", F.when(dead, 0.0).otherwise(F.exp(F.sum(F.log(1 - F.when(F.col("d") == F.col("at_risk"), 0.0).otherwise(F.col("d") / F.col("at_risk")))).over(up))).alias("survival"))


def bucket_series(times: DataFrame, seconds: int = 900) -> DataFrame:
    """(family, bucket, n): counts from the first time of all families on, empty buckets included; times is (family, us, member).

    Buckets start at the earliest time of any row; only members are counted.
    """
    low = times.agg(F.min("us").alias("low"), F.max("us").alias("high"))
    size = seconds * 1_000_000
    counts = times.where("member").crossJoin(F.broadcast(low)).groupBy("family", F.floor((F.col("us") - F.col("low")) / size).alias("bucket")).agg(F.count("*").alias("n"))
    grid = low.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / size))).alias("bucket"))
    grid = times.select("family").distinct().crossJoin(F.broadcast(grid))
    return grid.join(counts, ["family", "bucket"], "left").select("family", "bucket", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def burst_baseline(series: DataFrame, half_life: float = 96.0, warm: int = 8, floor: float = 0.25, prior: float | None = None) -> DataFrame:
    """Each bucket's exponentially weighted mean of strictly earlier buckets, started at the mean of the first ones, or at a prior that knows none.

    A series is one row a bucket (time, not data, bounds it), so each family's is folded in one task, one pass.
    """
    decay = 0.5 ** (1 / half_life)

    def fold(pdf):
        pdf = pdf.sort_values("bucket")
        n, mean, out = pdf["n"].tolist(), float(pdf["n"].head(warm).mean()) if prior is None else prior, []
        for v in n:
            out.append(max(mean, floor))
            mean = decay * mean + (1 - decay) * v
        return pdf.assign(baseline=out)

    return series.groupBy("family").applyInPandas(fold, "family string, bucket long, n double, baseline double")


def population_bursts(times: DataFrame, seconds: int = 900, half_life: float = 96.0, warm: int = 8, floor: float = 0.25, surprise=None) -> DataFrame:
    """(family, bucket, n, baseline, surprise): counts and -ln P(X >= n) at the rate of strictly earlier buckets, by `surprise`(n, rate), poisson_surprise if not given."""
    from .layers import poisson_surprise

    b = burst_baseline(bucket_series(times, seconds), half_life, warm, floor)
    return b.withColumn("surprise", (surprise or poisson_surprise)(F.col("n"), F.col("baseline")))


def inherited_bursts(times: DataFrame, seconds: int = 900, surprise=None) -> DataFrame:
    """(txid, burst): a transaction has the strongest surprise of its own bucket among the families it belongs to, else 0."""
    low = times.agg(F.min("us").alias("low"))
    bucket = F.floor((F.col("us") - F.col("low")) / (seconds * 1_000_000))
    rows = times.crossJoin(F.broadcast(low)).select("txid", "family", "member", bucket.alias("bucket"))
    scored = rows.join(population_bursts(times, seconds, surprise=surprise).select("family", "bucket", "surprise"), ["family", "bucket"])
    return scored.groupBy("txid").agg(F.max(F.when(F.col("member"), F.col("surprise")).otherwise(0.0)).alias("burst"))


def causal_bursts(times: DataFrame, seconds: int = 900, half_life: float = 96.0, prior: float = 0.25, surprise=None) -> DataFrame:
    """(txid, burst): the strongest surprise, among the families of a transaction, of the bucket completed before its own; 0 in the first.

    Rates start at a fixed prior, so nothing later than a bucket's end enters it.
    """
    from .layers import poisson_surprise

    b = burst_baseline(bucket_series(times, seconds), half_life, floor=0.25, prior=prior)
    b = b.select("family", (F.col("bucket") + 1).alias("bucket"), (surprise or poisson_surprise)(F.col("n"), F.col("baseline")).alias("surprise"))
    low = times.agg(F.min("us").alias("low"))
    rows = times.crossJoin(F.broadcast(low)).select("txid", "family", "member", F.floor((F.col("us") - F.col("low")) / (seconds * 1_000_000)).alias("bucket"))
    scored = rows.join(b, ["family", "bucket"], "left")
    return scored.groupBy("txid").agg(F.max(F.when(F.col("member"), F.coalesce("surprise", F.lit(0.0))).otherwise(0.0)).alias("burst"))


def change_points(series: DataFrame, hazard: float = 1 / 240, longest: int = 400) -> DataFrame:
    """(family, bucket, n, changed): online probability that a Poisson rate changed, over run lengths up to `longest`.

    A run's rate has a Gamma(1, 1) prior, so a count's predictive is negative binomial. One pass for each family's series.
    """

    def fold(pdf):
        from math import lgamma

        import numpy as np

        pdf = pdf.sort_values("bucket")
        gamma = np.vectorize(lgamma, otypes=[float])
        prob, a, b, out = np.ones(1), np.ones(1), np.ones(1), []
        for v in pdf["n"].to_numpy():
            like = np.exp(gamma(a + v) - gamma(a) - lgamma(v + 1) + a * np.log(b / (b + 1)) - v * np.log(b + 1))
            both = prob * np.maximum(like, 1e-12)
            prob = np.append(both.sum() * hazard, both * (1 - hazard))[: longest + 1]
            prob /= prob.sum()
            a, b = np.append(1.0, a + v)[: longest + 1], np.append(1.0, b + 1)[: longest + 1]
            out.append(prob[0])
        return pdf.assign(changed=out)

    return series.groupBy("family").applyInPandas(fold, "family string, bucket long, n double, changed double")


def average_precision(scored: DataFrame) -> DataFrame:
    """Tie-aware average precision and ROC area from (score, label): equal scores are one block, so rows are counted before any order."""
    blocks = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    b = running(blocks, [F.desc("score")], {"cn": "n", "cp": "pos"})
    t = b.agg(F.sum("n").alias("all"), F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("ap"), F.sum(F.col("pos") * ((F.col("cn") - F.col("cp")) - (F.col("n") - F.col("pos")) / 2)).alias("above"))
    return t.select("positives", (F.col("ap") / F.col("positives")).alias("average_precision"), (1 - F.col("above") / (F.col("positives") * (F.col("all") - F.col("positives")))).alias("roc_auc"))


def reliability_bins(scored: DataFrame) -> DataFrame:
    """Count, mean probability and share of positives in ten bins, with their weight in the calibration error."""
    bins = scored.groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("share"))
    return bins.withColumn("ece_part", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.abs(F.col("mean_score") - F.col("share")))


def pair_scores(rows: DataFrame) -> DataFrame:
    """Pairwise precision and recall of (predicted, truth) groupings from their contingency table."""
    cells = rows.groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    by = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))
    both = cells.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"))
    return both.crossJoin(by("predicted", "p")).crossJoin(by("truth", "t")).select((F.col("both") / F.col("p")).alias("pair_precision"), (F.col("both") / F.col("t")).alias("pair_recall"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; each side's distinct values are counted before they are ordered."""

    def ranks(c):
        counts = running(rows.groupBy(c).agg(F.count("*").alias("k")), [F.col(c)], {"up": "k"})
        return counts.select(c, (F.col("up") - F.col("k") + (F.col("k") + 1) / 2).alias(f"rank_{c}"))

    return rows.join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def rank_average(scores: DataFrame, layers: list[str]) -> DataFrame:
    """(txid, fused): the mean of each layer's 0-to-1 rank, ties by txid."""
    out = scores.select("txid").crossJoin(F.broadcast(scores.agg(F.count("*").alias("whole"))))
    for c in layers:
        place = ranked(scores.select("txid", c), [F.col(c), F.col("txid")], f"r_{c}").select("txid", f"r_{c}")
        out = out.join(place, "txid")
    return out.select("txid", (sum((F.col(f"r_{c}") - 1) / F.greatest(F.lit(1), F.col("whole") - 1) for c in layers) / len(layers)).alias("fused"))


def brier(scored: DataFrame) -> DataFrame:
    """One row: the mean squared distance of scores to labels, and that of always giving the share of ones; nulls for no row."""
    y = F.col("label").cast("int")
    out = scored.where("score is not null and label is not null").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("score") - y, F.lit(2))).alias("brier"), F.avg(y).alias("share"))
    return out.select("n", "brier", (F.col("share") * (1 - F.col("share"))).alias("base"))
