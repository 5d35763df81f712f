"""Backward-only graph features, histories, fusion, calibration and evaluation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .ordered import ranked, running
from .spends import OUTPOINT, prevouts, resolve_inputs
from .windows import window_start


def chain_features(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """In- and out-degree, asymmetry, distinct previous transactions and backward depth up to two."""
    parents = tx_in.join(prevouts(tx_out), OUTPOINT, "left_semi").select("txid", F.col("prev_txid").alias("parent")).distinct()
    ins = tx_in.groupBy("txid").agg(F.count("*").alias("in_degree"), F.count_distinct("prev_txid").alias("prev_txs"))
    outs = tx_out.groupBy("txid").agg(F.count("*").alias("out_degree"))
    has = parents.select("txid").distinct()
    two = parents.join(has.withColumnRenamed("txid", "parent"), "parent", "left_semi").select("txid").distinct().withColumn("two", F.lit(1))
    out = outs.join(ins, "txid", "left").join(has.withColumn("one", F.lit(1)), "txid", "left").join(two, "txid", "left").fillna(0)
    return out.select("txid", "in_degree", "out_degree", ((F.col("out_degree") - F.col("in_degree")) / (F.col("out_degree") + F.col("in_degree"))).alias("asymmetry"), "prev_txs", (F.col("one") + F.col("two")).alias("depth"))


def history_table(tx_out: DataFrame, seconds: int = 900) -> DataFrame:
    """Per (address, window): events and value, how many windows, events and how much value came before, and the gap."""
    rows = tx_out.where("addr is not null").groupBy("addr", window_start(F.col("us"), F.lit(seconds)).alias("start_us")).agg(F.count("*").alias("events"), F.sum("amount").alias("value"))
    order = Window.partitionBy("addr").orderBy("start_us")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("addr", "start_us", "events", "value", (F.row_number().over(order) - 1).alias("prior_windows"), zero(F.sum("events").over(prior)).alias("prior_events"), zero(F.sum("value").over(prior)).alias("prior_value"), ((F.col("start_us") - F.lag("start_us").over(order)) / 1e6).alias("gap"))


def empirical_rate(history: DataFrame, strength: float = 4.0) -> DataFrame:
    """Empirical-Bayes rate of events a window: an address's own past shrunk towards the mean of all windows."""
    mean = history.agg(F.avg("events").alias("pop"))
    rate = (F.col("prior_events") + strength * F.col("pop")) / (F.col("prior_windows") + strength)
    return history.crossJoin(F.broadcast(mean)).withColumn("rate", rate).drop("pop")


def _log_factorial(k: Column) -> Column:
    """ln k! of a whole number: exact up to 20, by Stirling's series beyond."""
    x = k.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(k <= 20, F.log(F.factorial(F.least(k.cast("int"), F.lit(20))).cast("double"))).otherwise(series)


def poisson_surprise(k: Column, rate: Column) -> Column:
    """-ln P(X >= k) for a Poisson rate, from its logarithm at k on: right at any rate.

    Above the rate the tail is summed upwards, else what lies below k downwards; terms fall off within some square roots of k.
    """
    k, above = k.cast("long"), k > rate
    start = F.when(above, k).otherwise(k - 1)
    first = F.exp(start * F.log(rate) - rate - _log_factorial(start))
    steps = F.least(F.when(above, F.lit(1 << 20)).otherwise(start), (60 + 9 * F.sqrt(F.greatest(k.cast("double"), rate))).cast("long")).cast("int")
    grown = lambda acc, i: F.struct((acc.t * F.when(above, rate / (start + i)).otherwise((start - i + 1) / rate)).alias("t"), (acc.s + acc.t * F.when(above, rate / (start + i)).otherwise((start - i + 1) / rate)).alias("s"))
    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("t"), first.alias("s")), grown, lambda a: a.s)
    tail = F.when(k <= 0, 1.0).when(rate <= 0, 0.0).when(above, total).otherwise(1 - total)
    return -F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), tail)))


def complement_surprise(k: Column, rate: Column) -> Column:
    """-ln P(X >= k) as 1 minus the sum of what lies below k, in doubles, from 0 on: what SQL that says so gives to the last bit.

    A tail below some 1e-9 keeps few digits; poisson_surprise keeps them all. The C library's lgamma is the one SQL calls, math.lgamma is another approximation.
    """

    @F.pandas_udf("double")
    def surprise(ks, rates):
        import ctypes
        from math import exp, log

        import pandas as pd

        lgamma = ctypes.CDLL(None).lgamma
        lgamma.restype, lgamma.argtypes = ctypes.c_double, [ctypes.c_double]
        ks, out = ks.astype(int), []
        known = [lgamma(i + 1.0) for i in range(max(ks, default=0))]
        for k, r in zip(ks, rates):
            below, by = 0.0, log(r)
            for i in range(k):
                below += exp(-r + i * by - known[i])
            out.append(-log(max(1e-12, 1 - below)))
        return pd.Series(out, dtype=float)

    return surprise(k, rate)


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution, by the standard library, Arrow-batched."""

    @F.pandas_udf("double")
    def inv(values):
        from statistics import NormalDist

        return values.map(NormalDist().inv_cdf)

    return inv(p)


def stouffer(rows: DataFrame, layers: list[str], weights: list[float]) -> DataFrame:
    """Weighted Stouffer fusion of one-sided p-values against the reference; equal scores are ranked once."""
    out, norm = rows, sum(w * w for w in weights) ** 0.5
    for c in layers:
        counts = running(rows.groupBy(c).agg(F.count_if("is_ref").alias("n")), [F.desc(c)], {"above": "n"})
        p = (F.col("above") + 1) / (F.col("whole") + 1)
        ranks = counts.crossJoin(F.broadcast(rows.agg(F.count_if("is_ref").alias("whole")))).select(c, F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p)).alias(f"p_{c}"))
        out = out.join(ranks, c)
    z = sum(w * normal_quantile(1 - F.col(f"p_{c}")) for c, w in zip(layers, weights)) / norm
    return out.select("txid", z.alias("fused"))


def quantile(rows: DataFrame, column: str, q: float) -> DataFrame:
    """One row (value): the q-quantile between neighbours of a column's values, from one total a distinct value; null for none."""
    counts = running(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), [F.col(column)], {"_upto": "_n"})
    at = rows.agg(((F.count(column) - 1) * F.lit(q)).alias("_at"))
    low, high = (F.min(F.when(F.col("_upto") > f(F.col("_at")), F.col(column))) for f in (F.floor, F.ceil))
    return counts.crossJoin(F.broadcast(at)).agg(low.alias("lo"), high.alias("hi"), F.first(F.col("_at") - F.floor("_at")).alias("f")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("value"))


def stack_findings(rows: DataFrame, tx: DataFrame, layers: list[str], weights: list[float] | None = None, budget: float = 0.01, least: int = 50) -> DataFrame:
    """(entity_ref, start_us, end_us, score, rank): a finding for each transaction whose fused layers reach the reference's (1 - budget) quantile.

    rows has txid, is_ref and the layers; one layer is taken as it is, several are fused. A finding's window is its quarter of an hour. Ranks go by
    score, then time and txid. Fewer than `least` transactions give none.
    """
    fused = rows.select("txid", F.col(layers[0]).alias("fused")) if len(layers) == 1 else stouffer(rows, layers, weights or [1.0] * len(layers))
    fused = keep(fused.join(rows.select("txid", "is_ref"), "txid"), "fused")
    cut = quantile(fused.where("is_ref"), "fused", 1 - budget).crossJoin(rows.agg(F.count("*").alias("_n")))
    flagged = fused.crossJoin(F.broadcast(cut)).where((F.col("fused") >= F.col("value")) & (F.col("_n") >= least)).join(tx.select("txid", "us"), "txid")
    placed = ranked(flagged.select("txid", "fused", "us"), [F.desc("fused"), F.col("us"), F.col("txid")])
    start = window_start(F.col("us"), F.lit(900))
    return placed.select(F.concat(F.lit("tx:"), F.col("txid").cast("string")).alias("entity_ref"), start.alias("start_us"), (start + 900_000_000).alias("end_us"), F.col("fused").alias("score"), "rank")


def latest_labels(reviews: DataFrame, cutoff) -> DataFrame:
    """The last decision on each finding up to a time: confirmed 1, dismissed 0, anything else unknown."""
    last = reviews.where(F.col("us") <= cutoff).groupBy("finding").agg(F.max_by("decision", F.struct("us", "id")).alias("decision"))
    return last.select("finding", F.when(F.col("decision") == "confirmed", 1).when(F.col("decision") == "dismissed", 0).alias("label"))


def as_of(tx: DataFrame, tx_in: DataFrame, us) -> tuple[DataFrame, DataFrame]:
    """What was known at a time: later transactions and their spends are gone."""
    known = tx.where(F.col("us") <= us)
    return known, tx_in.join(known.select("txid"), "txid", "left_semi")


def as_of_outputs(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, us) -> DataFrame:
    """Outputs of transactions up to a time with the first spender that was known then; a later spend is none yet."""
    known, spends = as_of(tx, tx_in, us)
    first = spends.join(known.select("txid", "seq"), "txid").groupBy(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")).agg(F.min_by("txid", F.struct("seq", "vin")).alias("spent_by"))
    return tx_out.join(known.select("txid"), "txid", "left_semi").join(first, ["txid", "vout"], "left")


def stressed(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, network: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tx, tx_in, network) under a registered perturbation that knows nothing of labels; network has (txid, src_ip, asn, country), rows count in order of (us, txid).

    missing_network_prevouts: every fifth transaction has no network, every twentieth resolved input (by spender's place, vin) loses
    its output. timing_endpoint_skew: times fall to the minute, every fourth transaction has the first relay and system, every twentieth none.
    """
    placed = network.join(ranked(tx.select("txid", "us"), [F.col("us"), F.col("txid")], "place").select("txid", (F.col("place") - 1).alias("place")), "txid")
    every = lambda n: F.col("place") % n == 0
    if mode == "missing_network_prevouts":
        gone = placed.withColumns({c: F.when(~every(5), F.col(c)) for c in ("src_ip", "asn", "country")})
        spent = resolve_inputs(tx_in, tx_out).where("prev_us is not null").join(placed.select("txid", "place"), "txid")
        cut = ranked(spent.select("txid", "vin", "place"), [F.col("place"), F.col("txid"), F.col("vin")], "_i").where((F.col("_i") - 1) % 20 == 0).select("txid", "vin", F.lit(True).alias("_cut"))
        lost = tx_in.join(cut, ["txid", "vin"], "left").withColumns({c: F.when(F.col("_cut").isNull(), F.col(c)) for c in OUTPOINT}).drop("_cut")
        return tx, lost, gone.drop("place")
    if mode == "timing_endpoint_skew":
        least = placed.agg(F.min("src_ip").alias("_ip"), F.min("asn").alias("_asn"))
        skewed = placed.crossJoin(F.broadcast(least)).withColumns({"src_ip": F.when(every(20), F.lit(None)).when(every(4), F.col("_ip")).otherwise(F.col("src_ip")), "asn": F.when(every(4), F.col("_asn")).otherwise(F.col("asn"))})
        return tx.withColumn("us", F.floor(F.col("us") / 60_000_000) * 60_000_000), tx_in, skewed.drop("place", "_ip", "_asn")
    raise ValueError(f"no perturbation is named {mode}")


def perturb(rows: DataFrame, column: str, every: int, order: list[str]) -> DataFrame:
    """Every n-th row in order loses a column."""
    return ranked(rows, [F.col(c) for c in order], "_rn").withColumn(column, F.when(F.col("_rn") % every != 0, F.col(column))).drop("_rn")


def copies(rows: DataFrame, id_col: str, us_col: str, n: int, shift_us: int) -> DataFrame:
    """n copies with new ids and shifted times."""
    c = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("copy", c).withColumn(id_col, F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.col("copy").cast("string")), 256)).withColumn(us_col, F.col(us_col) + F.col("copy") * F.lit(shift_us).cast("long"))


def tx_flow(tx_in: DataFrame, tx_out: DataFrame, txid: int) -> DataFrame:
    """Counterparties of one transaction: where its inputs come from and its outputs go, and onward spends of each."""
    total = F.when(F.count_if(F.col("amount").isNull()) == 0, F.sum("amount"))
    ins = resolve_inputs(tx_in.where(F.col("txid") == txid), tx_out).select(F.col("prev_addr").alias("addr"), F.col("prev_amount").alias("amount")).groupBy("addr").agg(total.alias("amount"), F.count("*").alias("utxo_count")).withColumn("spent_count", F.col("utxo_count")).withColumn("side", F.lit("in"))
    spent = tx_in.select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")).where(F.col("txid") == txid).distinct().withColumn("spent", F.lit(1))
    outs = tx_out.where(F.col("txid") == txid).join(spent, ["txid", "vout"], "left").groupBy("addr").agg(total.alias("amount"), F.count("*").alias("utxo_count"), F.count("spent").alias("spent_count")).withColumn("side", F.lit("out"))
    return ins.unionByName(outs)


def family_strongest(signals: DataFrame) -> DataFrame:
    """Per address and family the strongest signal; of equal ones the later."""
    return signals.groupBy("addr", "family").agg(F.max(F.struct("score", "ord")).alias("m")).select("addr", "family", "m.score", "m.ord")


def evidence_check(refs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each reference against the receipts of its source: approved inside a received range, stale under another hash, else outside."""
    joined = refs.join(receipts, "source", "left")
    inside = F.col("n").between(F.col("start"), F.col("end"))
    state = F.max(F.when(F.col("start").isNull(), 0).when((F.col("hash") == F.col("received_hash")) & inside, 3).when((F.col("hash") != F.col("received_hash")) & inside, 2).otherwise(1)).alias("s")
    names = F.element_at(F.array(*map(F.lit, ("unknown_source", "outside_receipts", "stale_source_hash", "receipt_approved"))), F.col("s") + 1)
    return joined.groupBy("ref").agg(state).select("ref", names.alias("status"))


def window_findings(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Participation: how many distinct transactions a finding rests on."""
    return found.join(refs, ["addr", "seconds", "start_us"]).groupBy("addr", "seconds", "start_us", "rule").agg(F.count_distinct("txid").alias("participation"))
