"""Address-time windows, their histories, rule findings and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _dealt, ranked, running
from .spends import rapid_spends, window_start

SPANS = (900, 3600, 86400)


def memberships(tx_out: DataFrame) -> DataFrame:
    """Each output in the three epoch-aligned windows of its transaction's time: one row for each span."""
    spans = F.explode(F.array(*map(F.lit, SPANS)))
    rows = tx_out.where("addr is not null and us is not null").select("addr", "txid", "vout", "amount", "us", spans.alias("seconds"))
    return rows.withColumn("start_us", window_start(F.col("us"), F.col("seconds")))


def window_features(members: DataFrame) -> DataFrame:
    """Counts and value distribution of each (address, span, window)."""
    return members.groupBy("addr", "seconds", "start_us").agg(
        F.count("*").alias("outputs"), F.count_distinct("txid").alias("transactions"), F.min("amount").alias("min_value"),
        F.max("amount").alias("max_value"), F.sum("amount").alias("total_value"), F.median("amount").alias("median_value"))


def gap_features(members: DataFrame) -> DataFrame:
    """Gaps in seconds between the distinct times of a window."""
    w = Window.partitionBy("addr", "seconds", "start_us").orderBy("us")
    times = members.select("addr", "seconds", "start_us", "us").distinct().withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1e6)
    return times.where("gap is not null").groupBy("addr", "seconds", "start_us").agg(F.count("*").alias("gaps"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"))


def address_history(features: DataFrame) -> DataFrame:
    """Strictly earlier windows only: how many, gap to the last, mean counts and values, and surges over them."""
    order = Window.partitionBy("addr", "seconds").orderBy("start_us")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(order) - 1
    count, value = F.sum("transactions").over(prior) / F.nullif(n, F.lit(0)), F.sum("total_value").over(prior) / F.nullif(n, F.lit(0))
    return features.select(
        "addr", "seconds", "start_us", "transactions", "total_value", n.alias("prior_windows"),
        ((F.col("start_us") - F.lag("start_us").over(order)) / 1e6).alias("gap_seconds"), count.alias("baseline_count"), value.alias("baseline_value"),
        (F.col("transactions") / F.nullif(count, F.lit(0.0))).alias("surge_count"), (F.col("total_value") / F.nullif(value, F.lit(0.0))).alias("surge_value"))


def count_rule(features: DataFrame, rule: str, least: int, base: int, each: int, seconds: int) -> DataFrame:
    """Windows with enough transactions, scored base + each * transactions up to 100."""
    return features.where((F.col("seconds") == seconds) & (F.col("transactions") >= least)).select("addr", "seconds", "start_us", F.lit(rule).alias("rule"), F.least(F.lit(100), F.lit(base) + each * F.col("transactions")).cast("double").alias("score"), "transactions")


def rapid_redistribution(features: DataFrame, rapid: DataFrame, least: int, seconds: int) -> DataFrame:
    """Rapid spends keyed by the window of the spend, where that window also took in enough transactions."""
    key = ["addr", "seconds", "start_us"]
    spent = rapid.select(F.col("address").alias("addr"), F.lit(seconds).alias("seconds"), window_start(F.col("spent_us"), F.lit(seconds)).alias("start_us"), "delay_us")
    events = spent.groupBy(*key).agg(F.count("*").alias("events"), (F.min("delay_us") / 1e6).alias("shortest_delay"), (F.median("delay_us") / 1e6).alias("median_delay"))
    return features.where((F.col("seconds") == seconds) & (F.col("transactions") >= least)).join(events, key).select(*key, "transactions", "events", "shortest_delay", "median_delay", F.least(F.lit(100), 45 + 10 * F.col("events")).cast("double").alias("score"))


def findings(tx_out: DataFrame, tx_in: DataFrame, tx: DataFrame) -> DataFrame:
    """The window rules' findings over all three spans."""
    f = window_features(memberships(tx_out))
    parts = []
    for seconds in SPANS:
        parts += [count_rule(f, "concentrated_collection", 3, 25, 15, seconds), count_rule(f, "emerging_hub", 4, 20, 10, seconds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily_collapse(found: DataFrame) -> DataFrame:
    """One primary per (address, rule, UTC day): highest score, most transactions, narrowest window; the others are listed as seconds:start.

    A day has 121 windows at most, so a group's list is bounded.
    """
    day = window_start(F.col("start_us"), F.lit(86400))
    primary = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("transactions")).alias("t"), "seconds", "start_us")).alias("p")
    listed = F.array_sort(F.collect_list(F.struct("seconds", "start_us"))).alias("all")
    groups = found.groupBy("addr", "rule", day.alias("day")).agg(primary, listed)
    others = F.filter("all", lambda w: (w.seconds != F.col("p.seconds")) | (w.start_us != F.col("p.start_us")))
    names = F.array_join(F.transform(others, lambda w: F.concat_ws(":", w.seconds.cast("string"), w.start_us.cast("string"))), ",")
    return groups.select("addr", "p.seconds", "p.start_us", "rule", (-F.col("p.s")).alias("score"), (-F.col("p.t")).alias("transactions"), F.size(others).cast("long").alias("matched_windows"), names.alias("matched"))


def dedupe_and_rank(found: DataFrame, key: list[str], score: str, ties: list[Column]) -> DataFrame:
    """Keep each key's highest score (first by ties), then rank all by score."""
    first = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    kept = found.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return ranked(kept, [F.desc(score), *ties]).withColumn("rank", F.col("rank").cast("int"))


def trailing_count(rows: DataFrame, key: str, us: str, seconds: int, name: str) -> DataFrame:
    """rows with log1p of how many rows of their key lie in the half-open window of `seconds` before; equal times never see each other, null keys see none.

    A row counts from its time until it expires, so a running total over (key, time) is back at zero where the next key begins: no task holds a key.
    """
    counts = rows.where(F.col(key).isNotNull() & F.col(us).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(us).alias("_t")).agg(F.count("*").alias("_n"))
    events = counts.select("_k", "_t", "_n", F.lit(True).alias("_own")).union(counts.select("_k", F.col("_t") + seconds * 1_000_000, -F.col("_n"), F.lit(False)))
    steps = events.groupBy("_k", "_t").agg(F.sum("_n").alias("_d"), F.bool_or("_own").alias("_own"))
    seen = running(steps, [F.col("_k"), F.col("_t")], {"_up": "_d"}).where("_own")
    # What began before a time and has not expired before it: the total up to it, less what changes then.
    seen = seen.select(F.col("_k").alias(key), F.col("_t").alias(us), (F.col("_up") - F.col("_d")).alias("_seen"))
    return rows.join(seen, [key, us], "left").withColumn(name, F.log1p(F.coalesce("_seen", F.lit(0)).cast("double"))).drop("_seen")


def prior_index(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with how many rows of their key come before; null keys are one key. Places over (key, order) less the place where a key begins."""
    starts = running(rows.groupBy(key).agg(F.count("*").alias("_n")), [F.col(key)], {"_up": "_n"}).select(F.col(key).alias("_k"), (F.col("_up") - F.col("_n")).alias("_start"))
    placed = ranked(rows, [F.col(key), *[F.col(c) for c in order]], "_place")
    return placed.join(starts, F.col(key).eqNullSafe(F.col("_k"))).withColumn(name, F.col("_place") - 1 - F.col("_start")).drop("_place", "_k", "_start")


def expanding_rarity(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """-ln((earlier rows of the key + 1) / (earlier rows + classes))."""
    classes = rows.agg(F.count_distinct(key).alias("classes"))
    placed = prior_index(ranked(rows, [F.col(c) for c in order], "prior_all").withColumn("prior_all", F.col("prior_all") - 1), key, order, "prior_key")
    return placed.crossJoin(F.broadcast(classes)).withColumn("rarity", -F.log((F.col("prior_key") + 1) / (F.col("prior_all") + F.greatest(F.col("classes"), F.lit(1)))))


def recipient_history(tx_out: DataFrame) -> DataFrame:
    """For each transaction, how its recipients were paid strictly before: coverage, share seen before, mean count, longest span."""
    pairs = tx_out.where("addr is not null").groupBy("txid", "addr").agg(F.min("us").alias("us"))
    # Pairs lie in ranges of (address, time): a busy address is not one task, and equal times of an address share a range.
    cut = _dealt(pairs, [F.col("addr"), F.col("us")])
    earlier = Window.partitionBy("_part", "addr").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    past = {"_n": F.count("*").over(earlier), "_first": F.min("us").over(earlier), "_last": F.max("us").over(earlier)}
    # Only an address that goes on from range to range takes something over: two addresses a range at most, its first and its last.
    ends = cut.groupBy("_part").agg(F.min("addr").alias("low"), F.max("addr").alias("high")).select("_part", F.explode(F.array_distinct(F.array("low", "high"))).alias("addr"))
    ends = cut.join(F.broadcast(ends), ["_part", "addr"]).groupBy("addr", "_part").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))
    parts = Window.partitionBy("addr").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = ends.select("_part", "addr", F.sum("n").over(parts).alias("_c"), F.min("first").over(parts).alias("_c_first"), F.max("last").over(parts).alias("_c_last")).where("_c is not null")
    seen = cut.select("txid", "addr", "us", "_part", *[c.alias(n) for n, c in past.items()]).join(F.broadcast(over), ["_part", "addr"], "left")
    n = F.col("_n") + F.coalesce("_c", F.lit(0))
    seen = seen.select("txid", n.alias("n"), ((F.coalesce("_last", "_c_last") - F.coalesce("_c_first", "_first")) / 1e6).alias("span"))
    return seen.groupBy("txid").agg(F.count("*").alias("recipients"), F.avg((F.col("n") > 0).cast("double")).alias("prior_fraction"), F.avg("n").alias("mean_prior_count"), F.coalesce(F.max("span"), F.lit(0.0)).alias("max_span"))


def window_vectors(tx_out: DataFrame, tx_in: DataFrame, tx: DataFrame, seconds: int = 900, signals: DataFrame | None = None, coinjoins: DataFrame | None = None) -> DataFrame:
    """(entity_ref, window_start, features): everything known of an address in a window, nested as the flat features expect it.

    Outgoing are the transactions that spend within the hour what the address got, by the window of the spend; the component is the
    address, its transactions and the outputs it received. `signals` (entity_ref, first_us, score, hops, duration) and `coinjoins` (txid, score,
    equal_outputs, equal_value) add the strongest of each; without them those numbers are 0.
    """
    key = ["addr", "start_us"]
    span = F.lit(seconds)
    members = memberships(tx_out).where(F.col("seconds") == seconds)
    base = window_features(members).drop("seconds")
    rapid = rapid_spends(tx_in, tx_out, tx).select(F.col("address").alias("addr"), window_start(F.col("spent_us"), span).alias("start_us"), "txid")
    outgoing = rapid.groupBy(*key).agg(F.count("*").alias("rapid"), F.count_distinct("txid").alias("out_txs"))
    paid = rapid.distinct().join(tx_out.select("txid", "amount"), "txid").groupBy(*key).agg(
        F.count("*").alias("n_out"), F.struct(F.min("amount").alias("min_sats"), F.max("amount").alias("max_sats"), F.median("amount").alias("median_sats"), F.sum("amount").alias("total_sats")).alias("paid"))
    touched = members.select(*key, "txid").union(rapid.select(*key, "txid")).distinct().groupBy(*key).agg(F.count("*").alias("txs"))
    gaps = gap_features(members).drop("seconds")
    past = address_history(window_features(members)).drop("seconds", "transactions", "total_value")
    rows = base
    for other in (outgoing, paid, touched, gaps, past):
        rows = rows.join(other, key, "left")
    if signals is not None:
        s = signals.where("entity_ref like 'address:%'").select(F.substring("entity_ref", 9, 1 << 20).alias("addr"), window_start(F.col("first_us"), span).alias("start_us"), F.struct("score", "hops", "duration").alias("s"))
        rows = rows.join(s.groupBy(*key).agg(F.max("s").alias("peel")), key, "left")
    if coinjoins is not None:
        c = members.select(*key, "txid").distinct().join(coinjoins, "txid").groupBy(*key).agg(F.max(F.struct("score", "equal_outputs", "equal_value")).alias("mix"), F.count("*").alias("mixes"))
        rows = rows.join(c, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    peel = lambda n: zero(F.col(f"peel.{n}")) if signals is not None else F.lit(0)
    mix = lambda n: zero(F.col(n)) if coinjoins is not None else F.lit(0)
    features = F.struct(
        F.col("transactions").alias("in_event_count"), zero(F.col("out_txs")).alias("out_event_count"), F.col("outputs").alias("received_output_count"), zero(F.col("n_out")).alias("outgoing_output_count"), F.col("transactions").alias("observed_counterparties"),
        F.struct(F.col("min_value").alias("min_sats"), F.col("max_value").alias("max_sats"), F.col("median_value").alias("median_sats"), F.col("total_value").alias("total_sats")).alias("received_value_distribution_sats"), F.col("paid").alias("outgoing_value_distribution_sats"),
        F.struct(zero(F.col("gaps")).alias("count"), F.col("min_gap").alias("minimum_seconds"), F.col("max_gap").alias("maximum_seconds"), F.col("median_gap").alias("median_seconds")).alias("inter_event_gaps_seconds"),
        F.struct((1 + F.col("txs") + F.col("outputs")).alias("node_delta"), (2 * F.col("outputs") + zero(F.col("rapid"))).alias("edge_delta"), zero(F.col("rapid")).alias("resolved_spend_edge_delta")).alias("bounded_component_change"),
        (F.col("prior_windows") == 0).alias("first_observed_activity"), F.col("gap_seconds").alias("prior_window_gap_seconds"), F.col("baseline_count").alias("baseline_in_event_count_mean"), F.col("surge_count").alias("activity_surge_ratio"),
        F.col("baseline_value").alias("baseline_value_sats_mean"), F.col("surge_value").alias("value_surge_ratio"), peel("score").alias("peeling_chain_score"), peel("hops").alias("peeling_chain_length"), peel("duration").alias("peeling_chain_total_duration_sec"), peel("hops").alias("peeling_chain_evidence_count"),
        mix("mix.score").alias("coinjoin_like_score"), mix("mix.equal_outputs").alias("equal_output_count"), (F.col("mix.equal_value") if coinjoins is not None else F.lit(None).cast("long")).alias("equal_output_value_sats"), mix("mixes").alias("coinjoin_like_evidence_count"))
    return rows.select(F.concat(F.lit("address:"), "addr").alias("entity_ref"), F.col("start_us").alias("window_start"), features.alias("features"))


def recurrent_recipients(tx_out: DataFrame, chosen: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(txid, addr, prior_transactions, first_us, last_us, first_txid, last_txid): what speaks against a novel recipient.

    Of each chosen transaction the `most` recipients that most strictly earlier transactions paid, `least` at least, with the first and the last of those.
    """
    pairs = tx_out.where("addr is not null").groupBy("txid", "addr").agg(F.min("us").alias("us"))
    wanted = pairs.join(chosen.select("txid"), "txid", "left_semi").select("addr").distinct()
    before = Window.partitionBy("addr").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    stamp = F.struct("us", "txid")
    seen = pairs.join(wanted, "addr", "left_semi").select("txid", "addr", F.count("*").over(before).alias("prior_transactions"), F.min(stamp).over(before).alias("a"), F.max(stamp).over(before).alias("z"))
    seen = seen.join(chosen.select("txid"), "txid", "left_semi").where(F.col("prior_transactions") >= least)
    place = F.row_number().over(Window.partitionBy("txid").orderBy(F.desc("prior_transactions"), "addr"))
    return seen.withColumn("i", place).where(F.col("i") <= most).select("txid", "addr", "prior_transactions", F.col("a.us").alias("first_us"), F.col("z.us").alias("last_us"), F.col("a.txid").alias("first_txid"), F.col("z.txid").alias("last_txid"))
