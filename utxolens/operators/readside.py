"""What a reviewer reads: entities, endpoints, annotations, counts, pages, states and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import wallets, with_wallet
from .ordered import running
from .spends import linking_transactions, resolve_inputs


def entity_list(entities: DataFrame, least: int = 2, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities with enough addresses, largest first, and how many there are in all."""
    kept = entities.where(F.col("address_count") >= least)
    return kept.orderBy(F.desc("address_count"), "entity_id").offset(offset).limit(limit).crossJoin(F.broadcast(kept.agg(F.count("*").alias("total"))))


def entity_detail(clusters: DataFrame, tx_in: DataFrame, tx_out: DataFrame, tx: DataFrame, ref: str, addresses: int = 200, links: int = 100) -> DataFrame:
    """(part, item, us, total) of one entity, named by itself or an address of it: its first addresses and its linking transactions.

    An address in no entity is its own one row; a name that occurs nowhere gives none.
    """
    name = clusters.where((F.col("addr") == ref) | (F.col("entity_id") == ref)).select("entity_id").limit(1)
    own = clusters.join(F.broadcast(name), "entity_id", "left_semi").select("addr")
    spenders = resolve_inputs(tx_in, tx_out).select("txid", F.coalesce(F.expr("nullif(address, '')"), "prev_addr").alias("addr")).join(own, "addr", "left_semi").select("txid").distinct()
    linking = linking_transactions(tx_in, tx_out).where("not mixing").join(spenders, "txid", "left_semi").select("txid").join(tx.select("txid", "us"), "txid", "left")
    count = lambda df: F.broadcast(df.agg(F.count("*").alias("total")))
    a = own.orderBy("addr").limit(addresses).select(F.lit("address").alias("part"), F.col("addr").alias("item"), F.lit(None).cast("long").alias("us")).crossJoin(count(own))
    b = linking.orderBy(F.col("us").asc_nulls_last(), "txid").limit(links).select(F.lit("link").alias("part"), F.col("txid").cast("string").alias("item"), "us").crossJoin(count(linking))
    alone = tx_out.where(F.col("addr") == ref).select(F.lit("address").alias("part"), F.col("addr").alias("item"), F.lit(None).cast("long").alias("us"), F.lit(1).cast("long").alias("total")).limit(1)
    return a.unionByName(b).unionByName(alone.join(clusters.select(F.col("addr").alias("item")), "item", "left_anti").select("part", "item", "us", "total"))


def wallet_endpoints(tx_in: DataFrame, tx_out: DataFrame, obs: DataFrame, wallet: DataFrame) -> DataFrame:
    """(wallet, ip, spends): distinct observed spends of each wallet by relaying address; only inputs of observed transactions are resolved."""
    seen = obs.select("txid", F.col("src_ip").alias("ip")).distinct()
    spends = resolve_inputs(tx_in.join(seen.select("txid"), "txid", "left_semi"), tx_out).where("prev_addr is not null").select("txid", F.col("prev_addr").alias("addr"))
    return with_wallet(spends, wallet).select("wallet", "txid").distinct().join(seen, "txid").groupBy("wallet", "ip").agg(F.count("*").alias("spends"))


def endpoint_view(endpoints: DataFrame, ip: str, most: int = 50) -> DataFrame:
    """The wallets that spend most through one endpoint."""
    return endpoints.where(F.col("ip") == ip).orderBy(F.desc("spends"), "wallet").limit(most)


def top_endpoints(rollup: DataFrame, most: int = 25) -> DataFrame:
    return rollup.orderBy(F.desc("transactions"), "src_ip").limit(most)


def annotate_wallets(drawn: DataFrame, clusters: DataFrame, entities: DataFrame, risk: DataFrame) -> DataFrame:
    """Drawn addresses with their wallet, its entity's size (1 for an address alone) and its risk, if it has one."""
    named = wallets(clusters, drawn.select("addr").distinct())
    sized = named.join(entities.select(F.col("entity_id").alias("wallet"), "address_count"), "wallet", "left").join(risk.select("wallet", "risk"), "wallet", "left")
    return sized.select("addr", "wallet", F.coalesce("address_count", F.lit(1)).alias("address_count"), "risk")


def open_counts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """How many open findings each drawn node has, 0 for none."""
    counts = found.where(F.col("status") != "dismissed").groupBy("node").agg(F.count("*").alias("open"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open"))


def findings_for(found: DataFrame, refs: DataFrame, most: int = 100) -> DataFrame:
    """The best findings of a set of references."""
    return found.join(refs, "node", "left_semi").orderBy(F.desc("score"), "id").limit(most)


def cluster_caution(entities: DataFrame, least: int = 1000, share: float = 0.1) -> DataFrame:
    """Entities so large that one wrong link may have made them: `least` addresses, or that share of all clustered ones."""
    total = entities.agg(F.sum("address_count").alias("clustered"))
    return entities.crossJoin(F.broadcast(total)).select("entity_id", "address_count", (F.col("address_count") >= F.greatest(F.lit(float(least)), share * F.col("clustered"))).alias("caution"))


def latest_of(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*key, "r.*")


def analysis_state(stages: DataFrame, required: list[str]) -> DataFrame:
    """(job, state): complete where every required stage's last row succeeded, failed where one failed, running where one runs, degraded where only others failed, else unknown."""
    last = latest_of(stages, ["job", "stage"], ["us", "id"], ["status"])
    need = F.col("stage").isin(*required)
    a = last.groupBy("job").agg(F.count_if(need & (F.col("status") == "success")).alias("done"), F.count_if(need & (F.col("status") == "failed")).alias("lost"), F.count_if(F.col("status") == "running").alias("runs"), F.count_if(~need & (F.col("status") == "failed")).alias("other"))
    state = F.when(F.col("lost") > 0, "failed").when((F.col("done") == len(required)) & (F.col("other") > 0), "degraded").when(F.col("done") == len(required), "complete").when(F.col("runs") > 0, "running").otherwise("unknown")
    return a.select("job", state.alias("state"))


def progress(rows: DataFrame, spans: dict[str, tuple[float, float]]) -> Column:
    """Percent done: a stage's span of the whole, entered by the share of it that was seen."""
    out = F.lit(None).cast("double")
    for stage, (start, end) in spans.items():
        share = F.least(F.lit(1.0), F.coalesce(F.try_divide("seen", "total"), F.lit(0.0)))
        out = F.when(F.col("stage") == stage, (start + (end - start) * share) * 100).otherwise(out)
    return out


def top_contributions(rows: DataFrame, key: str, columns: list[str], k: int = 3) -> DataFrame:
    """The k largest contributions of each row, as name:value text, ties by name."""
    parts = F.array(*[F.struct((-F.col(c).cast("double")).alias("v"), F.lit(c).alias("c")) for c in columns])
    best = F.slice(F.array_sort(parts), 1, k)
    return rows.select(key, F.concat_ws(",", F.transform(best, lambda p: p.c)).alias("top"))


def page_with_totals(found: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in workflow order (escalated first, dismissed last, then round robin over families) with totals of all and of open findings."""
    band = F.when(F.col("status") == "escalated", 0).when(F.col("status") == "dismissed", 2).otherwise(1)
    rows = found.withColumn("band", band).withColumn("family_rank", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("score"), "id")))
    totals = found.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "dismissed").alias("open_total"))
    return rows.orderBy("band", "family_rank", "rule", "id").offset(offset).limit(limit).crossJoin(F.broadcast(totals))


def keep_budget(scored: DataFrame, key: str, budget: float) -> DataFrame:
    """The ceil(n * budget) best rows, one at least, ties by key: rows above the cut by score, ties at the cut by key."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    up = running(counts, [F.desc("score")], {"through": "n"}).crossJoin(F.broadcast(scored.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(budget))).alias("most"))))
    placed = scored.join(up.select("score", (F.col("most") - (F.col("through") - F.col("n"))).alias("room")).where("room > 0"), "score")
    return placed.withColumn("at", F.row_number().over(Window.partitionBy("score").orderBy(key))).where("at <= room").drop("at", "room")


def path_signals(paths: DataFrame, found: DataFrame) -> DataFrame:
    """(id, share): how much of a finding's path consists of nodes that other open findings of its case are about."""
    nodes = paths.select("id", "case", F.explode(F.array_distinct("nodes")).alias("node"))
    # One row a node: whether there is another than a given finding shows in the least and the greatest.
    about = found.where("status <> 'dismissed'").groupBy("case", F.col("entity_ref").alias("node")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    hits = nodes.join(about, ["case", "node"]).where("low <> id or high <> id").groupBy("id").agg(F.count("*").alias("hits"))
    sizes = nodes.groupBy("id").agg(F.count("*").alias("n"))
    return sizes.join(hits, "id", "left").select("id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("share"))


def page_merge(pages: DataFrame, most: int = 500) -> DataFrame:
    """Pages of nodes merged by id: an id keeps its first place and its last value; `most` nodes at most."""
    merged = pages.groupBy("node").agg(F.min("at").alias("first_at"), F.max_by("value", "at").alias("value"))
    return merged.orderBy("first_at", "node").limit(most)


def induced_edges(edges: DataFrame, window: DataFrame) -> DataFrame:
    """Edges whose two ends are in a window of nodes."""
    inside = window.select("node")
    a = edges.join(inside.withColumnRenamed("node", "from_node"), "from_node", "left_semi")
    return a.join(inside.withColumnRenamed("node", "to_node"), "to_node", "left_semi")


def split_overlap(rows: DataFrame, member: str, split: str) -> DataFrame:
    """Pairs of splits and how many members both hold."""
    pairs = rows.select(member, split).distinct()
    other = pairs.withColumnRenamed(split, "other")
    return pairs.join(other, member).where(F.col(split) < F.col("other")).groupBy(split, "other").agg(F.count("*").alias("shared"))


def poisoned_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Totals that are unknown where one part is."""
    return rows.groupBy(key).agg(F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias("total"))


def counterparties(flows: DataFrame, most: int = 20) -> DataFrame:
    """Flows of one node, largest first, unknown amounts last, then by name; with how many were left out."""
    n = flows.agg(F.greatest(F.lit(0), F.count("*") - most).alias("truncated"))
    return flows.orderBy(F.desc_nulls_last("amount"), "party").limit(most).crossJoin(F.broadcast(n))


def group_quality(members: DataFrame) -> DataFrame:
    """(verdicts, one row): groups of one label, mixed ones, unknown ones, labels that several groups share, and evaluable groups' share.

    members is (group, label); a null label is unknown.
    """
    g = members.groupBy("group").agg(F.count_distinct("label").alias("labels"), F.count_if(F.col("label").isNull()).alias("unknown"))
    split = members.where("label is not null").groupBy("label").agg(F.count_distinct("group").alias("g")).agg(F.count_if(F.col("g") > 1).alias("split_labels"))
    out = g.agg(F.count_if((F.col("labels") == 1) & (F.col("unknown") == 0)).alias("pure"), F.count_if(F.col("labels") > 1).alias("mixed"), F.count_if(F.col("labels") == 0).alias("unknown"), F.count("*").alias("groups"))
    return out.crossJoin(split)
