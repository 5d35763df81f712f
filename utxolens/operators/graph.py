"""Property graph, components, walks, neighbourhoods, flows and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, keep
from .spends import OUTPOINT, linking_transactions, prevouts, resolve_inputs, spend_resolution, unique_spends


def _tx(c):
    return F.concat(F.lit("tx:"), F.col(c).cast("string"))


def _out(t, v):
    return F.concat(F.lit("out:"), F.col(t).cast("string"), F.lit(":"), F.col(v).cast("string"))


def graph_nodes(tx: DataFrame, tx_out: DataFrame, obs: DataFrame) -> DataFrame:
    """Nodes of all five types; the first phase that names a node gives its type."""
    named = lambda df, node, kind, phase: df.select(node.alias("node_id"), F.lit(kind).alias("node_type"), F.lit(phase).alias("phase"))
    parts = [
        named(tx, _tx("txid"), "transaction", 0), named(tx_out, _tx("txid"), "transaction", 1), named(tx_out, _out("txid", "vout"), "output", 1),
        named(tx_out.where("addr is not null"), F.concat(F.lit("address:"), "addr"), "address_or_script", 1),
        named(obs, F.concat(F.lit("obs:"), F.col("obs_id").cast("string")), "network_observation", 2), named(obs, _tx("txid"), "transaction", 2),
        named(obs, F.concat(F.lit("endpoint:"), "src_ip"), "network_endpoint", 2), named(obs, F.concat(F.lit("endpoint:"), "dst_ip"), "network_endpoint", 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node_id").agg(F.min_by("node_type", "phase").alias("node_type"))


def edge_ends(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, obs: DataFrame) -> DataFrame:
    """Edges without ids, some more than once; spends are those the first-spender rule resolves."""
    edge = lambda df, a, b, kind: df.select(a.alias("from_node"), b.alias("to_node"), F.lit(kind).alias("edge_type"))
    o = F.concat(F.lit("obs:"), F.col("obs_id").cast("string"))
    resolved = spend_resolution(tx_in, tx_out, tx).where("status = 'resolved'")
    parts = [
        edge(tx_out, _tx("txid"), _out("txid", "vout"), "CREATES_OUTPUT"), edge(tx_out.where("addr is not null"), _out("txid", "vout"), F.concat(F.lit("address:"), "addr"), "LOCKED_TO"),
        edge(resolved, _out("prev_txid", "prev_vout"), _tx("txid"), "SPENT_BY"), edge(obs, o, _tx("txid"), "OBSERVED_TX"),
        edge(obs, o, F.concat(F.lit("endpoint:"), "src_ip"), "SEEN_FROM"), edge(obs, o, F.concat(F.lit("endpoint:"), "dst_ip"), "SEEN_TO")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_ids(edges: DataFrame) -> DataFrame:
    return edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.sha2(F.concat_ws("|", "from_node", "to_node", "edge_type"), 256))


def graph_edges(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, obs: DataFrame) -> DataFrame:
    """Edges with their ids."""
    return _with_ids(edge_ends(tx, tx_in, tx_out, obs).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node reached over edges (a, b) of any orderable type, by contraction in random orders.

    Nodes become 64-bit numbers that are checked to be distinct; nodes that are longs are their own. In each round a node takes the first of itself and its neighbours
    in an order drawn for that round, and edges go on between what was taken: about half of a path's nodes are left, fewer where
    nodes have more neighbours, so all rounds together are a few times the first. A round is one shuffle of both directions, which drops what is there twice, and one join;
    it is written once to the shared folder: plans stay short and lost executors are survived. No join is broadcast, so nothing of the tables passes through the driver. Loops and edges with a null end are ignored.
    """
    ends, seed, names = edges.where("a <> b").select("a", "b"), 0, None
    numbered = {t for _, t in ends.dtypes} == {"bigint"}
    number = lambda c: F.col(c) if numbered else F.xxhash64(F.lit(seed), F.col(c))
    if not numbered:
        ends = keep(ends, "ends")
    while not numbered:
        names = keep(ends.select(number("a").alias("id"), F.col("a").alias("node")).unionByName(ends.select(number("b").alias("id"), F.col("b").alias("node"))).distinct(), "names")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            break
        forget(names)
        seed += 1
    links, each, rounds = ends.select(number("a").alias("a"), number("b").alias("b")), Window.partitionBy("a"), []
    taken = lambda near: near.where("first").select("a", "rep")
    while True:
        place = lambda c: F.xxhash64(F.lit(len(rounds)), F.col(c))
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = links.select(ways.alias("way")).select("way.*").repartition("a").distinct()
        both = both.withColumns({"best": F.min_by("b", place("b")).over(each), "first": F.min("b").over(each) == F.col("b")}).where("a > b or first")
        near = keep(both.select("a", "b", F.when(place("best") < place("a"), F.col("best")).otherwise(F.col("a")).alias("rep"), "first"), "near")
        if near.isEmpty():
            break
        rounds.append(near)
        other = taken(near).select(F.col("a").alias("b"), F.col("rep").alias("other"))
        links = near.where("a > b").select("b", "rep").join(other.hint("merge"), "b").where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    if not numbered:
        forget(ends)
    if not rounds:
        return near.select(F.col("a").alias("node"), F.col("b").alias("root")) if numbered else names.select("node", F.col("node").alias("root"))
    label = keep(taken(rounds[-1]), "taken")
    forget(near, rounds.pop())
    while rounds:
        last, near = label, rounds.pop()
        label = keep(taken(near).join(last.select(F.col("a").alias("rep"), F.col("rep").alias("top")).hint("merge"), "rep", "left").select("a", F.coalesce("top", "rep").alias("rep")), "taken")
        forget(last, near)
    if numbered:
        named = label.withColumnRenamed("a", "node")
    else:
        named = keep(names.join(label.withColumnRenamed("a", "id").hint("merge"), "id").select("node", "rep"), "named")
        forget(names, label)
    return named.join(named.groupBy("rep").agg(F.min("node").alias("root")).hint("merge"), "rep").select("node", "root")


def common_input_clusters(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """(addr, entity_id): addresses that spend together, mixing-like transactions left out; named after the smallest."""
    own = F.coalesce(F.expr("nullif(address, '')"), F.col("prev_addr"))
    # One shuffle by transaction serves the counts and the distinct addresses; equal outputs count from three inputs on.
    spenders = resolve_inputs(tx_in, tx_out).select("txid", own.alias("addr")).repartition("txid").groupBy("txid", "addr").agg(F.count("*").alias("n"))
    each = Window.partitionBy("txid")
    spenders = spenders.withColumns({"n_in": F.sum("n").over(each), "n_addr": F.count("addr").over(each)}).where("n_addr >= 2 and addr is not null")
    equal = tx_out.select("txid", F.coalesce("amount", F.lit(0)).alias("amount")).repartition("txid").groupBy("txid", "amount").agg(F.count("*").alias("n")).where("n >= 3").select("txid").distinct()
    mixing = equal.withColumn("equal", F.lit(True))
    linked = spenders.join(mixing, "txid", "left").where("n_in < 3 or equal is null").select("txid", "addr")
    # A transaction stands for its addresses: only those of several transactions link, and an address is where its first transaction is.
    held = keep(linked.withColumn("home", F.min("txid").over(Window.partitionBy("addr"))), "spenders")
    found = components(held.where("home <> txid").select(F.col("home").alias("a"), F.col("txid").alias("b")))
    homes = held.where("home = txid").select("addr", "home")
    tops = keep(homes.groupBy("home").agg(F.min("addr").alias("low")).join(found.withColumnRenamed("node", "home"), "home", "left").select("home", "low", F.coalesce("root", "home").alias("root")), "homes")
    names = tops.groupBy("root").agg(F.min("low").alias("name"))
    entity = tops.join(names, "root").select("home", F.concat(F.lit("E-"), F.substring(F.md5(F.col("name").cast("binary")), 1, 12)).alias("entity_id"))
    return homes.join(entity, "home").select("addr", "entity_id")


def entity_rollup(clusters: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Members, received and sent values and times of each entity."""
    recv = tx_out.join(clusters, "addr").groupBy("entity_id").agg(F.count("*").alias("received_outputs"), F.sum("amount").alias("received"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    sent = resolve_inputs(tx_in, tx_out).withColumn("addr", F.col("prev_addr")).join(clusters, "addr").groupBy("entity_id").agg(F.sum("prev_amount").alias("sent"))
    members = clusters.groupBy("entity_id").agg(F.count("*").alias("address_count"))
    return members.join(recv, "entity_id", "left").join(sent, "entity_id", "left").select("entity_id", "address_count", F.coalesce("received_outputs", F.lit(0)).alias("received_outputs"), F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("sent", F.lit(0)).alias("sent"), "first_us", "last_us")


def wallets(clusters: DataFrame, addresses: DataFrame) -> DataFrame:
    """addr to wallet: its entity, or itself."""
    return addresses.join(clusters, "addr", "left").select("addr", F.coalesce("entity_id", "addr").alias("wallet"))


def peeling_hops(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Uniquely spent outpoints and where they go on: the spender's largest uniquely spent output smaller than what was spent."""
    spent = unique_spends(tx_in).join(prevouts(tx_out).select(*OUTPOINT, "prev_amount"), OUTPOINT)
    nxt = spent.select(F.col("prev_txid").alias("spend_txid"), F.col("prev_vout").alias("c_vout"), F.col("prev_amount").alias("c_amount"))
    joined = spent.join(nxt, "spend_txid", "left")
    smaller = F.when(F.col("c_amount") < F.col("prev_amount"), F.struct((-F.col("c_amount")).alias("k"), "c_vout"))
    return joined.groupBy(*OUTPOINT, "spend_txid", "prev_amount").agg(F.min(smaller).alias("best")).select(*OUTPOINT, "spend_txid", F.col("prev_amount").alias("amount"), F.col("best.c_vout").alias("next_vout"))


def doubled_walks(hops: DataFrame, item, longest: int) -> DataFrame:
    """(start_txid, start_vout, walk): `item` of a hop and of the hops it leads to, `longest` at most, from the lowest start of every (spend_txid, next_vout).

    Where a walk goes hangs on its first hop's spender and next output alone, and so must `item`: hops that share them are one row. Each has one successor, so the
    table never grows; each round joins every walk with the one that begins where it ends, which doubles its length: three joins for eight hops.
    """
    v = F.coalesce("next_vout", F.lit(-1))
    first = keep(hops.groupBy(F.col("spend_txid").alias("t0"), v.alias("v0")).agg(F.min(F.struct("prev_txid", "prev_vout")).alias("start"), F.min(item).alias("item")), "starts")
    after = hops.select(F.col("prev_txid").alias("t0"), F.col("prev_vout").alias("v0"), F.col("spend_txid").alias("t"), v.alias("v"))
    walks, length = first.join(after, ["t0", "v0"], "left").select("t0", "v0", F.array("item").alias("walk"), "t", "v"), 1
    while length < longest:
        rest = walks.select(F.col("t0").alias("t"), F.col("v0").alias("v"), F.col("walk").alias("more"), F.col("t").alias("t2"), F.col("v").alias("v2"))
        both = F.when(F.col("more").isNull(), F.col("walk")).otherwise(F.concat("walk", "more"))
        walks = keep(walks.join(rest, ["t", "v"], "left").select("t0", "v0", both.alias("walk"), F.col("t2").alias("t"), F.col("v2").alias("v")), "walks")
        length *= 2
    starts = first.select("t0", "v0", F.col("start.prev_txid").alias("start_txid"), F.col("start.prev_vout").alias("start_vout"))
    return walks.join(starts, ["t0", "v0"]).select("start_txid", "start_vout", F.slice("walk", 1, longest).alias("walk"))


def peeling_walks(hops: DataFrame, longest: int = 8, shortest: int = 3) -> DataFrame:
    """Walks along hops from every spent outpoint; of walks over the same transactions the lowest start stays."""
    out = doubled_walks(keep(hops, "hops"), F.col("spend_txid"), longest).withColumnRenamed("walk", "path")
    first = F.min(F.struct("start_txid", "start_vout")).alias("s")
    return out.where(F.size("path") >= shortest).groupBy("path").agg(first).select("s.start_txid", "s.start_vout", F.size("path").alias("hops"), F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def coinjoin_like(tx_in: DataFrame, tx_out: DataFrame, least: int = 3, tolerance: int = 0) -> DataFrame:
    """Transactions with enough inputs, outputs and equal output values (the smallest and up to `tolerance` more); largest group, then smaller value."""
    n_in = tx_in.groupBy("txid").agg(F.count("*").alias("n_in")).where(F.col("n_in") >= least)
    groups = tx_out.groupBy("txid", "amount").agg(F.count("*").alias("own"), F.min("vout").alias("v"))
    near = F.sum("own").over(Window.partitionBy("txid").orderBy("amount").rangeBetween(0, tolerance)) if tolerance else F.col("own")
    best = groups.withColumn("n", near).groupBy("txid").agg(F.sum("own").alias("n_out"), F.min(F.struct((-F.col("n")).alias("k"), "amount", "v")).alias("b")).where((F.col("n_out") >= least) & (F.col("b.k") <= -least))
    share = lambda c, cap: F.least(F.lit(1.0), F.col(c) / F.lit(float(cap)))
    out = best.join(n_in, "txid").select("txid", "n_in", "n_out", (-F.col("b.k")).alias("equal_outputs"), F.col("b.amount").alias("equal_value"))
    return out.withColumn("score", (share("n_in", 10) + share("n_out", 10) + share("equal_outputs", 10) + F.col("equal_outputs") / F.col("n_out")) / 4)


def seed_proximity(tx_in: DataFrame, tx_out: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.6) -> DataFrame:
    """Addresses downstream of seed addresses over unique spends: best score, then nearest, with how many seeds reach them."""
    spent = keep(unique_spends(tx_in).join(prevouts(tx_out).select(*OUTPOINT, F.col("prev_addr").alias("from_addr")), OUTPOINT).select("from_addr", F.col("spend_txid").alias("txid")).where("from_addr is not null").distinct(), "flow")
    pays = tx_out.where("addr is not null").select("txid", "addr").distinct()
    level = seeds.select(F.col("addr").alias("seed"), "addr").distinct()
    out = level.select("seed", "addr", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        level = level.join(spent.withColumnRenamed("from_addr", "addr"), "addr").select("seed", "txid").distinct().join(pays, "txid").select("seed", "addr").distinct()
        out = out.unionByName(level.select("seed", "addr", F.lit(d).alias("distance")))
    return out.groupBy("addr").agg(F.min("distance").alias("distance"), F.count_distinct("seed").alias("support")).withColumn("score", F.pow(F.lit(decay), F.col("distance")))


def neighbourhood(edges: DataFrame, seed: str, depth: int) -> DataFrame:
    """(node, level) within `depth` undirected steps of a node; edges not kept yet and every level are written once.

    What lies next to a level is in it, in the one before or new, so a level is held against two others and never against all that was reached.
    """
    edges = edges if hasattr(edges, "kept_path") else keep(edges.select("from_node", "to_node"), "edges")
    both = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).unionByName(edges.select(F.col("to_node").alias("a"), F.col("from_node").alias("b")))
    levels = [keep(edges.where((F.col("from_node") == seed) | (F.col("to_node") == seed)).limit(1).select(F.lit(seed).alias("node"), F.lit(0).alias("level")), "reached")]
    for level in range(1, depth + 1):
        new = both.join(levels[-1].select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        for near in levels[-2:]:
            new = new.join(near, "node", "left_anti")
        levels.append(keep(new.withColumn("level", F.lit(level)), "reached"))
    out = levels[0]
    for found in levels[1:]:
        out = out.unionByName(found)
    return out


def neighbourhood_page(edges: DataFrame, reached: DataFrame, depth: int, nodes: int = 200, more: int = 600, node_offset: int = 0, edge_offset: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page of a neighbourhood: its nodes, the seed first, the others by name, the edges at its inner nodes by edge_id, and one row of totals and of what is cut off.

    Edges at nodes of the last level lead beyond it and are left out unless their other end is nearer. Nodes and edges have pages of their own.
    """
    inner = keep(reached.where(F.col("level") < depth).select("node"), "inner")
    near = edges.join(inner.withColumnRenamed("node", "from_node"), "from_node", "left_semi").unionByName(edges.join(inner.withColumnRenamed("node", "to_node"), "to_node", "left_semi")).distinct()
    near = keep(near, "near")  # ids are made of these edges only, and not written
    totals = reached.agg(F.count("*").alias("nodes")).crossJoin(near.agg(F.count("*").alias("edges")))
    cut = lambda c, n: F.greatest(F.col(c) - n, F.lit(0)).alias(f"truncated_{c}")
    return reached.orderBy(F.col("level") > 0, "node").offset(node_offset).limit(nodes), _with_ids(near).orderBy("edge_id").offset(edge_offset).limit(more), totals.select("nodes", "edges", cut("nodes", node_offset + nodes), cut("edges", edge_offset + more))


def address_flow(tx_in: DataFrame, tx_out: DataFrame, addr: str) -> DataFrame:
    """Counterparty transactions of an address: those paying it and those spending from it; an unknown amount leaves a total unknown."""
    total = F.when(F.count_if(F.col("amount").isNull()) == 0, F.sum("amount"))
    paid = tx_out.where(F.col("addr") == addr).groupBy("txid").agg(total.alias("amount"), F.count("*").alias("utxo_count")).withColumn("side", F.lit("paid_by"))
    spent = resolve_inputs(tx_in, tx_out).where(F.col("prev_addr") == addr).withColumn("amount", F.col("prev_amount")).groupBy("txid").agg(total.alias("amount"), F.count("*").alias("utxo_count")).withColumn("side", F.lit("spent_in"))
    return paid.unionByName(spent)


def with_wallet(rows: DataFrame, wallet: DataFrame) -> DataFrame:
    """rows with the wallet of their address; wallet has (addr, wallet), and an address that it does not hold is its own."""
    return rows.join(wallet.select("addr", F.col("wallet").alias("_wallet")), "addr", "left").withColumn("wallet", F.coalesce("_wallet", "addr")).drop("_wallet")


def value_flows(tx_in: DataFrame, tx_out: DataFrame, wallet: DataFrame) -> DataFrame:
    """What each wallet receives from and gives to each transaction, unresolved inputs without a wallet left out; outputs get their wallet before they are spent."""
    paid = with_wallet(tx_out.where("addr is not null").select("txid", "vout", "addr", "amount"), wallet).select("txid", "vout", "wallet", "amount")
    out = paid.groupBy("txid", "wallet").agg(F.sum("amount").alias("amount")).withColumn("side", F.lit("out"))
    ins = tx_in.select("txid", *OUTPOINT).join(paid.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "wallet", "amount"), OUTPOINT)
    return out.unionByName(ins.groupBy("txid", "wallet").agg(F.sum("amount").alias("amount")).withColumn("side", F.lit("in")))


def risk_downstream(tx_in: DataFrame, tx_out: DataFrame, seeds: DataFrame, decay: float = 0.85, hops: int = 8, by: str = "addr") -> DataFrame:
    """(addr, risk): the downstream part of the risk of addresses alone; see address_risk, which has the upstream part and both combined."""
    from .risk import address_risk

    return address_risk(tx_in, tx_out, seeds, decay, hops, by).select("addr", F.col("downstream").alias("risk")).where("risk > 1e-6")


def verify_utxo(tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Counts of broken ledger rules: an outpoint made twice, spent twice, and value made from nothing."""
    made = tx_out.groupBy("txid", "vout").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_outpoints"))
    spent = tx_in.groupBy(*OUTPOINT).agg(F.count_distinct("txid").alias("n")).agg(F.count_if(F.col("n") > 1).alias("double_spends"))
    from .spends import value_conservation

    value = value_conservation(tx_in, tx_out).agg(F.count_if("violation").alias("value_creation"))
    return made.crossJoin(spent).crossJoin(value)
