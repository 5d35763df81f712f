"""Registered queries over whole tables, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from utxolens.plans import all_queries
from utxolens.plans.domain import Domain

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledger(spark):
    """The derived tables as rows: outputs by outpoint, and inputs."""
    d = Domain(spark, DIR)
    return {(r.txid, r.vout): r for r in d.tx_out.collect()}, d.tx_in.collect()


@pytest.fixture(scope="module")
def entities(ledger):
    """Address to entity by union-find over every transaction's inputs."""
    outs, ins = ledger
    spenders, n_in, equal = defaultdict(set), Counter(i.txid for i in ins), defaultdict(Counter)
    for (t, _), o in outs.items():
        equal[t][o.amount] += 1
    for i in ins:
        o = outs.get((i.prev_txid, i.prev_vout))
        spenders[i.txid].add(i.address or (o and o.addr))
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for t, found in spenders.items():
        found.discard(None)
        if len(found) > 1 and not (n_in[t] >= 3 and max(equal[t].values(), default=0) >= 3):
            first, *more = sorted(found)
            for a in more:
                x, y = sorted((root(first), root(a)))
                up[y] = x
    return {a: "E-" + hashlib.md5(root(a).encode()).hexdigest()[:12] for a in up}


def rows(spark, name):
    return all_queries.QUERIES[name](spark, DIR).collect()


def test_clusters_link_every_transactions_inputs(spark, ledger, entities):
    outs, ins = ledger
    assert {(r.addr, r.entity_id) for r in rows(spark, "common_input_cluster")} == set(entities.items())
    wallet = {o.addr: entities.get(o.addr, o.addr) for o in outs.values()}
    assert {(r.addr, r.wallet) for r in rows(spark, "wallet_of_address")} == set(wallet.items())
    flows, sent = Counter(), Counter()
    for (t, _), o in outs.items():
        flows[t, wallet[o.addr], "out"] += o.amount
    for i in ins:
        if o := outs.get((i.prev_txid, i.prev_vout)):
            flows[i.txid, wallet[o.addr], "in"] += o.amount
            sent[wallet[o.addr]] += o.amount
    got = rows(spark, "value_flows")
    assert len(got) == len(flows) and {(r.txid, r.wallet, r.side): r.amount for r in got} == dict(flows)
    rollup = {r.entity_id: (r.address_count, r.sent) for r in rows(spark, "entity_rollup")}
    assert rollup == {e: (n, sent[e]) for e, n in Counter(entities.values()).items()}


def test_bounds_copies_and_matches_are_over_whole_tables(spark, ledger):
    outs, ins = ledger
    tx = sorted((r.us, r.txid) for r in Domain(spark, DIR).tx.collect())
    later = [True] + [a[0] < b[0] for a, b in zip(tx, tx[1:])]
    assert sorted((r.us, r.txid, r.later, r.first_us) for r in rows(spark, "source_bounds")) == [(*t, x, tx[0][0]) for t, x in zip(tx, later)]
    want = {(hashlib.sha256(f"{t}:{c}".encode()).hexdigest(), us + c * 3_600_000_000, c) for us, t in tx for c in range(3)}
    got = [tuple(r) for r in rows(spark, "scaled_copies")]
    assert len(got) == len(want) and set(got) == want
    found = lambda i: (i.prev_txid, i.prev_vout) in outs
    assert sorted(map(tuple, rows(spark, "matched_inputs"))) == sorted((i.txid, i.vin) for i in ins if found(i))
    assert sorted(map(tuple, rows(spark, "unresolved_inputs"))) == sorted((i.txid, i.vin) for i in ins if not found(i))


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The small tables with suppliers moved so that many parts share an address."""
    import duckdb

    path = tmp_path_factory.mktemp("shared")
    for name in ("orders", "lineitem", "events"):
        moved = "* REPLACE (l_suppkey - l_partkey % 7 * 100 AS l_suppkey)" if name == "lineitem" else "*"
        duckdb.sql(f"COPY (SELECT {moved} FROM '{DIR}/{name}.parquet') TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["risk_propagation", "scenario_coverage"])
def test_seeds_are_parts_where_parts_share_addresses(spark, shared, name):
    import duckdb

    db = duckdb.connect()
    for table in ("orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{shared}/{table}.parquet'")
    want = db.execute(all_queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in all_queries.QUERIES[name](spark, shared).select(columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["population_burst", "inherited_burst", "causal_burst"])
def test_bursts_of_tails_near_nothing_agree_with_sql(spark, tmp_path, name):
    # Hours with 8 to 11 dear orders in one quarter and one in the next: tails of 1e-10 to 1e-12, of which 1 minus a sum keeps few digits.
    import duckdb

    place = lambda key: key * 7919 % 3600 // 900
    early, late = ([k for k in range(1, 4000) if place(k) == q] for q in (0, 1))
    rows = [(k, hour) for hour in range(60, 300, 12) for k in [early.pop() for _ in range(8 + hour // 12 % 4)] + [late.pop()]] + [(late.pop(), 0)]
    days = ", ".join(f"({k}, TIMESTAMP '2020-01-01' + INTERVAL ({h}) DAY)" for k, h in rows)
    duckdb.sql(f"COPY (SELECT k::BIGINT AS o_orderkey, 700.0::DOUBLE AS o_totalprice, d AS o_orderdate FROM (VALUES {days}) o(k, d)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'; CREATE VIEW lineitem AS SELECT * FROM '{DIR}/lineitem.parquet'; CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    want = db.execute(all_queries.SQL[name])
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert any(19 < r[-1] < 27.6 for r in want)
    assert sorted(tuple(r) for r in all_queries.QUERIES[name](spark, str(tmp_path)).select(columns).collect()) == want
