"""Fragments by receipt, the feature store, and first-wins state across restarts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from utxolens.operators import intake
from utxolens.sources import features, fragments
from utxolens.streaming import events
from utxolens.streaming.first_wins import first_wins_verdicts

FACTS = "record_type string, row long, txid string"


def facts(spark, lo, hi, mark=""):
    return spark.createDataFrame([("outputs" if i % 3 else "inputs", i - lo, f"t{i}{mark}") for i in range(lo, hi)], FACTS)


def seen(spark, root, kind="outputs", **more):
    return [(r.seq, r.txid) for r in fragments.read_fragments(spark, root, kind, "row long, txid string", **more).orderBy("seq").collect()]


def test_only_receipted_fragments_are_read(spark, tmp_path):
    root = str(tmp_path)
    assert seen(spark, root) == []
    for b in (1, 2):
        assert fragments.publish(facts(spark, b * 10, b * 10 + 10), root, b) == {"batch": b, "fragments": ["inputs", "outputs"], "again": False}
    want = [((i // 10 << 32) + i % 10, f"t{i}") for i in range(10, 30) if i % 3]
    assert seen(spark, root) == want
    # An attempt that ended before its receipt: its files are there, and nobody reads them.
    orphan = facts(spark, 30, 40).where("record_type = 'outputs'").withColumn("seq", F.lit(3).cast("long") * (1 << 32) + F.col("row"))
    orphan.drop("record_type").coalesce(1).write.parquet(f"{root}/fragments/batch-00000003/outputs")
    facts(spark, 50, 60).write.parquet(f"{root}/.staging/batch-00000005-dead")
    (tmp_path / "fragments/batch-00000001/outputs/part-stray.parquet").write_bytes(b"no file of the receipt")
    assert seen(spark, root) == want and seen(spark, root, verify=True) == want
    # It is taken up if it is what is published, and refused if not.
    with pytest.raises(ValueError, match="another fragment"):
        fragments.publish(facts(spark, 30, 40, "x"), root, 3)
    assert seen(spark, root) == want
    fragments.publish(facts(spark, 30, 40), root, 3)
    assert len(seen(spark, root)) == len(want) + 6


def test_published_batches_do_not_change(spark, tmp_path):
    root = str(tmp_path)
    fragments.publish(facts(spark, 0, 10), root, 1)
    before = {p: p.read_bytes() for p in Path(root).rglob("*") if p.is_file()}
    assert fragments.publish(facts(spark, 0, 10).orderBy(F.desc("row")), root, 1)["again"]
    with pytest.raises(ValueError, match="other rows"):
        fragments.publish(facts(spark, 0, 9), root, 1)
    assert {p: p.read_bytes() for p in Path(root).rglob("*") if p.is_file()} == before
    part = next((tmp_path / "fragments").rglob("part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    kind = part.parent.name
    with pytest.raises(ValueError, match="not the file"):
        seen(spark, root, kind)


def test_verification_finds_swapped_rows(spark, tmp_path):
    fragments.publish(facts(spark, 0, 10), str(tmp_path), 1)
    part = next((tmp_path / "fragments/batch-00000001/outputs").glob("part-*.parquet"))
    raw = bytearray(part.read_bytes())
    other = tmp_path / "other"
    spark.createDataFrame([(i, f"u{i}", (1 << 32) + i) for i in range(10) if i % 3], "row long, txid string, seq long").coalesce(1).write.option("compression", "zstd").parquet(str(other))
    new = next(other.glob("part-*.parquet")).read_bytes()
    if len(new) == len(raw):
        part.with_name(f".{part.name}.crc").unlink()
        part.write_bytes(new)
        with pytest.raises(ValueError, match="differ from the receipts"):
            seen(spark, str(tmp_path), verify=True)


def test_replay_holds_the_digest(spark):
    import hashlib

    rows = spark.createDataFrame([("record:1", "a"), ("record:2", "b")], "locator string, raw string")
    good = hashlib.sha256(b"b").hexdigest()
    assert [r.raw for r in fragments.locate(rows, "record:2", good).collect()] == ["b"] and fragments.locate(rows, "record:9").count() == 0
    with pytest.raises(Exception, match="digest differs"):
        fragments.locate(rows, "record:1", good).collect()


def vectors(spark, entities, mark):
    return spark.createDataFrame([(f"e{e:03d}", w, f"{mark}{e}-{w}") for e in entities for w in range(3)], "entity_ref string, window_start long, vector string")


def test_rewriting_replaces_only_the_parts_it_touches(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path))
    assert store.manifest()["parts"] == [] and store.append(vectors(spark, range(80), "a"), 8) == 1 and store.append(vectors(spark, range(80, 100), "a"), 2) == 2
    parts = {p["path"]: (tmp_path / p["path"]).read_bytes() for p in store.manifest()["parts"]}
    assert len(parts) == 10
    updates = spark.createDataFrame([("e005", 1, "new"), ("e006", 0, None), ("nobody", 0, "x"), ("e095", 2, "new"), ("e095", 2, "mew")], "entity_ref string, window_start long, vector string")
    version, replaced = store.rewrite(updates, "vector")
    assert version == 3 and replaced == 2
    now = {p["path"] for p in store.manifest()["parts"]}
    assert len(now & set(parts)) == 8 and all((tmp_path / p).read_bytes() == parts[p] for p in now & set(parts))
    want = {(f"e{e:03d}", w): f"a{e}-{w}" for e in range(100) for w in range(3)}
    assert {(r.entity_ref, r.window_start): r.vector for r in store.read(2).collect()} == want
    want |= {("e005", 1): "new", ("e095", 2): "new"}
    assert {(r.entity_ref, r.window_start): r.vector for r in store.read().collect()} == want
    assert sorted(r.vector for r in store.read(entities=["e005", "zzz"]).collect()) == ["a5-0", "a5-2", "new"]
    assert store.rewrite(updates.where("entity_ref = 'nobody'"), "vector") == (3, 0)
    with pytest.raises(ValueError, match="columns"):
        store.append(updates.drop("vector"))
    with pytest.raises(ValueError, match="another writer"):
        store._commit(2, store.manifest()["schema"], [])
    assert store.vacuum() == 2 and store.versions() == [3] and store.read().count() == 300


def test_flat_features_fill_what_can_be_missing(spark):
    dist = "struct<min_sats: long, max_sats: long, median_sats: double, total_sats: long>"
    schema = f"entity_ref string, window_start long, features struct<in_event_count: int, out_event_count: int, received_output_count: int, outgoing_output_count: int, observed_counterparties: int, received_value_distribution_sats: {dist}, outgoing_value_distribution_sats: {dist}, inter_event_gaps_seconds: struct<count: int, minimum_seconds: double, maximum_seconds: double, median_seconds: double>, bounded_component_change: struct<node_delta: int, edge_delta: int, resolved_spend_edge_delta: int>, first_observed_activity: boolean, prior_window_gap_seconds: double, baseline_in_event_count_mean: double, activity_surge_ratio: double, baseline_value_sats_mean: double, value_surge_ratio: double, peeling_chain_score: double, peeling_chain_length: int, peeling_chain_total_duration_sec: double, peeling_chain_evidence_count: int, coinjoin_like_score: double, equal_output_count: int, equal_output_value_sats: long, coinjoin_like_evidence_count: int>"
    full = (3, 1, 4, 2, 5, (1, 9, 2.5, 20), (3, 4, 3.5, 7), (2, 1.0, 5.0, 3.0), (7, 8, 9), False, 60.0, 2.0, 1.5, 10.0, 2.5, 0.5, 4, 30.0, 6, 0.25, 3, 500, 2)
    bare = (1, 0, 1, 0, 0, (1, 1, 1.0, 1), None, (1, 5.0, 5.0, 5.0), (0, 0, 0), True, None, None, None, None, None, 0.0, 0, 0.0, 0, 0.0, 0, None, 0)
    got = [tuple(r)[2:] for r in features.flat_features(spark.createDataFrame([("a", 0, full), ("b", 0, bare)], schema)).orderBy("entity_ref").collect()]
    assert len(features.FLAT) == 37
    assert got[0] == tuple(map(float, (3, 1, 4, 2, 5, 1, 9, 2.5, 20, 3, 4, 3.5, 7, 0, 2, 1, 5, 3, 0, 7, 8, 9, 0, 60, 2, 1.5, 10, 2.5, 0.5, 4, 30, 6, 0.25, 3, 500, 0, 2)))
    assert got[1] == tuple(map(float, (1, 0, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0)))
    lacking = spark.createDataFrame([("c", 0, (None, *full[1:]))], schema)
    with pytest.raises(Exception, match="lacks in_event_count"):
        features.flat_features(lacking).collect()


def test_a_stopped_stream_goes_on_with_its_winners(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice("xyz")) for i in range(300)]
    schema, source, out = "logical_record long, txid string, content string", str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = events.drain(first_wins_verdicts(stream, "txid", F.md5("content")), out).collect()
        assert len(got) == part * 100 + 100
    batch = intake.dedupe_txid(spark.createDataFrame([r for r in rows if r[1]], schema), F.md5("content"))
    want = {r.logical_record: r.verdict for r in batch.collect()} | {i: "accepted" for i, k, _ in rows if k is None}
    assert {r.logical_record: r.verdict for r in got} == want and set(want.values()) == {"accepted", "duplicate", "conflicting variant"}


def test_seeds_that_come_later_raise_scores_and_add_what_is_missing(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path / "s"))
    rows = [(f"e{i:02d}", w, 0.5 if i == 3 else None, i) for i in range(20) for w in (900, 1800)]
    store.append(spark.createDataFrame(rows, "entity_ref string, window_start long, seed_score double, other long"), 4)
    signals = spark.createDataFrame([("e01", "p", 0.6), ("e01", "p", 0.9), ("e03", "p", 0.4), ("e02", "q", 0.3), ("gone", "p", 1.0)], "entity_ref string, rule string, score double")
    found = spark.createDataFrame([("e01", "p"), ("e02", "p")], "entity_ref string, rule string")
    version, replaced, new = features.refresh_seeds(store, signals, found)
    want = {"e01": 0.9, "e02": 0.3, "e03": 0.5}
    assert version == 2 and 1 <= replaced < 4
    assert sorted(map(tuple, store.read().collect())) == sorted((e, w, want.get(e), o) for e, w, _, o in rows)
    assert sorted(map(tuple, new.collect())) == [("e02", "q", 900, 900 + 900_000_000, 0.3), ("e03", "p", 900, 900 + 900_000_000, 0.4), ("gone", "p", 0, 900_000_000, 1.0)]
    assert features.refresh_seeds(store, signals.limit(0), found)[:2] == (2, 0)


def test_a_stream_enters_python_once_a_bucket_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("utxolens.streaming.first_wins.BUCKETS", 3, raising=False)
    schema, source, out = "logical_record long, txid string, content string", str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        spark.createDataFrame([(i, f"k{i % 700}", "x") for i in range(part * 1000, part * 1000 + 1000)], schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = first_wins_verdicts(stream, "txid", F.col("content")).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        q.awaitTermination()
        states = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        got = spark.read.parquet(f"{out}/rows")
        assert states <= 3 and got.count() == part * 1000 + 1000 and got.where("verdict = 'accepted'").count() == 700
