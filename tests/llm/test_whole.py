"""Cases in which a part of the rows used to be left out."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from test_llm import documents, labelled, prose, words
from tokenizers import Tokenizer
from utxolens.llm import language, mixing, quality, tokens, toxicity, vectors


def test_every_language_gives_its_rows(spark, monkeypatch):
    seen, real = [], language.KernelModel
    monkeypatch.setattr(language, "KernelModel", lambda texts, labels, m: seen.append(Counter(labels)) or real(texts, labels, m))
    names = [f"l{k:02}" for k in range(70)]
    rows = [(100 * k + i, words(100 * k + i, "abcdef", 8), n, "s") for k, n in enumerate(names) for i in range(12)]
    rows += [r for r in rows if r[2] == "l00"] * 20
    language.identify(documents(spark, rows), per_language=2)
    assert seen == [Counter({n: 2 for n in names})]


def test_a_repeated_id_is_learned_from_once(spark, monkeypatch):
    seen, bags, network = [], toxicity.SubwordBags, quality.Network
    monkeypatch.setattr(toxicity, "SubwordBags", lambda *a: seen.append(Counter(a[3].tolist())) or bags(*a))
    monkeypatch.setattr(quality, "Network", lambda x, y: seen.append(Counter(y.tolist())) or network(x, y))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, words(i, "abcdefgh", 30), "en", "s") for i in ids]
    docs, known = documents(spark, rows[:1] * 400 + rows), labelled(spark, [(i, i % 2, i % 2) for i in ids])
    toxicity.train(docs, known, per_label=20)
    quality.train(docs, known, per_label=20)
    assert seen == [Counter(i % 2 for i in ids)] * 2


def test_the_stage_groups_by_jaccard(spark):
    r, texts = random.Random(5), []
    for i in range(40):
        w = words(i, "abcdefgh", r.choice((3, 12, 60, 200))).split()
        texts.append(" ".join(w))
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = f"new{i}x{k}"
            texts.append("license line all have in common " + " ".join(v) if k == 3 else " ".join(v))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(900, "", "en", "s"), (901, None, "en", "s")]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in ((t or "").split() for _, t, _, _ in rows)]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    got = corpus_pipeline.dedup_stage(spark, documents(spark, rows), "")
    assert sorted(x.doc_id for x in got.collect()) == sorted(rows[i][0] for i in set(up))


def test_null_and_repeated_ids_keep_their_texts(spark, tmp_path):
    where = str(tmp_path)
    labelled(spark, [(i, i % 2, 0) for i in range(9)]).write.parquet(f"{where}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c, d, e = (words(i, "abcdefgh", 40) for i in range(5))
    rows = [(None, a, "en", "s"), (None, b, "en", None), (1, c, "en", "s"), (1, d, "en", "s"), (2, c, "en", "s"), (2, e, "en", "s"), (2, e, "en", "s"), (0, e, "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], schema)
    stay = corpus_pipeline.dedup_stage(spark, docs, "")
    kept = sorted(((r.doc_id, r.text, r.source) for r in stay.collect()), key=str)
    assert kept == sorted([(None, a, "s"), (None, b, None), (1, c, "s"), (1, d, "s"), (0, e, "t")], key=str)
    for given in (stay, docs):
        taken = sum(r.taken for r in mixing.mix_sources(given).collect())
        mixed = corpus_pipeline.mix_stage(spark, given, where).collect()
        assert abs(sum(len(r.text.split()) for r in mixed) - taken) <= 2
    assert any(r.doc_id is None for r in mixed)


def test_the_pipeline_ends_with_token_ids(spark):
    docs = documents(spark, [(i % 3, words(i, "abcdefgh", 40), "en", "s") for i in range(6)])
    got = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert got and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_ids_are_the_untouched_tokenizers():
    default = Tokenizer.from_file(tokens.default_vocabulary())
    texts = ["", "two  words \n\n it's 12", "<|endoftext", prose(3, 200), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y z"]
    got = tokens.Encoder(tokens.default_vocabulary()).batch(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == default.encode(t, add_special_tokens=False).ids, t
    assert 50256 in np.frombuffer(got[4], "<u4")


def test_each_vector_length_is_searched(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4 + 4 * (i % 2)).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.nearest(table, table, k=3, share=1.0).collect()
    assert Counter(x.query_id for x in got) == {i: 3 for i in range(60)} and all((x.query_id - x.vec_id) % 2 == 0 for x in got)


def test_the_stage_sends_no_table_through_the_driver(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(40)) for _ in range(30)]
    rows = [(i, t + " again" * (i % 3)) for i, t in enumerate(t for t in texts for _ in range(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    assert corpus_pipeline.dedup_stage(spark, docs, "").count() < len(rows)
    plans = [runs.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, runs.executionsCount())]
    assert plans and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
