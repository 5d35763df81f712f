"""The trained operators against plain references, and cases of repeats, ties and long runs."""

import time

import numpy as np
from pyspark.sql import functions as F
from test_llm import VECTORS, documents, plain_spans, prose, words
from utxolens.llm import chars, language, pii, quality, toxicity, vectors


def test_the_kernel_is_that_of_shared_distinct_grams():
    texts = [words(i, "abcdefgh", 6 + i) for i in range(12)]
    grams = [{(" " + t.lower() + " ")[k : k + n] for n in (1, 2, 3) for k in range(len(t) + 3 - n)} for t in texts]
    found = language.presence(texts)
    for a in range(12):
        assert len(found[a]) == len(grams[a])
        for b in range(a):
            assert len(np.intersect1d(found[a], found[b])) == len(grams[a] & grams[b])


def test_the_ridge_scores_are_those_of_plain_algebra():
    texts = language.presence([words(i, "abcdef" if i % 2 else "cdefgh", 8 + i % 7) for i in range(40)])
    labels = ["x" if i % 2 else "y" for i in range(40)]
    m = language.KernelModel(texts, labels, 5)
    marks = [texts[i] for c in ("x", "y") for i in [k for k in range(40) if labels[k] == c][:5]]
    k = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    inner = np.array([[k(a, b) for b in marks] for a in marks])
    values, axes = np.linalg.eigh(inner)
    keep = values > 1e-6 * values.max()
    phi = np.array([[k(a, b) for b in marks] for a in texts]) @ (axes[:, keep] / np.sqrt(values[keep]))
    phi = np.hstack((phi, np.ones((40, 1))))
    target = np.array([[1.0 if v == c else -1.0 for c in ("x", "y")] for v in labels])
    w = np.linalg.solve(phi.T @ phi + 1e-2 * 40 / 100 * np.eye(phi.shape[1]), phi.T @ target)
    assert np.allclose(m.score(texts), phi @ w, atol=1e-6)


def test_the_network_learns_a_product_and_is_calibrated():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 6))
    y = (r.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    net = quality.Network(x[:2000], y[:2000])
    p = net.score(x[2000:])
    assert np.allclose(p, 1 / (1 + np.exp(-net.logit(x[2000:]) / net.temperature)))
    linear = np.abs(np.corrcoef(x[2000:, 0], y[2000:])[0, 1])
    assert np.mean((p > 0.5) == y[2000:]) > 0.65 + linear / 10 and abs(p.mean() - y[2000:].mean()) < 0.06


def test_repeats_bind_to_themselves():
    index = quality.index_vectors()
    x = quality.pooled(["a b c d e f g h", "a a b b c c d d", "x y x y x y x y", None, ""], index, index)
    one, two = x[:, quality.DIM : 2 * quality.DIM].sum(1), x[:, 2 * quality.DIM :].sum(1)
    assert one[1] > one[0] + 1 and two[2] > two[0] + 1 and (x[3:] == 0).all()


def test_one_step_of_the_bags_is_the_gradient():
    """The folded weights score a window as embeddings and softmax do."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 9, 60)
    flat = r.integers(0, 1 << 18, sizes.sum()).astype(np.int32)
    bags = toxicity.SubwordBags.__new__(toxicity.SubwordBags)
    bags.emb, bags.out, bags.bias = r.normal(size=(1 << 18, 8)).astype(np.float32), r.normal(size=(8, 2)).astype(np.float32), np.zeros(2, np.float32)
    first = np.cumsum(sizes) - sizes
    z = np.array([bags.emb[flat[f : f + n]].mean(0) @ bags.out for f, n in zip(first, sizes)])
    assert np.allclose(bags._logits(flat, first, sizes), z[:, 1] - z[:, 0], atol=1e-3)
    bags.g_emb, bags.g_out = np.full(1 << 18, 0.1, np.float32), np.full(2, 1e-6, np.float32)
    label = r.integers(0, 2, 60)
    loss = lambda: np.mean([np.log(np.exp(zz := bags.emb[flat[f : f + n]].mean(0) @ bags.out + bags.bias).sum()) - zz[y] for f, n, y in zip(first, sizes, label)])
    before = loss()
    bags._epochs(flat, first, sizes, label, np.arange(60), 5, np.random.default_rng(3))
    assert loss() < 0.8 * before


def test_a_bounded_sample_takes_every_label(spark):
    rows = [(i, "big") for i in range(30_000)] + [(i, "small") for i in range(7)] + [(i, None) for i in range(5)]
    got = chars.sample_by(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", 50).collect()
    count = {k: sorted(r.rn for r in got if r.lang == k) for k in ("big", "small")}
    assert count == {"big": list(range(1, 51)), "small": list(range(1, 8))}
    first = spark.range(30_000).select("id", F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("h")).orderBy("h", "id").limit(50)
    assert {r.id for r in first.collect()} == {r.doc_id for r in got if r.lang == "big"}


def test_digit_runs_cost_their_length():
    for text in ("7" * 1_000_000, "1." * 500_000, "12345.6." * 100_000, "1.2.3.4." * 100_000):
        began = time.process_time()
        spans = pii.find_spans(text)
        assert time.process_time() - began < 5
        short = text[:4000] + "x"
        assert pii.find_spans(short) == plain_spans(short) and (spans != []) == (plain_spans(short) != [])
    assert [s for s in pii.find_spans("1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4") if s[1] == 1] == [(0, 1, 7), (8, 1, 15), (26, 1, 39)]


def test_redaction_leaves_other_kinds_alone():
    text = "see http://x.org/a, mail a@b.co, account no: 1234567"
    assert pii.redact(text, ("email", "account")) == "see http://x.org/a, mail <EMAIL>, account no: <ACCOUNT>"
    assert pii.redact(text) == "see <URL>, mail <EMAIL>, account no: <ACCOUNT>"


def test_vectors_of_one_id_and_equal_vectors(spark):
    """A repeated id with the same and with another vector, equal vectors of two labels, hot copies and ties."""
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "", "") for i, v in enumerate(x)] + [(3, x[3].tolist(), 1, "", ""), (3, x[5].tolist(), 1, "", ""), (100, x[7].tolist(), 2, "", "")]
    rows += [(200 + i, x[0].tolist(), 1, "", "") for i in range(50)]
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS), block=8).collect()
    by = {}
    for g in got:
        by.setdefault(g.vec_id, []).append((g.n_links, g.component_id, g.kept))
    assert len(got) == len(rows) and by[100] == [(0, 100, True)] and by[7] == [(0, 7, True)]
    assert sorted(by[3]) == [(1, 3, True)] * 3 and by[5] == [(1, 3, False)], "a row of an id counts as another vector"
    assert by[0] == [(50, 0, True)] and all(by[200 + i] == [(50, 0, False)] for i in range(50))
    df = spark.createDataFrame([(i, x[i % 4].astype(float).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    found = {}
    for g in vectors.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard=64).collect():
        found.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    for q, near in found.items():
        score = {c: float((x[c].astype(float) * x[q % 4].astype(float)).sum()) for c in range(4)}
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i % 4], i))[:20]
        assert [v for _, v, _ in sorted(near)] == best


def test_recall_and_share_of_rows_that_are_reranked(spark):
    """On near-isotropic vectors the radius holds a small share of rows and nearly all neighbours."""
    r = np.random.default_rng(9)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.fit_codes(x[:4096])
    radius = vectors.fit_radius(x[:4096], model, 20, 0.97)
    index = vectors.MultiIndex(np.arange(len(x)), x, model)
    hits = share = 0
    for q in range(0, 20_000, 500):
        ids, _ = index.search(q, x[q], index.code[q], radius, 20)
        score = x @ x[q]
        score[q] = -9
        hits += len(set(ids.tolist()) & set(np.argsort(-score)[:20].tolist()))
        share += len(index.within(index.code[q], radius)) / len(x)
    print("recall", hits / 800, "share reranked", share / 40)
    assert hits >= 0.95 * 800 and share / 40 < 0.10


def test_odd_documents_are_scored(spark):
    docs = documents(spark, [(1, None, None, None), (2, "", "en", "s"), (None, "a b", "en", "s"), (3, prose(1, 20_000), "en", "s"), (3, prose(1, 20_000), "en", "s")])
    assert language.identify(docs, per_language=2).count() == 5
