"""Training of the quality and toxicity models against loops and finite differences."""

import re

import numpy as np
from utxolens.llm import quality, toxicity

TEXTS = ["The cat sat, the CAT ran!!", "a1 b2 a1 -- b2 a1", "", None, "x", "Zeta zeta 99 99 (zeta) eta; eta?? eta", "one two three two one two"]


def test_tokens_are_runs_and_equal_ones_share_a_bucket():
    owner, bucket, shape = quality.tokens(TEXTS)
    want = [(i, m[0]) for i, t in enumerate(TEXTS) for m in re.finditer(r"[^\W_]+|([^\w\s]|_)\1*", t or "")]
    assert owner.tolist() == [i for i, _ in want]
    of = {}
    for (_, word), b, s in zip(want, bucket, shape):
        assert of.setdefault(word, (b, s)) == (b, s)
    assert len({b for b, _ in of.values()}) == len(of)


def test_contexts_are_the_sums_of_neighbours():
    import pyarrow as pa

    index = quality.index_vectors()
    owner, bucket, _ = quality.tokens(TEXTS)
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for i in range(len(owner)):
        for j in range(max(0, i - quality.REACH), min(len(owner), i + quality.REACH + 1)):
            if i != j and owner[i] == owner[j]:
                want[bucket[i]] += index[bucket[j]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["doc_id", "text"])
    assert np.array_equal(quality.context_sums([batch], index), want)
    # The same corpus in two tasks adds up to the same.
    halves = [quality.context_sums([batch.slice(a, n)], index) for a, n in ((0, 3), (3, 4))]
    assert np.array_equal(sum(halves), want)


def test_documents_are_pooled_token_by_token():
    index, vectors = quality.index_vectors(), np.random.default_rng(4).normal(size=(quality.BUCKETS + quality.SHAPES, quality.DIM)).astype(np.float32)
    owner, bucket, shape = quality.tokens(TEXTS)
    got = quality.pooled(TEXTS, vectors, index)
    for i in range(len(TEXTS)):
        b, s = bucket[owner == i], shape[owner == i]
        want = np.zeros(3 * quality.DIM)
        for k in range(len(b)):
            want[: quality.DIM] += vectors[b[k]] + vectors[quality.BUCKETS + s[k]]
            for step in (1, 2):
                if k >= step:
                    want[step * quality.DIM : (step + 1) * quality.DIM] += index[b[k]] * index[b[k - step]]
        assert np.allclose(got[i], want / max(1, len(b)), atol=1e-4)


def slope(f, x, eps=1e-5):
    """Finite differences of f at every place of x, which is put back."""
    g = np.zeros(x.shape)
    for k in np.ndindex(x.shape):
        kept = x[k]
        x[k] = kept + eps
        up = f()
        x[k] = kept - eps
        g[k], x[k] = (up - f()) / (2 * eps), kept
    return g


def test_the_network_follows_the_slope_of_its_loss():
    r = np.random.default_rng(8)
    x, y = r.normal(size=(60, 4)), (r.random(60) < 0.5).astype(float)
    net = quality.Network(x, y, hidden=3, rounds=4, seed=3)
    z, rng, fit = (x - x.mean(0)) / (x.std(0) + 1e-6), np.random.default_rng(3), np.arange(60) % 5 != 4
    p = [rng.normal(0, 1 / np.sqrt(4), (4, 3)), np.zeros(3), rng.normal(0, 1 / np.sqrt(3), 3), np.zeros(1)]

    def loss():
        total = 0.0
        for row, label in zip(z[fit], y[fit]):
            t = sum(np.tanh(sum(row[i] * p[0][i, h] for i in range(4)) + p[1][h]) * p[2][h] for h in range(3)) + p[3][0]
            total += np.logaddexp(0, -t if label else t)
        return total / fit.sum() + 5e-5 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    m, v = [0.0] * 4, [0.0] * 4
    for t in range(1, 5):
        for i, g in enumerate([slope(loss, w) for w in p]):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    for got, want in zip(net.weights, p):
        assert np.allclose(got, want, atol=1e-5)
    held = net.logit(x[~fit])
    cost = lambda c: np.logaddexp(0, np.where(y[~fit] > 0, -held, held) / c).mean()
    assert all(cost(net.temperature) <= cost(c) + 1e-12 for c in np.geomspace(0.25, 8, 41))


def test_one_step_of_the_bags_is_the_slope_of_their_loss():
    """Embeddings, softmax and bias move by Adagrad along finite differences of the weighted loss of a window."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 7, 40)
    flat = r.integers(0, 30, sizes.sum()).astype(np.int32)
    first, label = np.cumsum(sizes) - sizes, (r.random(40) < 0.25).astype(np.int64)
    bags = toxicity.SubwordBags.__new__(toxicity.SubwordBags)
    bags.emb, bags.out, bags.bias = r.normal(size=(30, 8)).astype(np.float32), r.normal(size=(8, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32)
    bags.g_emb, bags.g_out = np.full(30, 0.1, np.float32), np.full(2, 1e-6, np.float32)
    emb, out, bias = (a.astype(np.float64) for a in (bags.emb, bags.out, bags.bias))
    weight = 0.5 / (np.bincount(label, minlength=2) / 40)

    def loss():
        total = 0.0
        for f, n, y in zip(first, sizes, label):
            z = emb[flat[f : f + n]].mean(0) @ out + bias
            total += weight[y] * (np.log(np.exp(z).sum()) - z[y])
        return total

    g_emb, g_out, g_bias = slope(loss, emb) * 64, slope(loss, out) / 40, slope(loss, bias) / 40
    bags._epochs(flat, first, sizes, label, np.arange(40), 1, np.random.default_rng(3))
    assert np.allclose(bags.emb - emb, -0.25 * g_emb / np.sqrt(0.1 + (g_emb**2).mean(1))[:, None], atol=1e-4)
    assert np.allclose(bags.out - out, -0.1 * g_out / np.sqrt(1e-6 + (g_out**2).mean(0)), atol=1e-4)
    assert np.allclose(bags.bias - bias, -0.05 * g_bias, atol=1e-5)
