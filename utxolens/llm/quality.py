"""Quality classification on random-indexing word vectors.

Every token bucket and token shape has a fixed sparse ternary index vector. A bucket's context
vector is the sum of its neighbours' index vectors over the whole corpus; a token's vector is its
index, shape and normalised context vectors added. A document is the mean of its tokens' vectors beside the means of
their products with the index vectors of the token before and of the one before that: products bind
two tokens in order, and repeated tokens bind to themselves. A two-layer numpy network learns the label from
these vectors alone, and a temperature, fitted on rows it did not learn from, calibrates its probabilities.

It learns labels from at most `per_label` rows of each label, taken by the order of a hash of their
ids, and only from rows that may be learned from; context vectors come from every row. Defined
results: null and empty texts are scored as documents without tokens; without labels every score is
0.5; null ids are held in the remainder of the empty string; repeated rows are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import joined, kinds, learnable, one_text, sample_binary
from .common import table, text_slices

#: Token buckets, shapes, vector length, and neighbours on each side.
BUCKETS, SHAPES, DIM, REACH = 1 << 13, 8, 48, 2
_POWERS = np.power(np.uint64(0x100000001B3), np.arange(64, dtype=np.uint64))


def index_vectors(seed: int = 11) -> np.ndarray:
    """Six signs in each row: +1 and -1 in equal numbers."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + SHAPES, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, 6, replace=False)] = (1, 1, 1, -1, -1, -1)
    return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, shape) of each token: a run of letters and digits, or of one other character."""
    points, owner = joined(texts)
    k = kinds()
    kind = np.where(k["space"][points], 0, np.where(k["alnum"][points], 1, 2))
    start = np.ones(len(points), bool)
    start[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (points[1:] != points[:-1]))
    at = np.flatnonzero(start)
    within = np.arange(len(points)) - np.repeat(at, np.diff(np.append(at, len(points))))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63], at) * np.uint64(0x9E3779B97F4A7C15)
    length = np.diff(np.append(at, len(points)))
    upper, digit = np.add.reduceat(k["upper"][points].astype(np.int32), at), np.add.reduceat(k["digit"][points].astype(np.int32), at)
    shape = np.where(upper == 0, 0, np.where((upper == length) & (length > 1), 2, np.where((upper == 1) & k["upper"][points[at]], 1, 3)))
    shape = np.where(digit > 0, 4, shape)
    shape = np.where(kind[at] == 2, np.where(length > 1, 6, 5), shape)
    some = kind[at] > 0
    return owner[at][some], (h >> np.uint64(51)).astype(np.int64)[some], shape[some]


def context_sums(batches, index: np.ndarray):
    """The sums of neighbours' index vectors for each bucket over all texts of a task."""
    total = np.zeros((BUCKETS, DIM))
    for b in text_slices(batches):
        owner, bucket, _ = tokens(b.column(1).to_pylist())
        for step in range(1, REACH + 1):
            same = owner[step:] == owner[:-step]
            one, two = bucket[:-step][same], bucket[step:][same]
            pair = np.unique(one * BUCKETS + two, return_counts=True)
            one, two, n = pair[0] // BUCKETS, pair[0] % BUCKETS, pair[1].astype(np.float64)
            for d in range(DIM):
                total[:, d] += np.bincount(one, index[two, d] * n, BUCKETS) + np.bincount(two, index[one, d] * n, BUCKETS)
    return total


def pooled(texts: list[str | None], vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Document vectors: the mean token vector, and the mean products of neighbours' index vectors one and two apart."""
    owner, bucket, shape = tokens(texts)
    n = len(texts)
    out = np.zeros((n, 3 * DIM), np.float32)
    count = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
    if len(owner):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first], :DIM] = np.add.reduceat(vectors[bucket], first) + np.add.reduceat(vectors[BUCKETS + shape], first)
        own = index[:BUCKETS].astype(np.int8)[bucket]
        for step in (1, 2):
            at = np.flatnonzero(owner[step:] == owner[:-step])
            if len(at):
                who = owner[at]
                cut = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                out[who[cut], step * DIM : (step + 1) * DIM] = np.add.reduceat(own[at + step] * own[at], cut, dtype=np.int32)
    return out / count[:, None]


class Network:
    """Two layers of weights and a temperature; score() gives probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 200, seed: int = 3):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z, rng = (x - self.mean) / self.std, np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 4
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        fit, target, m, v = z[~held], y[~held], [0.0] * 4, [0.0] * 4
        for t in range(1, rounds + 1):
            a = np.tanh(fit @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - target) / len(target)
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [fit.T @ back + 1e-4 * p[0], back.sum(0), a.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = p, 1.0
        logits, truth = self.logit(x[held]), y[held]
        if len(truth):
            grid = np.geomspace(0.25, 8, 41)
            loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, modulus: int = 5, held: int = 0, per_label: int = 3000):
    """A function from texts to scores, learned from every text and a bounded sample of labels."""
    index = index_vectors()
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def contexts(batches):
        import pyarrow as pa

        total = context_sums(batches, index)
        some = np.flatnonzero(np.abs(total).sum(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some].astype(np.int64)), pa.list_(pa.int64()))], ["bucket", "c"])

    # Whole numbers, so that sums do not depend on their order and reruns agree.
    sums = source.mapInArrow(contexts, "bucket long, c array<long>").groupBy("bucket").agg(F.array(*[F.sum(F.col("c")[d]) for d in range(DIM)]).alias("c"))
    context = np.zeros((BUCKETS, DIM), np.float32)
    for r in sums.collect():  # BUCKETS rows at most
        context[r.bucket] = r.c
    vectors = index.copy()
    vectors[:BUCKETS] += context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(learnable(known, "doc_id", modulus, held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = sample_binary(known, "y", per_label).select("doc_id", "y")

    def features(batches):
        import pyarrow as pa

        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(pooled(b.column(1).to_pylist(), vectors, index)), pa.list_(pa.float32())), b.column(2)], ["y", "x", "h"])

    # At most per_label ids of each of two labels: a bounded side to broadcast.
    rows = one_text(source.join(F.broadcast(drawn), "doc_id"), "doc_id", "y").select("y", "text", F.xxhash64("doc_id").alias("h"))
    got = sorted(rows.mapInArrow(features, "y int, x array<float>, h long").collect(), key=lambda r: (r.h, r.x))
    y = np.array([r.y for r in got], float)
    if len(set(y)) < 2:
        fixed = 0.5 if not len(y) else float(y[0])
        return lambda texts: np.full(len(texts), fixed)
    network = Network(np.array([r.x for r in got], np.float64), y)
    return lambda texts: network.score(pooled(texts, vectors, index).astype(np.float64))


def score_column(score, text: Column) -> Column:
    """A column of scores; the texts of a batch are taken about a megabyte at a time."""

    def run(texts):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([score(b.column(0).to_pylist()) for b in text_slices([batch], text=0)] or [np.zeros(0)]))

    return F.arrow_udf(run, "double")(text.cast("string"))


def score_table(df: DataFrame, score, id_col: str, text_col: str, modulus: int, held: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~learnable(scored, "doc_id", modulus, held)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_table(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id", "text", 5, 0, 0.3)
