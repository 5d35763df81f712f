"""Toxicity by subword bags.

A text is cut into windows of eight words. A window is the mean of the embeddings of its character 3-
to 5-grams (hashed; word edges count as a character), read by a linear softmax; embeddings and
softmax are trained together in numpy, so misspelt words share what they have in common with known
ones. A document labelled toxic need not be so throughout: after a first round on all windows, its
windows that score lowest no longer count as toxic ones. A document's score is that of its strongest
window, calibrated with its number of windows on documents that were not trained on, each label
weighing as often as it occurs. Features the training met rarely count for less, unmet ones for
nothing.

It learns from at most `per_label` rows of each label, taken by the order of a hash of their ids, from
at most `per_text` windows of each, spread evenly (so the driver holds some 160 MB at most), and
only from rows that may be learned from. Defined results: null and empty texts have one empty window
and get its calibrated score; without labels every score is 0.5; null ids are held in the remainder
of the empty string; repeated rows are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import gram_hash, joined, kinds, learnable, one_text, sample_binary
from .common import table, text_slices
from .quality import score_table

_BITS, _GRAMS, _WORDS, _DIM = 18, (3, 4, 5), 8, 8


def windows(texts: list[str | None]):
    """(feature, window) of every n-gram, and the text of every window; each text has one window at least."""
    points, owner = joined([t.lower() if t else t for t in texts])
    letter = kinds()["letter"][points]
    points = np.where(letter, points, np.uint32(32))
    word = np.cumsum(letter & ~np.concatenate(([False], letter[:-1])))
    edges = np.searchsorted(owner, np.arange(len(texts)))
    own_word = np.maximum(word - word[edges][owner] - 1, 0)
    n_windows = np.maximum(1, -(-np.bincount(owner, letter & ~np.concatenate(([False], letter[:-1])), len(texts)).astype(np.int64) // _WORDS))
    first = np.cumsum(n_windows) - n_windows
    place = first[owner] + np.minimum(own_word // _WORDS, n_windows[owner] - 1)
    inside = np.concatenate(([0], np.cumsum(letter)))
    feature, window = [], []
    for n in _GRAMS:
        size = max(0, len(points) - n + 1)
        at = np.flatnonzero(inside[n - 1 : n - 1 + size] - inside[1 : 1 + size] == n - 2)
        feature.append(gram_hash(points, n, _BITS)[at])
        window.append(place[at + 1])
    return np.concatenate(feature), np.concatenate(window), np.repeat(np.arange(len(texts)), n_windows)


class SubwordBags:
    """Embeddings and softmax trained jointly on bags; score() reads texts with both folded into one weight per feature."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, y: np.ndarray, share: float, seed: int = 5):
        """flat: features of all windows, sizes: how many each has; doc: the document of each window; y: label of each document; share: of label 1 among all."""
        rng = np.random.default_rng(seed)
        self.emb = rng.uniform(-0.5 / _DIM, 0.5 / _DIM, (1 << _BITS, _DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (_DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.g_emb, self.g_out = np.full(1 << _BITS, 0.1, np.float32), np.full(2, 1e-6, np.float32)
        first = np.cumsum(sizes) - sizes
        label = y[doc].astype(np.int64)
        held = np.zeros(len(y), bool)
        for v in (0, 1):  # every fourth document of a label is kept for calibration
            held[np.flatnonzero(y == v)[3::4]] = True
        fit = (sizes > 0) & ~held[doc]
        use = np.flatnonzero(fit)
        self._epochs(flat, first, sizes, label, use, 2, rng)
        for _ in range(2):  # windows of a toxic document that look clean are left out
            s = self._logits(flat, first, sizes)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, doc, s)
            use = np.flatnonzero(fit & ((label == 0) | (s >= best[doc]) | (s > 0)))
            self._epochs(flat, first, sizes, label, use, 2, rng)
        met = np.zeros(1 << _BITS)
        for a in range(0, len(sizes), 8192):
            rows = [flat[f : f + n] for f, n in zip(first[a : a + 8192][fit[a : a + 8192]], sizes[a : a + 8192][fit[a : a + 8192]])]
            if rows:
                met += np.bincount(np.concatenate(rows), minlength=1 << _BITS)
        self.emb *= (met / (met + 3.0)).astype(np.float32)[:, None]
        self.weight = (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)
        self.shift = float(self.bias[1] - self.bias[0])
        s = self._logits(flat, first, sizes)
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, s)
        self.scale = np.array([1.0, 0.0, 0.0])
        n = np.bincount(doc, minlength=len(y))
        held = held if len(set(y[held].tolist())) > 1 else ~np.zeros(len(y), bool)
        self._calibrate(best[held], n[held], y[held], share)
        del self.emb, self.g_emb

    def _logits(self, flat, first, sizes):
        w = self.emb @ (self.out[:, 1] - self.out[:, 0])
        out = np.zeros(len(sizes))
        for a in range(0, len(sizes), 8192):  # a few windows at a time: the driver holds the features once
            f, n = first[a : a + 8192], sizes[a : a + 8192]
            total = np.concatenate(([0.0], np.cumsum(w[flat[f[0] : f[-1] + n[-1]]], dtype=np.float64)))
            out[a : a + 8192] = total[f - f[0] + n] - total[f - f[0]]
        return out / np.maximum(sizes, 1) + (self.bias[1] - self.bias[0])

    def _epochs(self, flat, first, sizes, label, use, n, rng, batch: int = 128, rate: float = 0.25):
        """Adagrad steps; each label weighs the same in all."""
        share = np.bincount(label[use], minlength=2) / max(1, len(use))
        weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
        for _ in range(n):
            order = rng.permutation(use)
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                size = sizes[rows]
                ids = np.concatenate([flat[f : f + s] for f, s in zip(first[rows], size)])
                at = np.cumsum(size) - size
                mean = np.add.reduceat(self.emb[ids], at) / size[:, None]
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                e = (p - np.eye(2, dtype=np.float32)[label[rows]]) * weight[label[rows]][:, None]
                g_mean = (e @ self.out.T).astype(np.float32)
                # A feature's step: its whole gradient in the batch, summed by sorted feature.
                order_ids = np.argsort(ids, kind="stable")
                sorted_ids = ids[order_ids]
                cut = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
                per = (g_mean / size[:, None])[np.repeat(np.arange(len(rows)), size)[order_ids]] * 64
                g = np.add.reduceat(per, cut)
                touched = sorted_ids[cut]
                self.g_emb[touched] += (g * g).mean(1)
                self.emb[touched] -= rate * g / np.sqrt(self.g_emb[touched])[:, None]
                g_out = mean.T @ e / len(rows)
                self.g_out += (g_out * g_out).mean(0)
                self.out -= 0.1 * g_out / np.sqrt(self.g_out)
                self.bias -= 0.05 * e.mean(0)

    def _calibrate(self, best, n, y, share):
        """Logistic regression of the label on the strongest window and the number of windows."""
        x = np.stack((best, np.log(np.maximum(n, 1)), np.ones(len(y))), 1)
        mean, std = x.mean(0), x.std(0) + 1e-9
        mean[2], std[2] = 0, 1
        z, w = (x - mean) / std, np.zeros(3)
        each = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (each * p * (1 - p))[:, None]).T @ z + np.diag((1.0, 1.0, 1e-3))
            w -= np.clip(np.linalg.solve(h, z.T @ (each * (p - y)) + np.array((1.0, 1.0, 1e-3)) * w), -2, 2)
        self.scale = w / std
        self.scale[2] -= (w[:2] * mean[:2] / std[:2]).sum()
        # One half lies where fewest are wrong; of several such places, in the middle of the widest gap.
        z = x @ self.scale
        order = np.argsort(z)
        wrong = np.cumsum(np.where(y[order] > 0, each[order], -each[order]))[:-1]
        gap = np.diff(z[order])
        best = np.lexsort((-gap, np.where(gap > 0, wrong, np.inf)))[0]
        self.scale[2] -= z[order][best] + gap[best] / 2

    def score(self, texts: list[str | None]) -> np.ndarray:
        feature, window, text = windows(texts)
        n = np.bincount(window, minlength=len(text))
        s = np.bincount(window, self.weight[feature], len(text)) / np.maximum(n, 1) + self.shift
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, s)
        z = self.scale[0] * best + self.scale[1] * np.log(np.bincount(text, minlength=len(texts))) + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, modulus: int = 5, held: int = 0, per_label: int = 1600, per_text: int = 128):
    """A function from texts to scores; at most per_text windows of a text, evenly spread, are learned from, all are scored."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(learnable(known, "doc_id", modulus, held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    drawn = sample_binary(known, "y", per_label).select("doc_id", "y")

    def features(batches):
        import pyarrow as pa

        for b in text_slices(batches):
            feature, window, text = windows(b.column(1).to_pylist())
            order = np.argsort(window, kind="stable")
            feature, cuts = feature[order], np.searchsorted(window[order], np.arange(len(text) + 1))
            bags = [np.unique(feature[x:z]).astype("<i4") for x, z in zip(cuts, cuts[1:])]
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            drawn = [[bags[x + k * (z - x) // min(z - x, per_text)] for k in range(min(z - x, per_text))] for x, z in zip(ends, ends[1:])]
            sizes = [[len(w) for w in bag] for bag in drawn]
            whole = [b"".join(w.tobytes() for w in bag) for bag in drawn]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.list_(pa.int32())), pa.array(whole, pa.binary())], ["y", "h", "n", "bag"])

    # At most per_label ids of each of two labels: a bounded side to broadcast.
    rows = one_text(source.join(F.broadcast(drawn), "doc_id"), "doc_id", "y").select("y", "text", F.xxhash64("doc_id").alias("h"))
    got = sorted(rows.mapInArrow(features, "y int, h long, n array<int>, bag binary").toLocalIterator(), key=lambda r: (r.h, r.bag))
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        fixed = 0.5 if not len(y) else float(y[0])
        return lambda texts: np.full(len(texts), fixed)
    sizes = np.concatenate([r.n for r in got]).astype(np.int64)
    flat = np.frombuffer(b"".join(r.bag for r in got), "<i4")
    doc = np.repeat(np.arange(len(got)), [len(r.n) for r in got])
    del got
    return SubwordBags(flat, sizes, doc, y, share).score


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_table(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id", "text", 5, 0, 0.5)
