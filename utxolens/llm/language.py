"""Language identification by a string kernel.

The kernel is the blended spectrum of presence: the number of distinct 1- to 3-grams that two texts
share, over the root of the product of their numbers of distinct ones. Letters are lower-cased,
everything else is one blank; n-grams hash to 2**18 features. Nystrom landmarks (a few texts of each
language) turn the kernel into features, a one-versus-rest ridge regression learns the languages,
and a batch is scored by two matrix products.

It learns from at most `per_language` ids of each language, taken by the order of a hash of the
ids, with one text each (the smallest of a repeated id), and only from rows that may be learned from. Defined results: `und` with score 0 for a null
text or one without a letter, or where nothing could be learned; null ids are held in the remainder
of the empty string; repeated rows are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import gram_hash, joined, kinds, learnable, one_text, sample_by
from .common import table, text_slices

_BITS, _GRAMS = 18, (1, 2, 3)


def presence(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text; none if it has no letter."""
    points, owner = joined([t.lower() if t else t for t in texts])
    letter = kinds()["letter"][points]
    points = np.where(letter, points, np.uint32(32))
    grams = [gram_hash(points, n, _BITS) for n in _GRAMS]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    seen, some, out = np.zeros(1 << _BITS, bool), np.concatenate(([0], np.cumsum(letter))), []
    for a, b in zip(np.maximum(edges - 1, 0), edges[1:]):  # from the line feed before a text to the one after it
        if some[b] == some[a]:
            out.append(np.zeros(0, np.int64))
            continue
        for n, g in zip(_GRAMS, grams):
            seen[g[a : max(a, b - n + 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    return out


class KernelModel:
    """Landmarks and ridge weights; arrays only, so that it travels with the tasks."""

    def __init__(self, texts: list[np.ndarray], labels: list[str], per_landmark: int, ridge: float = 1e-2):
        self.names = sorted(set(labels))
        y = np.array([self.names.index(v) for v in labels])
        chosen = np.concatenate([np.flatnonzero(y == c)[:per_landmark] for c in range(len(self.names))])
        vocabulary = np.unique(np.concatenate([texts[i] for i in chosen]))
        self.column = np.full(1 << _BITS, -1, np.int32)
        self.column[vocabulary] = np.arange(len(vocabulary))
        self.size = len(vocabulary)
        self.marks = self._rows([texts[i] for i in chosen]).T.copy()
        self.norms = np.sqrt([len(texts[i]) for i in chosen])
        k_mm = self.kernel([texts[i] for i in chosen])
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.vstack([self.kernel(texts[a : a + 256]) for a in range(0, len(texts), 256)]) @ root
        phi = np.hstack((phi, np.ones((len(phi), 1))))
        target = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + ridge * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ target)
        self.weights, self.bias = root @ w[:-1], w[-1]

    def _rows(self, texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), self.size), np.float32)
        for r, t in enumerate(texts):
            c = self.column[t]
            x[r, c[c >= 0]] = 1
        return x

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        own = np.sqrt([max(1, len(t)) for t in texts])
        return (self._rows(texts) @ self.marks).astype(np.float64) / own[:, None] / self.norms[None, :]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, modulus: int = 4, held: int = 2, per_language: int = 400, landmarks: int = 32) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    rows = source.where(F.col("lang").isNotNull() & learnable(source, "doc_id", modulus, held) & F.col("text").rlike(r"\p{L}"))
    picked = sample_by(rows.select("doc_id", "lang").distinct(), "lang", per_language).select("doc_id", "lang", "rn").where("doc_id is not null")

    def features(batches):
        import pyarrow as pa

        for b in text_slices(batches):
            out = [f.astype("<i4").tobytes() for f in presence(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["lang", "rn", "grams"])

    # At most per_language ids of each language: a bounded side to broadcast.
    drawn = one_text(rows.join(F.broadcast(picked), ["doc_id", "lang"]), "lang", "rn").select("lang", "text", "rn")
    learned = drawn.mapInArrow(features, "lang string, rn int, grams binary").collect()
    learned = sorted((r for r in learned if r.grams), key=lambda r: (r.rn, r.lang, bytes(r.grams)))
    model = KernelModel([np.frombuffer(r.grams, "<i4") for r in learned], [r.lang for r in learned], landmarks) if learned else None

    def score(batches):
        import pyarrow as pa

        for b in text_slices(batches):
            texts = presence(b.column(1).to_pylist())
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if len(t)] if model else []
            for a in range(0, len(some), 128):
                part = some[a : a + 128]
                f = model.score([texts[i] for i in part])
                for i, best, s in zip(part, f.argmax(1), f.max(1)):
                    names[i], scores[i] = model.names[best], min(1.0, max(0.0, (s + 1) / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    scored = source.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (~learnable(scored, "doc_id", modulus, held)).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
