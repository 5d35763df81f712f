"""Texts as arrays of code points, so that n-grams and tokens of a whole batch are numpy operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOP = 0x110000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(None)
def kinds() -> dict[str, np.ndarray]:
    """Tables over code points: letter, alnum, space, upper, digit."""
    planes = [chr(i) for i in range(0x32000)]  # above lie no letters but private and tag ones
    out = {}
    for name, test in (("letter", str.isalpha), ("alnum", str.isalnum), ("space", str.isspace), ("upper", str.isupper), ("digit", str.isdigit)):
        out[name] = np.zeros(_TOP, bool)
        out[name][: len(planes)] = [test(c) for c in planes]
    return out


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed before, between and after them, and the index of each one's text."""
    texts = [t or "" for t in texts]
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    return points, np.concatenate((owner[:1] * 0, owner)) if len(texts) else np.zeros(len(points), np.int64)


def gram_hash(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n-gram at each place but the last n - 1."""
    size = max(0, len(points) - n + 1)
    h = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h *= _MIX
            h += points[k : k + size]
            h ^= h >> np.uint64(29)
        h *= _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def learnable(table: DataFrame, id_col: str, modulus: int, held: int):
    """True for rows that may be learned from: crc32 of the id's text is not `held` modulo `modulus`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus != held


def sample_by(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most per_label rows of each label, by the order of a hash of doc_id, with their place (rn).

    A label's rows are counted first; only those whose hash lies below what four times per_label rows need are put in
    order, so a label that holds most of the table is no larger a task than any other.
    """
    place = F.xxhash64("doc_id").bitwiseAND((1 << 62) - 1)
    counts = labelled.groupBy(label).agg(F.count("*").alias("_n")).select(label, (F.lit(4.0 * per_label * (1 << 62)) / F.col("_n")).alias("_below"))
    few = labelled.join(counts, label).where(place <= F.col("_below")).drop("_below")
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id").bitwiseAND((1 << 62) - 1), "doc_id")
    return few.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_label)


def sample_binary(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most per_label rows of label 0 and of label 1 in the same order; each task gives its own first ones only."""
    top = [labelled.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    return top[0].unionByName(top[1])


def one_text(drawn: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys, with its smallest text (null only if it has no other)."""
    return drawn.groupBy(*keys).agg(F.min("text").alias("text"))
