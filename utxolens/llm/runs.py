"""Periodic runs of words.

A run is a maximal stretch of words with smallest period p that is at least four periods and six words
long. Its equalities w[i] = w[i + p] span three periods, so three neighbouring points of the grid
0, p, 2p, ... must agree with the next one: the word at j p with that at (j + 1) p. All periods up to a quarter of
the text take n (1 + 1/2 + 1/3 + ...) such tests, done as arrays for the periods of one octave at a time. Survivors are
extended to both sides by comparing arrays whose length doubles. Points inside a run that is known, of this period or of a
divisor of it, are skipped: the stretch around them is that run.

Defined results: a null or blank text has no words (no run, four nulls, digests of empty strings); a null id leaves its text as it
is; rows that repeat are computed each by itself; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

#: A run has at least so many periods and words.
PERIODS, WORDS = 4, 6
#: Cells of the grid that are tested at once.
CELLS = 1 << 20


def _extent(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The largest a <= i < b with w[k] = w[k + p] for all a <= k < b; w[i] = w[i + p] holds."""
    b, step, top = i + 1, 16, len(w) - p
    while b < top:
        e = min(b + step, top)
        differ = w[b:e] != w[b + p : e + p]
        if differ.any():
            b += int(differ.argmax())
            break
        b, step = e, step * 2
    a, step = i, 16
    while a > 0:
        s = max(0, a - step)
        differ = (w[s:a] != w[s + p : a + p])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, step = s, step * 2
    return a, b


def _survivors(w: np.ndarray, low: int, high: int, period: np.ndarray, end: np.ndarray):
    """(period, first point) for every three neighbouring grid points of a period in low..high - 1 that agree with their next.

    All words of two periods from there must agree with their next too if a run holds the three: some of them are tried. Points
    inside a run of a divisor (`period` and `end` of a run over each place) are left out.
    """
    n = len(w)
    wide = max(1, CELLS // (n // low + 1))
    for at in range(low, high, wide):
        periods = np.arange(at, min(high, at + wide))
        points = np.arange(n // at + 1)[:, None] * periods
        words = w[np.minimum(points, n - 1)]
        equal = (words[:-1] == words[1:]) & (points[1:] < n)
        k, j = np.nonzero((equal[:-2] & equal[1:-1] & equal[2:]).T)
        p, i = periods[k], points[j, k]
        known = (period[i] > 0) & (p % np.maximum(period[i], 1) == 0) & (i + p < end[i])
        p, i = p[~known], i[~known]
        for part in (1, 3, 5, 7, 9, 11):
            spot = i + p * part // 6
            same = w[spot] == w[spot + p]
            p, i = p[same], i[same]
        yield from zip(p.tolist(), i.tolist())


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(w)
    runs: dict[tuple[int, int], int] = {}
    # Of the runs over a place, the one that was found first: its period and end.
    period, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = 1
    while low <= n // PERIODS:
        high = min(2 * low, n // PERIODS + 1)
        last, skip = 0, -1
        for p, i in _survivors(w, low, high, period, end):
            if p != last:
                last, skip = p, -1
            if i < skip:
                continue
            a, b = _extent(w, i, p)
            skip, e = b, b + p
            if e - a < max(WORDS, PERIODS * p) or p % runs.setdefault((a, e), p) == 0 and runs[a, e] < p:
                continue
            free = period[a:e] == 0
            period[a:e][free], end[a:e][free] = p, e
        low = high
    return sorted((a, e - a, p) for (a, e), p in runs.items())


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def folded(n: int, key: int | None) -> np.ndarray | None:
    """The word that stands at each place of a text in ten, None where the text stays: from place a on, p words repeat."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _row(key, text, fold: bool) -> tuple:
    words = words_of(text)
    at = folded(len(words), key) if fold else None
    if at is not None:
        words = [words[i] for i in at.tolist()]
    runs = find_runs(numbered(words))
    keep = collapse(len(words), runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = [words[i] for i in np.flatnonzero(keep).tolist()] if runs else words
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: bool = False) -> DataFrame:
    """The runs of every text: how many, the longest, and digests of all runs and of the text with each run reduced to one period.

    With `fold` one text in ten (by its id) is first made to repeat some of its own words.
    """

    def run(batches):
        import pyarrow as pa

        types = [pa.int64()] * 6 + [pa.string()] * 2
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        for b in text_slices(batches):
            rows = [_row(k, t, fold) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, RESULT)


def collapsed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each run of a text reduced to its first period, words joined by single spaces; texts without runs stay as they are."""

    @F.pandas_udf("string")
    def reduced(texts):
        def one(text):
            words = words_of(text)
            runs = find_runs(numbered(words))
            return b" ".join([words[i] for i in np.flatnonzero(collapse(len(words), runs)).tolist()]).decode() if runs else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, reduced(F.col(text_col)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), fold=True)
