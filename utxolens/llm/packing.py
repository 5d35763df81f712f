"""Harmonic packing of token ids into fixed-capacity sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and each of
its bins takes exactly k pieces. Every worker fills its classes' bins alone, so there is no shuffle
and a lost task is simply run again. A document longer than C gives up whole sequences first; what is
left of it, and every other document, stays whole in its class. A full bin's gap takes the
longest of the worker's waiting short documents that fit, and then, if more than `waste` of the
bin is still empty, the next ids of one document that is cut up for this (the filler), so few documents are cut. The
bins a worker leaves unfilled are joined end to end and cut at C; its very last sequence is cut
at powers of two, which need no padding.

Defined results: null text is empty text (its document is the one end id); null ids stay null;
repeated rows are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Harmonic:
    """One worker's bins; add() and finish() give (sequence, offset, piece), a piece being (doc, start, length, rest).

    cut(piece, n) gives a piece's first n ids and the rest. At most `waiting` short pieces (an eighth of C or less) are
    held back for gaps; a class's open bin holds its pieces until it is full.
    """

    def __init__(self, capacity: int, first: int, cut, waste: float = 0.01, waiting: int = 1024):
        self.capacity, self.next, self.cut, self.spare, self.waiting = capacity, first, cut, int(waste * capacity), waiting
        self.open: dict[int, list] = {}
        self.short: list[tuple] = []  # (length, order, piece), ascending
        self.filler, self.order = None, 0

    def _bin(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield self.next, at, p
            at += p[2]
        self.next += 1

    def _fill(self, pieces: list) -> list:
        gap = self.capacity - sum(p[2] for p in pieces)
        while gap and self.short and (i := bisect_right(self.short, (gap, self.order))):
            pieces.append(self.short.pop(i - 1)[2])
            gap -= pieces[-1][2]
        while gap > self.spare and self.filler:
            piece, self.filler = (self.filler, None) if self.filler[2] <= gap else self.cut(self.filler, gap)
            pieces.append(piece)
            gap -= piece[2]
            if self.filler is None and self.open:  # the next one comes out of an open bin
                k = min(self.open)
                self.filler = self.open[k].pop()
                if not self.open[k]:
                    del self.open[k]
        return pieces

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Place a document, whole sequences of it first."""
        while piece[2] > self.capacity:
            head, piece = self.cut(piece, self.capacity)
            yield from self._bin([head])
        k = self.capacity // piece[2]
        if k >= 8 and len(self.short) < self.waiting:
            self.order += 1
            insort(self.short, (piece[2], self.order, piece))
        elif self.filler is None and piece[2] < self.capacity - self.spare:
            self.filler = piece
        else:
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                del self.open[k]
                yield from self._bin(self._fill(bin_))

    def finish(self) -> Iterator[tuple]:
        """Join what is left end to end."""
        left = [p for k in sorted(self.open) for p in self.open[k]] + [s[2] for s in self.short] + ([self.filler] if self.filler else [])
        self.open, self.short, self.filler = {}, [], None
        total = sum(p[2] for p in left)
        todo = left[::-1]
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            bin_ = []
            while room:
                p = todo.pop()
                if p[2] > room:
                    p, rest = self.cut(p, room)
                    todo.append(rest)
                bin_.append(p)
                room -= p[2]
            yield from self._bin(bin_)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 1, waste: float = 0.01, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place; with_ids adds the ids themselves (array<int>)."""
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        cut = lambda p, n: ((p[0], p[1], n, p[3], p[4][: 4 * n]), (p[0], p[1] + n, p[2] - n, p[3], p[4][4 * n :]))
        bins = Harmonic(capacity, TaskContext.get().partitionId() << 40, cut, waste)

        def rows(placed):
            cols = list(zip(*((p[0], p[1], p[2], zlib.crc32(p[4]), p[3], seq, at) for seq, at, p in placed))) or [()] * len(names)
            out = {n: pa.array(c, pa.int64()) for n, c in zip(names, cols)}
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(p[4], "<u4").astype("i4") for _, _, p in placed], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(out)

        for b in text_slices(batches):
            placed = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder(path).batch(b.column(1).to_pylist())):
                ids += end
                placed += bins.add((doc, 0, len(ids) // 4, len(ids) // 4, ids))
            yield rows(placed)
        yield rows(list(bins.finish()))

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
