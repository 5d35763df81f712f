"""Token-id shards with a minimal perfect hash index.

A shard is two files. `*.ids` holds the raw little-endian ids of its documents in ascending key order,
16 bits each where the vocabulary fits and 32 otherwise. `*.mph` holds a JSON header line and the index arrays: the key of each
document, the offset and length of its ids, the bit levels of a minimal perfect hash, and per slot
a 32-bit fingerprint of the key and its document's row. Access by key is one hash, one fingerprint
compare and one ranged read. Files are written under an attempt's own name and moved into
place, so a task that is run again after a lost executor replaces whole files.

Defined results: null text is empty (one end id); a null key sorts first, is stored and read back,
and has no index entry; rows that repeat a key are all stored, ordered by text, and keyed
access gives the first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, new_path, table, text_slices
from .tokens import default_vocabulary, encoder

#: Slots a level has for each key still unplaced, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 40


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of keys, one function for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class MinimalPerfectHash:
    """Distinct 64-bit keys to 0..n-1: at each level a key alone in its slot sets the slot's bit; slots are ranked."""

    sizes: list[int]
    bits: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            slot = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool), np.sort(left))

    def __post_init__(self):
        self.rank = np.concatenate(([0], np.cumsum(self.bits))).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; for keys that were not built in, any slot or -1."""
        keys = keys.astype(np.uint64)
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo, base = todo[~hit], base + size
        if len(self.rest) and len(todo):
            i = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[i] == keys[todo]
            out[todo[hit]] = self.rank[-1] + i[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard opened for reading: keyed and sequential access."""

    def __init__(self, directory: str, name: str):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(directory)
        self.ids_path = f"{base}/{name}.ids"
        with self.fs.open_input_file(f"{base}/{name}.mph") as f:
            raw = f.read()
        end = raw.index(b"\n")
        head, at, arrays = json.loads(raw[:end]), end + 1, {}
        for key, kind, n in head["arrays"]:
            arrays[key] = np.frombuffer(raw, kind, n, at)
            at += arrays[key].nbytes
        self.has_null, self.width = head["null_keys"], head["width"]
        self.keys, self.offsets, self.lengths, self.prints, self.rows = (arrays[k] for k in ("keys", "offsets", "lengths", "prints", "rows"))
        self.hash = MinimalPerfectHash(head["sizes"], np.unpackbits(arrays["bits"], count=sum(head["sizes"])).astype(bool), arrays["rest"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where the stored fingerprint, or the key behind it, says it is not here."""
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        ok[ok] = self.keys[self.rows[slot[ok]]] == keys[ok]
        return np.where(ok, self.rows[np.where(ok, slot, 0)] if len(self.rows) else -1, -1)

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.find(np.array([key], np.int64))[0])
        if row < 0:
            return None
        with self.fs.open_input_file(self.ids_path) as f:
            return self.read(f, row)

    def read(self, f, row: int) -> np.ndarray:
        """The ids of a row from the opened payload, unsigned 32-bit."""
        raw = f.read_at(int(self.lengths[row]) * self.width, int(self.offsets[row]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_shards(df: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write every document's ids in ascending key order; one row for each shard, with the ids of all shards before it."""
    path, end = vocabulary or default_vocabulary(), np.array([end_id], "<u4")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        task = TaskContext.get()
        name, own = f"shard-{task.partitionId():06d}", f"-attempt-{task.taskAttemptId()}"
        fs, base = pafs.FileSystem.from_uri(directory)
        keys, lengths, out = [], [], None
        width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for b in text_slices(batches):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.ids{own}")
            keys += b.column(0).to_pylist()
            for ids in encoder(path).batch(b.column(1).to_pylist()):
                out.write(np.concatenate((np.frombuffer(ids, "<u4"), end)).astype(f"<u{width}").tobytes())
                lengths.append(len(ids) // 4 + 1)
        if out is None:
            return
        out.close()
        n_null = sum(k is None for k in keys)
        sizes = np.array(lengths, np.int64)
        key = np.array([k or 0 for k in keys], np.int64)
        distinct, row = np.unique(key[n_null:], return_index=True)
        mph = MinimalPerfectHash.build(distinct.astype(np.uint64))
        slot = mph.slots(distinct)
        prints, rows = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
        prints[slot], rows[slot] = fingerprints(distinct), row + n_null
        arrays = {"keys": key, "offsets": np.cumsum(sizes) - sizes, "lengths": sizes, "prints": prints, "rows": rows, "bits": np.packbits(mph.bits), "rest": mph.rest}
        with fs.open_output_stream(f"{base}/{name}.mph{own}") as f:
            f.write(json.dumps({"sizes": mph.sizes, "null_keys": n_null, "width": width, "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}).encode() + b"\n")
            for a in arrays.values():
                f.write(a.tobytes())
        for kind in ("ids", "mph"):
            done = f"{base}/{name}.{kind}"
            if fs.get_file_info(done).type != pafs.FileType.NotFound:
                fs.delete_file(done)
            fs.move(done + own, done)
        yield pa.RecordBatch.from_pydict({"shard": [name], "min_key": pa.array([keys[n_null] if n_null < len(keys) else None], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([int(sizes.sum())], pa.int64())})

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = keep(ordered.mapInArrow(run, "shard string, min_key long, n_docs long, n_ids long"), "shards")
    before = Window.orderBy(F.col("min_key").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame, directory: str) -> DataFrame:
    """Every document of every shard, found by its key through the index, with a digest of its ids."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                s = Shard(directory, name)
                row = np.arange(len(s.keys))
                found = s.find(s.keys[s.has_null :]) + 0
                same = s.keys[found] == s.keys[s.has_null :]
                first = np.searchsorted(s.keys[s.has_null :], s.keys[s.has_null :]) + s.has_null
                if not (same.all() and (found == first).all()):
                    raise ValueError(f"{name}: the index does not lead to its own keys")
                at = np.concatenate((row[: s.has_null], found + (row[s.has_null :] - first)))
                start, size = s.offsets[at], s.lengths[at]
                with s.fs.open_input_file(s.ids_path) as f:
                    crc = [zlib.crc32(s.read(f, row)) for row in at]
                keys = pa.array(s.keys, pa.int64(), mask=row < s.has_null)
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + base), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_path(spark, "ids")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), directory), directory)
