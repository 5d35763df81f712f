"""Immutable fragments: one for each batch and record type, published by receipt.

A batch is written under an attempt's own name, its fragments are moved to their place, and last of all its
receipt. Readers see what receipts list, nothing else: an attempt that ended early leaves files that nobody reads. A batch that is
published again with the same rows is left as it is, with other rows refused. Rows read back carry seq = batch * 2^32 + row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RECEIPT = "batch long, fragments array<struct<record_type: string, path: string, rows: long, digest: string, files: array<struct<name: string, bytes: long>>>>"


class Folder:
    """A folder of whatever store its path names, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.root = spark.sparkContext, root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.sc._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[tuple[str, int]]:
        """(name, bytes) of a folder's entries that are not hidden, by name."""
        if not self.exists(name):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(name))]
        return sorted(e for e in found if e[0][0] not in "._")

    def move(self, a: str, b: str) -> None:
        to = self.path(b)
        self.fs.mkdirs(to.getParent())
        if self.fs.exists(to) or not self.fs.rename(self.path(a), to):
            raise FileExistsError(b)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str) -> None:
        """A small file that appears whole, or not at all if it is there."""
        own = f".{name.replace('/', '-')}-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(own), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.move(own, name)
        finally:
            self.delete(own)


def _name(batch: int, kind: str) -> str:
    return f"fragments/batch-{batch:08d}/{kind}"


def _receipt(batch: int) -> str:
    return f"receipts/batch-{batch:08d}.json"


def publish(facts: DataFrame, root: str, batch: int, by: str = "record_type", row: str = "row") -> dict:
    """Write one batch's facts, a fragment for each value of `by`, and its receipt; `row` is a fact's place in the batch."""
    spark = facts.sparkSession
    folder, own = Folder(spark, root), f".staging/batch-{batch:08d}-{uuid.uuid4().hex}"
    rows = facts.withColumn("seq", F.lit(batch).cast("long") * (1 << 32) + F.col(row))
    known = folder.exists(_receipt(batch))
    columns = [c for c in rows.columns if c != by]
    digest = lambda df: {r[by]: (r.rows, r.digest) for r in df.groupBy(by).agg(F.count("*").alias("rows"), *_digest(columns)).collect()}
    if known:
        old = {f.record_type: (f.rows, f.digest) for r in receipts(spark, root).where(F.col("batch") == batch).collect() for f in r.fragments}
        if digest(rows) != old:
            raise ValueError(f"batch {batch} was published with other rows")
        return {"batch": batch, "fragments": sorted(old), "again": True}
    try:
        rows.repartition(by).sortWithinPartitions(by, "seq").write.option("compression", "zstd").partitionBy(by).parquet(f"{root}/{own}")
        written = digest(spark.read.schema(rows.schema).parquet(f"{root}/{own}")) if rows.columns and folder.list(own) else {}
        there = {kind for kind in written if folder.exists(_name(batch, kind))}
        for kind in sorted(there):
            # An attempt that ended before its receipt left it: the same, or a conflict. Nothing is moved before all are known.
            left = spark.read.schema(rows.drop(by).schema).parquet(f"{root}/{_name(batch, kind)}").agg(F.count("*").alias("rows"), *_digest(columns)).first()
            if (left.rows, left.digest) != written[kind]:
                raise ValueError(f"batch {batch}: another fragment lies at {_name(batch, kind)}")
        listed = []
        for kind, (n, d) in sorted(written.items()):
            at = _name(batch, kind)
            if kind not in there:
                folder.move(f"{own}/{by}={kind}", at)
            listed.append({"record_type": kind, "path": at, "rows": n, "digest": d, "files": [{"name": f, "bytes": b} for f, b in folder.list(at)]})
        folder.put(_receipt(batch), json.dumps({"batch": batch, "fragments": listed}))
    finally:
        folder.delete(own)
    return {"batch": batch, "fragments": [f["record_type"] for f in listed], "again": False}


def _digest(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])
    return [F.concat_ws("-", F.sum(h.cast("decimal(20,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("digest")]


def receipts(spark: SparkSession, root: str) -> DataFrame:
    """(batch, fragments) as published; one row a batch."""
    if not Folder(spark, root).list("receipts"):
        return spark.createDataFrame([], _RECEIPT)
    return spark.read.schema(_RECEIPT).json(f"{root}/receipts/*.json")


def read_fragments(spark: SparkSession, root: str, record_type: str, schema, verify: bool = False) -> DataFrame:
    """A record type's rows of every published batch, with their seq; order by it where order matters.

    Only the files that receipts list are read; one that is missing or of another size is an error. With `verify` the rows are held against the receipts' digests.
    """
    folder, files = Folder(spark, root), []
    # One row a batch: what a file listing would hold too.
    listed = [f for r in receipts(spark, root).collect() for f in r.fragments if f.record_type == record_type]
    for f in listed:
        there = dict(folder.list(f.path))
        for part in f.files:
            if there.get(part.name) != part.bytes:
                raise ValueError(f"{f.path}/{part.name} is not the file of its receipt")
            files.append(f"{root}/{f.path}/{part.name}")
    full = schema if isinstance(schema, str) else ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in schema)
    if "seq " not in full:
        full += ", seq long"
    if not files:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(*files)
    if verify:
        h = _digest(rows.columns)
        got = {r.b: (r.rows, r.digest) for r in rows.groupBy(F.shiftright("seq", 32).alias("b")).agg(F.count("*").alias("rows"), *h).collect()}
        want = {int(f.path.split("/")[1].removeprefix("batch-")): (f.rows, f.digest) for f in listed}
        if got != want:
            raise ValueError(f"{record_type}: rows differ from the receipts of batches {sorted(b for b in want if got.get(b) != want[b])}")
    return rows


def locate(rows: DataFrame, locator: str, sha256: str | None = None, text: str = "raw") -> DataFrame:
    """The record that a locator points at; with its digest given, another content is an error."""
    found = rows.where(F.col("locator") == locator)
    if sha256 is None:
        return found
    same = F.sha2(F.col(text).cast("binary"), 256) == sha256
    return found.withColumn(text, F.when(same, F.col(text)).otherwise(F.raise_error(F.lit(f"{locator}: the record's digest differs"))))
