"""CSV files read and counted in many tasks, quoted line breaks included.

A file is cut into byte ranges, each with the physical lines that begin in it. Whether a line ends a
record depends on whether quotes are open before the range, which nobody knows yet; so a range is first counted under both states:
a quote flips the state, an escaped one (two quotes) flips it twice. The parities of the ranges before, one row a
range, then pick the state of each, and with it how many records came before. In the second pass every range gives its records with
their final numbers. Records that cross ranges are put together from one piece a range.

Defined results: a byte order mark is no text; lines of blanks alone, outside quotes, are no records; a quote left open at a
file's end closes there; cells beyond the header are left out, missing and empty unquoted ones are null; of equal header names the last has
its cells; a line ends at a line feed, with or without a carriage return. Every file has the same header; a file without any is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = "file string, start long, odd int, closed_0 long, closed_1 long"
_RECORD = "file string, start long, record long, text string, piece boolean"
_MARK = "﻿"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and byte range, a range's lines in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    m = rows.metadataColumn("_metadata")
    return rows.select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), "value")


def _ranges(batches):
    """Slices of Arrow batches that lie in one byte range: (file, start, batch)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file"), b.column("start").to_numpy()
        other = np.concatenate(([True], pc.not_equal(file.slice(1), file.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) | (start[1:] != start[:-1])))
        cuts = [*np.flatnonzero(other).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield file[a].as_py(), int(start[a]), b.slice(a, z - a)


def _states(values, odd: int):
    """(quotes open before, after, blank) of each line, if they are open before the first as `odd` says."""
    import numpy as np
    import pyarrow.compute as pc

    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
    after = (np.cumsum(quotes) + odd) & 1
    before = np.concatenate(([odd], after[:-1]))
    return before, after, pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a byte range: whether it flips the state, and how many records end in it from either state."""

    def count(batches):
        import pyarrow as pa

        def row(held):
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("file", "start", "odd", "closed_0", "closed_1"), held)}, pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.int32()), ("closed_0", pa.int64()), ("closed_1", pa.int64())]))

        held = None
        for file, start, b in _ranges(batches):
            if held is None or held[:2] != [file, start]:
                if held is not None:
                    yield row(held)
                held = [file, start, 0, 0, 0]
            before, after, blank = _states(b.column("value"), held[2])
            gone = blank & (before == after)
            held[3] += int(((after == 0) & ~(gone & (before == 0))).sum())
            held[4] += int(((after == 1) & ~(gone & (before == 1))).sum())
            held[2] = int(after[-1])
        if held is not None:
            yield row(held)

    return _lines(spark, path).mapInArrow(count, _BLOCK)


def placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, state, ahead, records, ends_open): the state before each range, records that end before it (in its file, headers included), in it, and whether it ends inside quotes."""
    b = blocks(spark, path)
    # One row for each byte range of the scan.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)).cast("int") % 2)
    b = b.withColumn("records", F.when(F.col("state") == 0, F.col("closed_0")).otherwise(F.col("closed_1"))).withColumn("ends_open", (F.col("state") + F.col("odd")) % 2 == 1)
    b = b.withColumn("ahead", F.coalesce(F.sum("records").over(before), F.lit(0)))
    # A quote that is still open where the file ends closes there.
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("start"))) == 1
    b = b.withColumn("records", F.col("records") + (last & F.col("ends_open")).cast("int"))
    return b.select("file", "start", "state", "ahead", "records", "ends_open")


def count_csv(spark: SparkSession, path: str) -> int:
    """Records of the files without their headers; no record is built."""
    files = placed_blocks(spark, path).groupBy("file").agg(F.sum("records").alias("n"))
    return files.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("n")).first().n


def _pieces(lines: DataFrame) -> DataFrame:
    """Records that begin and end in a byte range (piece: false), and what else of records stands in it (true)."""

    def cut(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [f.split(" ")[0] for f in _RECORD.split(", ")]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        at, odd, number, held, begun = None, 0, 0, [], True
        for file, start, b in _ranges(batches):
            out = []
            if at != (file, start):
                if held:
                    out.append((*at, number, "\n".join(held), True))
                at, odd, number, held = (file, start), b.column("state")[0].as_py(), b.column("ahead")[0].as_py() + 1, []
                begun = odd == 0
            before, after, blank = _states(b.column("value"), odd)
            for value, x, y, empty in zip(b.column("value").to_pylist(), before.tolist(), after.tolist(), blank.tolist()):
                if not x and not y and empty:
                    continue
                held.append(value)
                if not y:
                    out.append((file, start, number, "\n".join(held), not begun))
                    number, held, begun = number + 1, [], True
            odd = int(after[-1])
            if out:
                yield rows(out)
        if held:
            yield rows([(*at, number, "\n".join(held), True)])

    return lines.mapInArrow(cut, _RECORD)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): every record's raw text and its number in its file, from 1; the first is the header."""
    places = placed_blocks(spark, path)
    at, lines = ["file", "start"], _lines(spark, path)
    # One row for each byte range of the scan.
    whole = _pieces(lines.join(F.broadcast(places.select(*at, "state", "ahead")), at).select(*at, "value", "state", "ahead")).where("not piece")
    crossed = places.where("state = 1 or ends_open").select(*at, "state", "ahead")
    parts = _pieces(lines.join(F.broadcast(crossed), at).select(*at, "value", "state", "ahead")).where("piece")
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p")).select("file", "record", F.array_join("p.text", "\n").alias("text"))
    return whole.select("file", "record", "text").unionByName(joined)


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of the first file that has one."""
    import csv

    rows = spark.read.option("lineSep", "\n").text(path)
    n = 16
    while True:
        lines = [r.value for r in rows.head(n)]
        if lines:
            lines[0] = lines[0].removeprefix(_MARK)
        text, odd = [], 0
        for line in lines:
            if odd or line.strip():
                text.append(line)
                odd ^= line.count('"') & 1
                if not odd:
                    break
        if text and not odd or len(lines) < n:
            break
        n *= 4
    names = next(csv.reader(["\n".join(text).rstrip("\r")]), []) if not odd else next(csv.reader("\n".join(text).splitlines(True)), [])
    if not names:
        raise ValueError("a CSV source needs a header")
    return names


def scan_csv_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(logical_record, one struct `cells` of c0, c1, ...) and the header's names; records count on over files in order of their paths."""
    names = header(spark, path)
    records = csv_records(spark, path)
    places = placed_blocks(spark, path).groupBy("file").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("n"))
    # One row a file.
    places = places.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    cells = F.from_csv(F.regexp_replace("text", "\r$", ""), ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true", "sep": ","})
    first = F.regexp_replace(F.regexp_replace("text", "\r$", ""), f"^{_MARK}", "")
    same = F.from_csv(first, ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true"})
    wrong = F.array_join(F.transform(F.array(*[same[f"c{i}"] for i in range(len(names))]), lambda c: F.coalesce(c, F.lit(""))), "\x1f") != "\x1f".join(names)
    # A header that differs fails the scan.
    checked = F.when((F.col("record") == 1) & wrong, F.raise_error(F.lit("the files' headers differ"))).otherwise(F.col("record"))
    rows = records.join(F.broadcast(places), "file").withColumn("record", checked.cast("long")).where("record > 1")
    return rows.select((F.col("base") + F.col("record") - 1).alias("logical_record"), cells.alias("cells")), names
