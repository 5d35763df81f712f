"""WARC archives of pages, written and read in chunks.

A payload becomes rows (record, chunk number, bytes) of at most CHUNK bytes, each with the SHA-1 of
all bytes so far, so nobody holds more of it than a chunk besides the row that it comes in. A payload of one chunk is one
`response` record; a longer one is segmented as the WARC standard has it: a `response` with segment 1, then `continuation` records.
Of equal payloads (by length and SHA-1) one is written; the others are `revisit` records without a payload.

Spark's own text writer writes a record a row, `\\r\\n\\r\\n` behind each, so its commit protocol covers lost executors. Every record
begins with the version line and an `Archive-ID` line with a random id of this archive; together with the end of the record before they are the
separator at which Spark's text reader takes the file apart again, in many tasks where it is not compressed. A
payload cannot hold the separator (it would have to know the id), and lengths and digests are checked.

Reading hashes what stands in the archive. Chunks of long payloads are dealt out by record and sorted by
number; a machine with one running digest reads them.

Defined results: null text is an empty payload; the response of equal payloads is the row with the largest id, null ids being
least, of several such rows the one farthest back in its files, and the others revisit it (also those with its id; a null id is
revisited as null); payloads shorter than `least` bytes are all responses; a null address is left out, blanks and controls in one
are percent signs' business; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, new_path, shuffle_tasks, table, text_slices

#: Bytes of a payload that a record holds at most.
CHUNK = 1 << 20
#: Groups of equal payloads with more than one row in so many of all are few enough to be sent to every task.
HOT = 1000
#: What stands before a payload in its (first) record.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"
_CHUNKS = "file long, at long, page_id long, url string, chunk int, chunks int, payload string, so_far string, payload_bytes long, digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces(data, size: int) -> list[tuple[int, int]]:
    """Where UTF-8 bytes are cut into parts of at most `size` bytes (4 at least), never inside a character; empty bytes are one part."""
    cuts, a = [], 0
    while len(data) - a > size:
        z = a + size
        while data[z] & 0xC0 == 0x80:
            z -= 1
        cuts.append((a, z))
        a = z
    return [*cuts, (a, len(data))]


def _placed(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """Rows with their place in their files, the same whenever they are read; a frame that reads no files is written first."""

    def placed(df: DataFrame) -> DataFrame:
        m = df.metadataColumn("_metadata")
        own = F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{text_col}`").cast("string").alias("text")
        return df.select(F.xxhash64(m["file_path"]).alias("file"), m["row_index"].alias("at"), *own)

    try:
        return placed(pages)
    except AnalysisException:
        return placed(keep(pages.select(id_col, url_col, text_col), "pages"))


def chunked(rows: DataFrame, size: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunk rows of every payload; without `payload` only the last chunk's, which has the digest and length of the whole."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        fields = [f.split(" ") for f in _CHUNKS.split(", ")]
        for b in text_slices(batches, text="text"):
            column = b.column("text")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
            data, gone = memoryview(column.buffers()[2] or b""), column.is_null().to_pylist()
            out = [[] for _ in fields]
            for i, own in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "at", "page_id", "url")))):
                text = data[0:0] if gone[i] else data[at[i] : at[i + 1]]
                cuts, digest, so_far = pieces(text, size), hashlib.sha1(), []
                for a, z in cuts:
                    digest.update(text[a:z])
                    so_far.append(base32(digest.digest()))
                for k in range(len(cuts)) if payload else [len(cuts) - 1]:
                    part = str(text[slice(*cuts[k])], "utf-8") if payload else None
                    for c, v in zip(out, (*own, k, len(cuts), part, so_far[k], len(text), so_far[-1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(out, fields)], [n for n, _ in fields])

    return rows.mapInArrow(run, _CHUNKS)


def responses(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(digest, first) for payloads that several rows have: `first` is the row they revisit. The second table has those with many rows.

    The second has fewer than HOT rows, whatever the input; with the first alone no key holds more than 1 / HOT of all rows.
    """
    digests = chunked(rows, payload=False).where(F.col("payload_bytes") >= least)
    groups = digests.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "file", "at")).alias("first"), F.count("*").alias("n"))
    groups = keep(groups.where("n > 1").select("digest", "first", "n"), "equal-payloads")
    many = F.col("n") * HOT > rows.count()
    return groups.where(~many).drop("n"), groups.where(many).drop("n")


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def separator(archive: str) -> str:
    return f"{_END}WARC/1.1\r\nArchive-ID: {archive}\r\n"


def records(rows: DataFrame, archive: str, date: str, size: int = CHUNK, least: int = 0) -> DataFrame:
    """The archive's records, one a row, without the blank lines behind each."""
    some, many = responses(rows, least)
    c = chunked(rows, size).join(F.broadcast(many.withColumnRenamed("first", "_many")), "digest", "left")
    # Rows that have found theirs spread out; the others meet theirs by digest.
    c = c.withColumn("_salt", F.when(F.col("_many").isNotNull(), 1 + F.pmod(F.xxhash64("file", "at"), F.lit(1 << 20))).otherwise(0))
    c = c.join(some.withColumnsRenamed({"first": "_some"}).withColumn("_salt", F.lit(0).cast("long")), ["digest", "_salt"], "left")
    c = c.withColumn("first", F.when(F.col("payload_bytes") >= least, F.coalesce("_many", "_some")))
    again = F.col("first").isNotNull() & ((F.col("first.file") != F.col("file")) | (F.col("first.at") != F.col("at")))
    c = c.withColumn("again", again).where("not again or chunk = 0")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    given = lambda name, value, when: F.when(when & value.isNotNull(), line(name, value)).otherwise("")
    seal = F.lit(archive)
    own, start = _id(seal, F.col("file"), F.col("at"), F.col("chunk")), _id(seal, F.col("file"), F.col("at"), F.lit(0))
    again, cut, later = F.col("again"), F.col("chunks") > 1, F.col("chunk") > 0
    block = F.when(again, HTTP).when(later, F.col("payload")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    head = F.concat(
        F.lit(separator(archive).removeprefix(_END)), line("WARC-Type", F.when(again, "revisit").when(later, "continuation").otherwise("response")), line("WARC-Record-ID", own), F.lit(f"WARC-Date: {date}\r\n"),
        given("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit(True)), given("Page-ID", F.col("page_id"), ~later),
        F.when(~later, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(""), F.when(~later, line("Payload-Length", F.col("payload_bytes"))).otherwise(""),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.when(again, line("WARC-Refers-To", _id(seal, F.col("first.file"), F.col("first.at"), F.lit(0)))).otherwise(""), given("Refers-To-Page-ID", F.col("first.page_id"), again),
        F.when(cut & ~again, F.concat(line("WARC-Segment-Number", F.col("chunk") + 1), line("Digest-So-Far", F.concat(F.lit("sha1:"), F.col("so_far"))))).otherwise(""), F.when(later, line("WARC-Segment-Origin-ID", start)).otherwise(""),
        F.when(later & (F.col("chunk") + 1 == F.col("chunks")), line("WARC-Segment-Total-Length", F.col("payload_bytes") + len(HTTP))).otherwise(""),
        F.when(later, "").otherwise(F.lit("Content-Type: application/http;msgtype=response\r\n")), line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    return c.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", *, size: int = CHUNK, least: int = 0, compression: str = "gzip") -> str:
    """Write a record for every page under path; returns the archive's id, which reading needs."""
    archive, date = uuid.uuid4().hex, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records(_placed(pages, id_col, url_col, text_col), archive, date, size, least)
    rows.write.option("lineSep", _END).option("compression", compression).text(path)
    return archive


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block; its length must be what it says, a blank line of the file's end apart."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    n = int(fields["Content-Length"])
    if block[n:] not in (b"", _END.encode()):
        raise ValueError(f"{fields['WARC-Record-ID']}: {len(block)} bytes, {n} declared")
    return fields, block[:n]


_READ = "origin string, segment int, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, so_far string, ends long, payload binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the archive; digests are those of the stored bytes.

    A revisit's are its record's. Bytes that do not fit their record's digest or length, and missing segments, are errors.
    """

    def opened(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        fields = [f.split(" ") for f in _READ.split(", ")]
        for b in text_slices(batches, text=0):
            out = [[] for _ in fields]
            for raw in b.column(0).to_pylist():
                if not raw.strip():
                    continue
                f, block = parse(raw)
                number, get = f.get("WARC-Segment-Number"), lambda k: int(f[k]) if k in f else None
                body = block if f["WARC-Type"] == "continuation" else block.partition(b"\r\n\r\n")[2]
                digest, kept = f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, None
                if number:
                    kept = body
                elif f["WARC-Type"] == "response" and (base32(hashlib.sha1(body).digest()) != digest or len(body) != get("Payload-Length")):
                    raise ValueError(f"{f['WARC-Record-ID']}: its payload is not what its digest says")
                whole = get("WARC-Segment-Total-Length")
                row = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(number or 0), get("Page-ID"), get("Payload-Length"), digest, f["WARC-Type"], get("Refers-To-Page-ID"), f.get("Digest-So-Far", "").removeprefix("sha1:"), None if whole is None else whole - len(HTTP), kept
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(out, fields)], [n for n, _ in fields])

    def joined(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        digest = first = None
        count = 0
        for b in text_slices(batches, text="payload"):
            out = []
            for i, (origin, segment, *row, so_far, ends) in enumerate(zip(*(b.column(c).to_pylist() for c in b.schema.names[:-1]))):
                if first is not None and segment < 2:
                    raise ValueError(f"{first[0]}: its last segments are missing")
                if not segment:
                    out.append(row)
                    continue
                if segment == 1:
                    digest, first, count, length = hashlib.sha1(), (origin, row), 0, 0
                count += 1
                if first is None or first[0] != origin or segment != count:
                    raise ValueError(f"{origin}: segment {segment} does not follow")
                payload = b.column("payload")[i].as_buffer()
                digest.update(payload)
                length += payload.size
                if base32(digest.digest()) != so_far:
                    raise ValueError(f"{origin}: segment {segment} is not what its digest says")
                if ends is not None:
                    if not ends == length == first[1][1] or so_far != first[1][2]:
                        raise ValueError(f"{origin}: its payload is not what its digest says")
                    out.append(first[1])
                    first = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if first is not None:
            raise ValueError(f"{first[0]}: its last segments are missing")

    raw = spark.read.option("lineSep", separator(archive)).text(path).select(F.regexp_replace(F.col("value"), "^WARC/1[.]1\r\n", "").cast("binary").alias("value"))
    rows = raw.mapInArrow(opened, _READ)
    return rows.repartition(shuffle_tasks(spark), "origin").sortWithinPartitions("origin", "segment").mapInArrow(joined, RESULT)


#: The same in DuckDB: base 32 from five hexadecimal digits, four letters, at a time.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * i, 5))::INT >> k) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM s"""


def op11_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive = write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, archive)
