"""Readers of record files: CSV, newline JSON, JSON arrays and XML, all to (logical_record, locator_type, locator, value).

logical_record counts a file's records from 1 in source order. It comes from where a record stands:
the partitions' row counts are added up first and each row only adds its place in its own partition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import asn_number, ip_key
from ..operators.ordered import running
from .csvblocks import count_csv, scan_csv_blocks

# Spellings of each canonical field without blanks, signs and capitals.
ALIASES = {
    "txid": ("txid", "txhash", "transactionid", "transactionhash", "hash", "tx", "txidhex", "transaction"),
    "timestamp": ("timestamp", "time", "datetime", "ts", "eventtime", "capturetime", "capturedat", "date", "timestamputc", "eventtimestamp", "seenat", "firstseen"),
    "observed_at": ("observedat", "observertime", "receivedat"),
    "src_ip": ("srcip", "sourceip", "ipsrc", "srcaddr", "srcipaddress", "sourceipaddress", "clientip", "peerip"),
    "dst_ip": ("dstip", "destip", "destinationip", "ipdst", "dstaddr", "dstipaddress", "destinationipaddress", "serverip"),
    "src_port": ("srcport", "sourceport", "sport", "portsrc"),
    "dst_port": ("dstport", "destport", "destinationport", "dport", "portdst"),
    "input_addresses": ("inputaddresses", "inputaddress", "inaddresses", "fromaddresses", "fromaddress", "senderaddresses", "senders", "inputwallets", "inputwalletaddresses", "fromwallets", "from"),
    "output_addresses": ("outputaddresses", "outputaddress", "outaddresses", "toaddresses", "toaddress", "receiveraddresses", "receivers", "outputwallets", "outputwalletaddresses", "towallets", "to"),
    "input_amounts": ("inputamounts", "inputamount", "inamounts", "inputvalues", "invalues", "inputamountsbtc", "inputvaluesbtc", "fromamounts"),
    "output_amounts": ("outputamounts", "outputamount", "outamounts", "outputvalues", "outvalues", "outputamountsbtc", "outputvaluesbtc", "toamounts"),
    "input_amounts_sats": ("inputamountssats", "inputvaluessats", "inputamountssatoshi", "inputvaluessatoshi", "inputamountssatoshis", "inamountssats"),
    "output_amounts_sats": ("outputamountssats", "outputvaluessats", "outputamountssatoshi", "outputvaluessatoshi", "outputamountssatoshis", "outamountssats"),
    "fee": ("fee", "fees", "txfee", "transactionfee", "feebtc", "feeamount"),
    "fee_sats": ("feesats", "feesatoshi", "feesatoshis", "feeinsats"),
    "script_type": ("scripttype", "script", "addresstype", "outputscripttype", "scriptpubkeytype"),
    "geo_country": ("geocountry", "country", "countrycode", "geo", "srccountry", "sourcecountry", "geoipcountry", "ipcountry"),
    "asn": ("asn", "asnumber", "as", "srcasn", "sourceasn", "autonomoussystem", "autonomoussystemnumber"),
    "block_height": ("blockheight", "height", "block"),
    "block_time": ("blocktime", "blocktimestamp", "confirmedat"),
    "block_hash": ("blockhash",),
    "network": ("network", "chain", "net"),
    "observer_id": ("observerid", "sensor", "sensorid", "observer", "probe", "collector"),
    "inputs": (),
    "outputs": (),
}


def header_key(name: str) -> str:
    return re.sub(r"[\s_\-.\[\]()/:]", "", name).lower()


def renames(columns: list[str]) -> dict[str, str]:
    """Columns to canonical names: a canonical name is taken by a column that bears it, else by the first column that spells it."""
    spelt = {s: name for name, spellings in ALIASES.items() for s in spellings}
    out, taken = {c: c for c in columns if c in ALIASES}, {c for c in columns if c in ALIASES}
    for c in columns:
        name = spelt.get(header_key(c))
        if c not in out and name and name not in taken:
            out[c] = name
            taken.add(name)
    return {c: out[c] for c in columns if c in out}


def canonicalize(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in renames(df.columns).items() if k != v})


# The fields a source should have, each with the canonical columns that give it.
MINIMUM = {
    "timestamp": ("timestamp", "observed_at", "block_time"), "src_ip": ("src_ip",), "dst_ip": ("dst_ip",), "src_port": ("src_port",), "dst_port": ("dst_port",), "txid": ("txid",),
    "input_addresses[]": ("input_addresses", "inputs"), "output_addresses[]": ("output_addresses", "outputs"), "input_amounts[]": ("input_amounts", "input_amounts_sats", "inputs"),
    "output_amounts[]": ("output_amounts", "output_amounts_sats", "outputs"), "fee": ("fee", "fee_sats"), "script_type": ("script_type", "outputs"), "geo_country/asn": ("geo_country", "asn"),
}


def describe(columns: list[str]) -> dict:
    """What a header covers: renames, where each of the thirteen minimum fields comes from (null if nowhere), which are missing, and columns that mean nothing here."""
    found = renames(columns)
    source = {name: c for c, name in found.items()}
    covered = {field: next((f"{source[n]} -> {n}" for n in names if n in source), None) for field, names in MINIMUM.items()}
    return {"renames": {k: v for k, v in found.items() if k != v}, "minimum": covered, "missing": [f for f, c in covered.items() if c is None], "unmapped": [c for c in columns if c not in found]}


def recount(rows: DataFrame) -> DataFrame:
    """One row of counts from raw records (logical_record, txid, inputs, outputs), apart from the intake: a txid's first record counts, later ones are quarantined."""
    first = rows.groupBy("txid").agg(F.min_by(F.struct(F.coalesce(F.size("inputs"), F.lit(0)).alias("i"), F.coalesce(F.size("outputs"), F.lit(0)).alias("o")), "logical_record").alias("f"), F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return first.agg(total("n").alias("source_rows"), F.count("*").alias("transactions"), total("f.i").alias("inputs"), total("f.o").alias("outputs"), F.count("*").alias("network_observations"), total(F.col("n") - 1).alias("quarantine"))


def with_ordinal(df: DataFrame, name: str = "logical_record") -> DataFrame:
    """Number rows from 1 in source order without moving them to one partition."""
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    # One row for each partition of the scan.
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_at", "_before")


def _record(df: DataFrame, locator_type: str, locator, columns: list[str]) -> DataFrame:
    value = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return df.select("logical_record", F.lit(locator_type).alias("locator_type"), locator.alias("locator"), value.alias("value"))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files, each file read in many tasks; see csvblocks for line breaks in quotes and defined results."""
    rows, names = scan_csv_blocks(spark, path)
    last = {name: i for i, name in enumerate(names)}
    value = F.create_map(*[x for name, i in last.items() for x in (F.lit(name), F.col(f"cells.c{i}"))])
    return rows.select("logical_record", F.lit("record").alias("locator_type"), F.concat(F.lit("record:"), F.col("logical_record").cast("string")).alias("locator"), value.alias("value"))


def scan_ndjson(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object for each line that is not blank; a line that is no object fails the scan."""
    lines = with_ordinal(spark.read.text(path).where("trim(value) <> ''"))
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"})).select("logical_record", "row.*")
    columns = [c for c in parsed.columns if c != "logical_record"]
    return _record(parsed, "pointer", F.concat(F.lit("/"), (F.col("logical_record") - 1).cast("string")), columns)


def scan_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    df = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    columns = df.columns
    return _record(with_ordinal(df), "pointer", F.concat(F.lit("/"), (F.col("logical_record") - 1).cast("string")), columns)


def scan_xml(spark: SparkSession, path: str, schema: str | T.StructType, tags: tuple[str, ...] = ("transaction", "record", "row")) -> DataFrame:
    """Elements named by any of the tags, in any case and namespace, in source order; attributes count as children.

    A file is read in many tasks, in pieces that end at '>'; the pieces from one start tag to the next are put together, and the element
    among them is parsed by itself. Refused are document type and entity declarations, files without any such element, elements that are
    cut short or hold another of the tags. Comments and character data must not hold one of the tags.
    """
    name, names = r"(?:[A-Za-z_][\w.\-]*:)?", "|".join(map(re.escape, tags))
    pieces = spark.read.text(path, lineSep=">")
    meta = pieces.metadataColumn("_metadata")
    pieces = pieces.select(meta["file_path"].alias("_file"), meta["file_block_start"].alias("_from"), F.monotonically_increasing_id().alias("_nth"), F.col("value").alias("piece"))
    marked = pieces.withColumns({"_start": F.col("piece").rlike(rf"(?i)<{name}(?:{names})(?:[\s/][^<]*)?$").cast("int"), "_ban": F.col("piece").rlike("(?i)<!(?:DOCTYPE|ENTITY)").cast("int")})
    numbered = running(marked, [F.col("_file"), F.col("_from"), F.col("_nth")], {"logical_record": "_start", "_banned": "_ban"})
    whole = numbered.agg(F.max("logical_record").alias("n"), F.max("_banned").alias("banned")).first()
    if whole.banned:
        raise ValueError("document type and entity declarations are not read")
    if not whole.n:
        raise ValueError("no element is named " + ", ".join(tags))
    parts = F.array_sort(F.collect_list(F.struct("_file", "_from", "_nth", "piece")))
    texts = numbered.where("logical_record > 0").groupBy("logical_record").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["piece"]), ">"), F.lit(">")).alias("_text"))
    element = F.regexp_extract("_text", rf"""(?is)<{name}({names})(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*(?:/>|(?<!/)>.*?</{name}\1\s*>)""", 0)
    element = F.when(F.length(element) > 0, element).otherwise(F.raise_error(F.concat(F.lit("an element is cut short or holds another: "), F.substring("_text", 1, 200))))
    if not isinstance(schema, str):
        schema = schema.simpleString()
    parsed = texts.select("logical_record", F.from_xml(element, schema, {"mode": "FAILFAST", "ignoreNamespace": "true", "attributePrefix": ""}).alias("_row")).select("logical_record", "_row.*")
    columns = [c for c in parsed.columns if c != "logical_record"]
    return _record(parsed, "element", F.concat(F.lit("element:"), F.col("logical_record").cast("string")), columns)


def detect_format(path: str, first_character: str = "") -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return "json_array" if first_character == "[" else "ndjson"
    return {"csv": "csv", "ndjson": "ndjson", "jsonl": "ndjson", "xml": "xml"}.get(suffix) or _unknown(path)


def _unknown(path: str) -> str:
    raise ValueError(f"no reader for {path}")


def scan(spark: SparkSession, path: str, kind: str, schema=None) -> DataFrame:
    return {"csv": lambda: scan_csv(spark, path), "ndjson": lambda: scan_ndjson(spark, path, schema), "json_array": lambda: scan_json_array(spark, path, schema), "xml": lambda: scan_xml(spark, path, schema)}[kind]()


def count_records(spark: SparkSession, path: str, kind: str) -> int:
    """How many records a scan will give, without building them; a JSON array's file is parsed in one task."""
    if kind == "csv":
        return count_csv(spark, path)
    if kind == "ndjson":
        return spark.read.text(path).where("trim(value) <> ''").count()
    if kind == "json_array":
        return spark.read.schema("_ string").json(path, multiLine=True).count()
    # A start tag's name stands in one line, whatever follows it.
    tags = F.regexp_extract_all("value", F.lit(r"(?i)<(?:[a-z_][\w.\-]*:)?(?:transaction|record|row)(?=[\s/>]|$)"), F.lit(0))
    return spark.read.text(path).agg(F.coalesce(F.sum(F.size(tags)), F.lit(0)).alias("n")).first().n


def write_fragments(facts: DataFrame, path: str, by: str = "record_type") -> None:
    """Immutable zstd fragments, one folder for each record type; an existing path is an error."""
    facts.write.mode("errorifexists").option("compression", "zstd").partitionBy(by).parquet(path)


def write_edges_clustered(edges: DataFrame, path: str) -> None:
    """Edges laid out by their first node, so that row-group statistics skip what a neighbourhood does not touch."""
    edges.repartitionByRange("from_node").sortWithinPartitions("from_node", "edge_id").write.option("compression", "zstd").parquet(path)


def range_layout(first_line: str) -> str:
    """'country', 'asn' or 'combined' by how a range table's first line is cut."""
    tab = "\t" in first_line
    n = len(first_line.split("\t" if tab else ","))
    if tab and n == 5:
        return "combined"
    if n == 3:
        return "country"
    if n == 4 or (n >= 5 and not tab):
        return "asn"
    raise ValueError(f"no range table has {n} columns")


def read_geo_ranges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(start, end, listed, country, asn, org) of a range table: 'country' (3 columns), 'asn' (4) or 'combined' (5), comma or tab, plain or gzip.

    Bounds are dotted, colon or whole numbers of either family, given as ip_key(); `listed` grows in the order of the table. Header
    lines, ranges of unknown country and of system number 0 are left out.
    """
    names = {"country": ["start", "end", "country"], "asn": ["start", "end", "asn", "org"], "combined": ["start", "end", "asn", "country", "org"]}[kind]
    lines = spark.read.text(path).withColumn("listed", F.monotonically_increasing_id()).where("trim(value) <> '' and value not like '#%'")
    schema = ", ".join(f"{n} string" for n in names)
    cells = lines.select("listed", F.from_csv("value", schema, {"sep": ","}).alias("c"), F.from_csv("value", schema, {"sep": "\t"}).alias("t"), F.col("value").contains("\t").alias("tab"))
    rows = cells.select("listed", F.when(F.col("tab"), F.col("t")).otherwise(F.col("c")).alias("r")).select("listed", "r.*")
    missing = lambda n: F.lit(None).cast("string") if n not in names else F.nullif(F.trim(F.col(n)), F.lit(""))
    out = rows.select(ip_key(F.col("start")).alias("start"), ip_key(F.col("end")).alias("end"), "listed", F.upper(missing("country")).alias("country"), asn_number(missing("asn")).alias("asn"), missing("org").alias("org"))
    out = out.where("start is not null and end is not null and start <= end")
    known = F.coalesce(~F.col("country").isin("ZZ", "--"), F.lit(False)) if kind == "country" else F.coalesce(F.col("asn") > 0, F.lit(False))
    return out.where(known)


def replay(rows: DataFrame, locator: str) -> DataFrame:
    """The record that a locator points at."""
    return rows.where(F.col("locator") == locator)
