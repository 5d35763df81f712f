"""Readers and counters of record files against the standard library."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from utxolens.sources import csvblocks, files


@pytest.fixture
def small_blocks(spark):
    """Files are read in byte ranges of some hundred bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(text):
    """Records by the standard library, lines of blanks alone left out, empty cells as null."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if any(c.strip() for c in r)]
    names = rows[0]
    return [{n: (r[i] if i < len(r) else None) or None for i, n in enumerate(names)} for r in rows[1:]]


def written(path, rnd, n, end):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "a b", "note\nmore", "last"])
    for i in range(n):
        note = rnd.choice(["", "x", 'say "so"', "one\ntwo", "a,b", "\n\n", "é🙂\n" * rnd.randint(1, 60), '"', "\r\n in"])
        w.writerow([i + 1, rnd.choice(["", "v", "  v "]), note, "z" * rnd.randint(1, 90)])
        if rnd.random() < 0.1:
            out.write(rnd.choice(["", "  "]) + end)
    text = out.getvalue()
    path.write_bytes(text.encode())
    return text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_is_read_in_many_tasks(small_blocks, tmp_path, end):
    spark, rnd = small_blocks, random.Random(len(end))
    text = written(tmp_path / "a.csv", rnd, 200, end)
    path = str(tmp_path / "a.csv")
    assert csvblocks.blocks(spark, path).count() > 20
    got = files.scan_csv(spark, path).orderBy("logical_record").collect()
    want = plain(text)
    assert [r.logical_record for r in got] == list(range(1, len(want) + 1))
    assert [r.value for r in got] == want and got[4].locator == "record:5"
    assert files.count_records(spark, path, "csv") == len(want)


def test_csv_with_mark_open_quote_short_and_long_rows(small_blocks, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿k,v,k\n\n1,2,3\n4\n5,6,7,8\n9,\"open\nto the end\n".encode())
    got = files.scan_csv(small_blocks, str(path)).orderBy("logical_record").collect()
    assert [(r.value["k"], r.value["v"]) for r in got] == [("3", "2"), (None, None), ("7", "6"), (None, "open\nto the end")]
    assert files.count_records(small_blocks, str(path), "csv") == 4


def test_csv_folders_count_on_and_headers_must_agree(small_blocks, tmp_path):
    for name, rows in (("a", "1\n2\n"), ("b", ""), ("c", "3\n")):
        (tmp_path / f"{name}.csv").write_text("n\n" + rows)
    got = files.scan_csv(small_blocks, str(tmp_path)).orderBy("logical_record").collect()
    assert [(r.logical_record, r.value["n"]) for r in got] == [(1, "1"), (2, "2"), (3, "3")]
    assert files.count_records(small_blocks, str(tmp_path), "csv") == 3
    (tmp_path / "d.csv").write_text("other\n4\n")
    with pytest.raises(Exception, match="headers differ"):
        files.scan_csv(small_blocks, str(tmp_path)).collect()


def test_csv_without_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n  \n")
    with pytest.raises(ValueError, match="header"):
        files.scan_csv(spark, str(tmp_path / "a.csv"))


def test_counts_equal_scans(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"k": "1"}\n\n  \n{"k": "2"}\n')
    (tmp_path / "a.json").write_text('[{"k": "1"},\n {"k": "2"}, {"k": "3"}]')
    (tmp_path / "a.xml").write_text('<records><record><k>1</k></record>\n<record\n a="1"><k>2</k></record><Row/></records>')
    for name, kind, n in (("a.ndjson", "ndjson", 2), ("a.json", "json_array", 3), ("a.xml", "xml", 3)):
        assert files.count_records(spark, str(tmp_path / name), kind) == n
        if kind != "xml":
            assert files.scan(spark, str(tmp_path / name), kind, "k string").count() == n


def test_headers_are_described_by_thirteen_fields():
    got = files.describe(["Timestamp", "Source IP", "Destination Port", "TxID", "From Addresses", "Output Values", "Country", "AS Number", "extra"])
    assert len(got["minimum"]) == 13 and got["minimum"]["src_ip"] == "Source IP -> src_ip" and got["unmapped"] == ["extra"]
    assert got["missing"] == ["dst_ip", "src_port", "output_addresses[]", "input_amounts[]", "fee", "script_type"]
    full = files.describe(["txid", "observed_at", "inputs", "outputs", "asn", "fee_sats", "src_ip", "dst_ip", "src_port", "dst_port"])
    assert full["missing"] == [] and full["minimum"]["script_type"] == "outputs -> outputs" and full["renames"] == {}


def test_recounts_take_each_first_record(spark):
    rows = spark.createDataFrame([(2, "a", ["x"], None), (1, "a", ["x", "y"], ["z"]), (3, "b", [], ["z"])], "logical_record long, txid string, inputs array<string>, outputs array<string>")
    assert tuple(files.recount(rows).first()) == (3, 2, 2, 2, 2, 1)
    assert tuple(files.recount(rows.limit(0)).first()) == (0,) * 6


def test_xml_elements_of_any_case_and_namespace_in_source_order(spark, tmp_path):
    body = ('<?xml version="1.0"?><n:set xmlns:n="u">\n<Row><k>1</k><v>a</v></Row><n:TRANSACTION k="2" v="x&gt;y > z"/>text<!-- a comment -->\n'
            '<record\n  k="3"\n><n:v>b &lt; c</n:v><other><deep/></other></record>\n<row k="4"></row><rowing>no</rowing><row-x/></n:set>')
    (tmp_path / "a.xml").write_text(body)
    got = sorted(files.scan_xml(spark, str(tmp_path / "a.xml"), "k string, v string").collect(), key=lambda r: r.logical_record)
    assert [(r.logical_record, r.locator, r.value["k"], r.value["v"]) for r in got] == [(1, "element:1", "1", "a"), (2, "element:2", "2", "x>y > z"), (3, "element:3", "3", "b < c"), (4, "element:4", "4", None)]
    assert files.count_records(spark, str(tmp_path / "a.xml"), "xml") == 4


def test_a_long_xml_file_is_read_in_many_tasks(spark, tmp_path):
    names = ("record", "Row", "x:transaction")
    (tmp_path / "b.xml").write_text("<all xmlns:x='u'>" + "".join(f"<{(t := names[i % 3])}><k>{i}</k></{t}>" for i in range(3000)) + "</all>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "b.xml"), lineSep=">").rdd.getNumPartitions() > 3
        got = {r.logical_record: r.value["k"] for r in files.scan_xml(spark, str(tmp_path / "b.xml"), "k string").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: str(i) for i in range(3000)}


@pytest.mark.parametrize("text", ["<a><b/></a>", "<!doctype x><a><row/></a>", "<a><row><k>1</k></a>", "<a><record><row/></record></a>", ""])
def test_xml_that_is_refused(spark, tmp_path, text):
    (tmp_path / "c.xml").write_text(text)
    with pytest.raises(Exception, match="named|declarations|cut short"):
        files.scan_xml(spark, str(tmp_path / "c.xml"), "k string").collect()
