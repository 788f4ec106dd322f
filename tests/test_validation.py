"""Intake checks: sample files of every kind, edges of each rule, batch rules."""

import pytest
from pyspark.sql import functions as F

from docmark import dims
from docmark.functions import binary, names
from docmark.limits import Limits
from docmark.operators import errors, validation

ZIP = b"PK\x03\x04"
BAD = dims.MISMATCH

SAMPLES = [
    ("document.pdf", b"%PDF-1.4 fake pdf content", None),
    ("report.pdf", b"MZ" + bytes(50), BAD),
    ("malware.exe", ZIP, dims.UNSUPPORTED),
    ("report.docx", ZIP + bytes(20), None),
    ("notes.txt", b"Hello world", None),
    ("notes.txt", bytes(range(256)), BAD),
    ("script.sh", b"#!/bin/bash", dims.UNSUPPORTED),
    ("document.pdf", b"<html><body>Not a PDF</body></html>", BAD),
    ("report.xlsx", ZIP + bytes(20), None),
    ("data.csv", b"col1,col2\nval1,val2", None),
    ("config.json", b'{"key": "value"}', None),
    ("data.xml", b"<root><item>test</item></root>", None),
    ("index.html", b"<html><body>hello</body></html>", None),
    ("report.docx", b"Not a zip file", BAD),
    ("report.xlsx", b"Not a zip file", BAD),
    ("exploit.json", ZIP + b"filecontent", BAD),
    ("exploit.xml", b"%PDF-1.4filecontent", BAD),
    # edges
    ("x.pdf", b"%pdf lower case", None),
    ("x.txt", b"%pdf lower case", None),
    ("x.docx", b"pk\x03\x04", BAD),
    ("nodot", b"text", dims.UNSUPPORTED),
    ("A.TXT", b"text", None),
    ("page.HTM", b"text", None),
    (".pdf", b"%PDF", None),
    ("empty.txt", b"", None),
    ("empty.pdf", b"", BAD),
    ("cut.txt", b"a" * 511 + "é".encode(), BAD),
    ("fits.txt", b"a" * 510 + "é".encode() + b"x", None),
    ("late.txt", b"a" * 512 + b"\xff", None),
    ("overlong.txt", b"\xc0\xaf", BAD),
    ("surrogate.txt", b"\xed\xa0\x80", BAD),
]


def uploads(spark, rows):
    data = [(i, n, bytearray(c), len(c)) for i, (n, c) in enumerate(rows)]
    return spark.createDataFrame(data, "id int, filename string, content binary, length long")


def test_samples(spark):
    df = uploads(spark, [(n, c) for n, c, _ in SAMPLES])
    got = {r.id: r.error for r in validation.checked_uploads(df).collect()}
    assert [got[i] for i in range(len(SAMPLES))] == [e for _, _, e in SAMPLES]
    accepted, quarantine = validation.validate_uploads(df)
    assert accepted.count() == sum(e is None for *_, e in SAMPLES)
    assert "content" not in quarantine.columns


def test_size_comes_first_and_the_limit_passes(spark):
    df = uploads(spark, [("a.txt", b"12345"), ("a.txt", b"123456"), ("a.exe", b"123456")])
    got = validation.checked_uploads(df, Limits(max_upload_bytes=5)).orderBy("id").collect()
    assert [r.error for r in got] == [None, dims.TOO_LARGE, dims.TOO_LARGE]


def test_tolerating_a_cut_character_only(spark):
    rows = [
        ("a", b"a" * 511 + "é".encode()), ("b", b"a" * 510 + "€".encode()),
        ("c", b"a" * 509 + "😀".encode() + b"\xff"), ("d", b"a" * 511 + b"\xff"),
        ("e", b"a" * 511 + b"\xc3"), ("f", b"\xff"), ("g", b"")]
    df = uploads(spark, rows).withColumn(
        "ok", binary.utf8_prefix_ok(F.col("content"), tolerate_cut=True))
    assert [r.ok for r in df.orderBy("id").collect()] == [True, True, True, False, False, False, True]


def test_signature_order_and_case(spark):
    rows = [b"<HTML>", b"<!doctype html>", b"[1]", b"{", b"<?XML", b"PK\x03\x04", b"plain", b"%PDF"]
    df = uploads(spark, [("f", c) for c in rows]).withColumn(
        "m", binary.match_signature(F.col("content")))
    assert [r.m for r in df.orderBy("id").collect()] == [
        "text/html", "text/html", "application/json", "application/json", "application/xml",
        dims.DOCX, None, dims.PDF]


@pytest.mark.parametrize("name, ext, suffix, out", [
    ("a.TXT", ".txt", ".txt", "a.md"), (".pdf", ".pdf", "", ".pdf.md"), ("a.", ".", "", "a..md"),
    ("a.tar.gz", ".gz", ".gz", "a.tar.md"), ("plain", "", "", "plain.md"),
    ("..x", ".x", ".x", "..md"), ("a\nb.Csv", ".csv", ".csv", "a\nb.md"),
])
def test_names(spark, name, ext, suffix, out):
    f = F.col("f")
    row = spark.createDataFrame([(name,)], "f string").select(
        names.file_ext(f), names.path_suffix(f), names.output_name(f, F.lit("standalone")),
        names.output_name(f, F.lit("anything else"))).first()
    assert tuple(row) == (ext, suffix, out, out[:-3] + ".zip")


def test_asset_names(spark):
    df = spark.createDataFrame(
        [("logo.PNG",), ("",), (None,), ("noext",)], "n string")
    name = names.asset_name(F.col("n"), F.lit(2), F.lit(0))
    got = df.select(name.alias("a"), names.asset_ext(name).alias("e")).collect()
    assert [tuple(r) for r in got] == [
        ("logo.PNG", "png"), ("img_2_0", "png"), ("img_2_0", "png"), ("noext", "png")]


def batch(spark, sizes, bad=()):
    rows = [(f"b{b}", p, "X" if (b, p) in bad else None)
            for b, n in enumerate(sizes) for p in range(n)]
    return spark.createDataFrame(rows, "batch_id string, pos int, error string")


def test_batch_gate_and_cap(spark):
    df = batch(spark, [10, 11, 1, 40]).drop("error")
    gate = validation.batch_size_gate(df).groupBy("batch_id").agg(
        F.min("error").alias("e"), F.count("*").alias("n"), F.count("error").alias("k")).collect()
    assert {r.batch_id: (r.e, r.n, r.k) for r in gate} == {
        "b0": (None, 10, 0), "b1": (dims.BATCH_LIMIT, 11, 11), "b2": (None, 1, 0),
        "b3": (dims.BATCH_LIMIT, 40, 40)}
    cap = validation.batch_cap(df).groupBy("batch_id", "truncated").agg(
        F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    assert {(r.batch_id, r.truncated, r.n, r["last"]) for r in cap} == {
        ("b0", False, 10, 9), ("b1", True, 10, 9), ("b2", False, 1, 0), ("b3", True, 10, 9)}


def test_batch_stops_at_the_first_bad_file(spark):
    got = validation.batch_first_reject(batch(spark, [4, 2], {(0, 1), (0, 3)}))
    assert {(r.batch_id, r.pos): (r.outcome, r.recorded) for r in got.collect()} == {
        ("b0", 0): ("queued", False), ("b0", 1): ("rejected", False),
        ("b0", 2): ("skipped", False), ("b0", 3): ("skipped", False),
        ("b1", 0): ("queued", True), ("b1", 1): ("queued", True)}


def test_error_info_is_opaque(spark):
    df = spark.createDataFrame(
        [("PayloadTooLargeError",), ("TaskAlreadyPurgedError",), ("MagicNumberMismatchError",),
         ("ValueError",), (None,)], "error string")
    got = errors.attach_error_info(df)
    assert got.columns == ["context", "http_status", "user_message"]
    rows = got.collect()
    assert [r.http_status for r in rows] == [413, 410, 400, 500, 500]
    assert rows[3].user_message == dims.GENERIC_MESSAGE
    for r in rows:
        assert "Error" not in r.user_message and "/" not in r.user_message.replace("/ ", "")
    assert len(dims.ERRORS) == 17


def test_failure_stage_of_every_class(spark):
    df = spark.createDataFrame([(e,) for e in [*dims.ERRORS, "ValueError"]], "error string")
    got = {r.error: (r.stage, r.error_reason) for r in errors.failure_stage(df).collect()}
    assert got["VirusDetectedError"][0] == got["AntivirusUnavailableError"][0] == "SCANNING"
    assert got["MarkdownCompilationError"] == (
        "PARSING", dims.ERRORS["MarkdownCompilationError"][2])
    rest = {v for k, v in got.items() if k not in dims.FAILURE_STAGE}
    assert rest == {("PACKAGING", dims.PIPELINE_MESSAGE)}


def test_xml_guard(spark):
    xxe = b'<?xml version="1.0"?><!DOCTYPE foo [<!ENTITY xxe SYSTEM "file:///etc/passwd">]><test>&xxe;</test>'
    plain = b"<root><element>content</element></root>"
    df = uploads(spark, [("xxe.xml", xxe), ("test.xml", plain), ("d.xml", b"<!DOCTYPE a><a/>")])
    strict = validation.xml_entity_guard(df).orderBy("id").collect()
    assert [r.error for r in strict] == [dims.XML_ATTACK, None, None]
    assert strict[0].xml is None
    loose = validation.xml_entity_guard(df, strict=False).orderBy("id").collect()
    assert [r.error for r in loose] == [None, None, None]
    assert loose[0].xml == '<?xml version="1.0"?><test>&xxe;</test>'
    assert loose[1].xml == plain.decode()
