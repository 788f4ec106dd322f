"""Sources, sinks, deliveries and the whole pipeline."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from docmark import dims
from docmark.limits import DEFAULT
from docmark.plans import pipeline
from docmark.sources import deliveries, sinks, uploads

FILES = [
    ("h", "b1", 0, "index.html", b"<h1>Title</h1><p>Paragraph</p>"),
    ("c", "b1", 1, "data.csv", b"a,b\n1,2"),
    ("p", "b1", 2, "doc.pdf", b"%PDF-1.4"),
    ("x", "b2", 0, "sheet.xlsx", b"PK\x03\x04..."),
    ("e", "b2", 1, "evil.txt", b"has a threat inside"),
    ("k", "b2", 2, "known.json", b'{"known": 1}'),
    ("q", "b3", 0, "bomb.xml", b'<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>'),
    ("r", "b3", 1, "fine.xml", b"<d>1</d>"),
    ("n", "b4", 0, "no.exe", b"x"),
    ("m", "b4", 1, "ok.txt", b"ok"),
    ("o", "b5", 0, ".pdf", b"%PDF-1.4"),
]


def corpus(spark):
    rows = [(t, b, p, n, bytearray(c), len(c)) for t, b, p, n, c in FILES]
    return spark.createDataFrame(
        rows, "task_id string, batch_id string, pos int, filename string, content binary, length long")


def known(spark):
    return corpus(spark).filter("task_id = 'k'").select(F.sha2("content", 256).alias("sha256"))


def decoded(spark):
    return spark.createDataFrame([("p", "layout text", None), ("x", None, dims.TOO_LARGE)],
                                 "task_id string, markdown string, error string")


def run(spark, **kw):
    return pipeline.convert_corpus(
        corpus(spark), hashes=known(spark), patterns=[b"threat"], decoded=decoded(spark), **kw)


def test_corpus(spark):
    converted, failures, events = run(spark)
    assert {r.task_id: (r.output_name, r.markdown) for r in converted.collect()} == {
        "h": ("index.md", "# Title\n\nParagraph"), "c": ("data.md", "| a | b |\n| --- | --- |\n| 1 | 2 |\n"),
        "p": ("doc.md", "layout text"), "r": ("fine.md", "<d>1</d>"), "m": ("ok.md", "ok"),
        "q": ("bomb.md", "<d>&a;</d>")}
    assert {r.task_id: (r.phase, r.error) for r in failures.collect()} == {
        "x": ("parse", dims.TOO_LARGE), "e": ("scan", dims.VIRUS), "k": ("scan", dims.VIRUS),
        "n": ("intake", dims.UNSUPPORTED),
        "o": ("parse", dims.MARKDOWN_FAILED)}
    assert "content" not in failures.columns and "content" not in converted.columns
    last = {r.task_id: (r.n, r.stage, r.status, r.error_reason) for r in events.groupBy("task_id").agg(
        F.count("*").alias("n"), F.max_by("stage", "seq").alias("stage"),
        F.max_by("status", "seq").alias("status"), F.max_by("error_reason", "seq").alias("error_reason")).collect()}
    assert "n" not in last
    assert last["h"] == (6, "PACKAGING", "SUCCESS", None)
    assert last["e"] == (3, "SCANNING", "FAILURE", dims.ERRORS[dims.VIRUS][2])
    assert last["o"] == (4, "PARSING", "FAILURE", dims.ERRORS[dims.MARKDOWN_FAILED][2])
    assert last["q"] == (6, "PACKAGING", "SUCCESS", None)


def test_strict_xml_refuses_declarations(spark):
    _, failures, events = run(spark, strict_xml=True)
    assert ("q", "parse", dims.XML_ATTACK) in {(r.task_id, r.phase, r.error) for r in failures.collect()}
    end = events.filter("task_id = 'q' AND seq = 3").first()
    assert (end.stage, end.status, end.error_reason) == ("PACKAGING", "FAILURE", dims.PIPELINE_MESSAGE)


def test_verdicts_and_lost_assets_stop_files(spark):
    said = spark.createDataFrame(
        [("h", "infected"), ("c", "unavailable"), ("m", "pending"), ("p", "clean"), ("n", "infected"), ("e", "unavailable")],
        "task_id string, verdict string")
    lost = spark.createDataFrame([("p", "PdfImageExtractionError"), ("h", "KeyError")], "task_id string, error string")
    converted, failures, events = run(spark, verdicts=said, asset_errors=lost)
    assert {r.task_id for r in converted.collect()} == {"r", "q"}
    found = {r.task_id: (r.phase, r.error) for r in failures.collect()}
    assert {t: found[t] for t in "hcpnek"} == {
        "h": ("scan", dims.VIRUS), "c": ("scan", dims.SCAN_UNAVAILABLE), "p": ("assets", "PdfImageExtractionError"),
        "n": ("intake", dims.UNSUPPORTED), "e": ("scan", dims.VIRUS), "k": ("scan", dims.VIRUS)}
    assert "m" not in found
    steps = {t: [(r.stage, r.status) for r in sorted(events.filter(F.col("task_id") == t).collect(), key=lambda r: r.seq)]
             for t in "mpc"}
    assert steps["m"] == [("UPLOADED", "PENDING"), ("SCANNING", "ACTIVE")]
    assert [s for s, _ in steps["p"]] == ["UPLOADED", "SCANNING", "PARSING", "RESOLVING_ASSETS", "PACKAGING"]
    assert steps["p"][-1][1] == steps["c"][-1][1] == "FAILURE" and steps["c"][-1][0] == "SCANNING"


def test_packages(spark):
    images = spark.createDataFrame(
        [("p", 0, 0, "i.png", bytearray(b"1"), "png"), ("p", 0, 1, "i.png", bytearray(b"2"), "png"),
         ("x", 0, 0, "lost.png", bytearray(b"x"), "png")],
        "task_id string, page_index long, image_index long, name string, data binary, extension string")
    converted, _, _ = run(spark, mode="package", assets=images)
    got = {(r.task_id, r.path): (r.output_name, bytes(r.data)) for r in pipeline.corpus_packages(converted, images).collect()}
    assert got["p", "document.md"] == ("doc.zip", b"layout text\n\n![i.png](images/i.png)\n\n![i.png](images/i.png)")
    assert got["p", "images/i.png"] == ("doc.zip", b"2") and got["m", "document.md"] == ("ok.zip", b"ok")
    assert {t for t, _ in got} == {"h", "c", "p", "q", "r", "m"}


def test_contents_are_read_once(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    files = spark.read.parquet(str(tmp_path / "in"))
    counted = files.mapInArrow(seen, files.schema)
    said = spark.createDataFrame([("h", "infected")], "task_id string, verdict string")
    for result in pipeline.convert_corpus(counted, hashes=known(spark), patterns=[b"threat"],
                                          decoded=decoded(spark), verdicts=said):
        result.collect()
    assert reads.value == len(FILES)


def test_late_members_are_left_out(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    times = spark.createDataFrame(
        [("h", at(0), at(10)), ("c", at(5), at(400)), ("p", at(5), at(300)), ("q", at(0), at(3)), ("r", at(1), at(7))],
        "task_id string, started_at timestamp, finished_at timestamp")
    made = pipeline.convert_batches(corpus(spark), "standalone", known(spark), [b"threat"], decoded(spark), times=times)
    assert {(r.batch_id, r.entry_name, r.closes_at, r.timed_out, r.purge_at) for r in made.collect()} == {
        ("b1", "h_index.md", at(300), True, at(900)), ("b1", "p_doc.md", at(300), True, at(900)),
        ("b3", "q_bomb.md", at(7), False, at(607)), ("b3", "r_fine.md", at(7), False, at(607))}


def test_large_threat_lists_take_the_narrow_join(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "HASH_ROWS", 0)
    _, failures, _ = run(spark)
    assert {r.task_id for r in failures.filter("phase = 'scan'").collect()} == {"e", "k"}


def test_assets_in_both_modes(spark):
    images = spark.createDataFrame(
        [("p", 0, 0, "i.png", bytearray(b"x"), "png"), ("x", 0, 0, "lost.png", bytearray(b"x"), "png")],
        "task_id string, page_index long, image_index long, name string, data binary, extension string")
    alone, _, _ = run(spark, assets=images)
    texts = {r.task_id: (r.output_name, r.markdown) for r in alone.collect()}
    assert texts["p"] == ("doc.md", "layout text\n\n![i.png](data:image/png;base64,eA==)")
    assert texts["m"] == ("ok.md", "ok") and "x" not in texts
    packed, _, _ = run(spark, mode="package", assets=images)
    texts = {r.task_id: (r.output_name, r.markdown) for r in packed.collect()}
    assert texts["p"] == ("doc.zip", "layout text\n\n![i.png](images/i.png)")


def test_batches(spark):
    made = pipeline.convert_batches(
        corpus(spark), "standalone", known(spark), [b"threat"], decoded(spark))
    assert {(r.batch_id, r.entry_no, r.entry_name) for r in made.collect()} == {
        ("b1", 0, "h_index.md"), ("b1", 1, "c_data.md"), ("b1", 2, "p_doc.md"), ("b3", 0, "q_bomb.md"),
        ("b3", 1, "r_fine.md")}
    small = pipeline.convert_batches(corpus(spark), limits=replace(DEFAULT, max_batch_files=2))
    assert {r.batch_id for r in small.collect()} == {"b3"}


def test_read_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"12345")
    (tmp_path / "sub" / "b.txt").write_bytes(b"123456")
    ok, big = uploads.read_uploads(spark, str(tmp_path), 5)
    assert [(r.filename, bytes(r.content), r.length) for r in ok.collect()] == [("a.txt", b"12345", 5)]
    assert [(r.filename, r.length, r.error) for r in big.collect()] == [("b.txt", 6, dims.TOO_LARGE)]
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual" not in plan and "GreaterThan(length,5)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("t1", "../../etc/x.txt", "one", "d1"), ("t2", "y.csv", "two", "d2")],
        "task_id string, filename string, markdown string, finished_on string")
    path = str(tmp_path / "out")
    sinks.write_standalone(df, path, "finished_on")
    got = {r.task_id: (r.file_name, bytes(r.data)) for r in spark.read.parquet(path).collect()}
    assert got == {"t1": ("../../etc/x.md", b"one"), "t2": ("y.md", b"two")}
    # replacing one day leaves the other
    again = df.filter("task_id = 't1'").withColumn("markdown", F.lit("new"))
    sinks.write_standalone(again, path, "finished_on", mode="overwrite")
    got = {r.task_id: bytes(r.data) for r in spark.read.parquet(path).collect()}
    assert got == {"t1": b"new", "t2": b"two"}
    manifest = spark.createDataFrame([("d", 0, "document.md", bytearray(b"x"))],
                                     "doc_id string, ord int, path string, data binary")
    sinks.write_package(manifest, str(tmp_path / "pkg"))
    assert spark.read.parquet(str(tmp_path / "pkg")).first().path == "document.md"


def test_deliveries(spark):
    requests = spark.createDataFrame([(i, t) for i, t in enumerate("abcde")], "request_id int, task_id string")
    state = spark.createDataFrame(
        [("b", "ACTIVE"), ("c", "SUCCESS"), ("d", "SUCCESS"), ("e", "SUCCESS")], "task_id string, status string")
    outs = spark.createDataFrame([("d", "d.zip"), ("e", "e.md"), ("b", "b.md")], "task_id string, file_name string")
    got = {r.task_id: (r.http_status, r.media_type, r.file_name)
           for r in deliveries.resolve_deliveries(requests, state, outs).collect()}
    assert got == {"a": (410, None, None), "b": (404, None, None), "c": (410, None, None),
                   "d": (200, "application/zip", "d.zip"), "e": (200, "text/markdown", "e.md")}
    ask = spark.createDataFrame([(0, "0123456789"), (1, "zz")], "request_id int, batch_id string")
    have = spark.createDataFrame([("0123456789",)], "batch_id string")
    got = {r.batch_id: (r.http_status, r.media_type, r.file_name)
           for r in deliveries.resolve_batch_deliveries(ask, have).collect()}
    assert got == {"0123456789": (200, "application/zip", "Batch_Conversion_01234567.zip"),
                   "zz": (404, None, None)}


def test_conversion_plan_has_no_shuffle(spark):
    done = pipeline.process_corpus(corpus(spark), patterns=[b"threat"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
