"""One query per operator over the test tables.

Each takes the session and the folder of the tables and returns a frame. Times are given
in microseconds since the epoch, contents and long texts by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmark.functions import binary, html, names, state, tables, text
from docmark.operators import (
    assembly, assets, errors, layout, scanning, stats, status, validation)
from docmark.plans import bindings as b
from docmark.plans import pipeline
from docmark.scratch import run_to_table, scratch_path
from docmark.sources import deliveries, expiring, sinks, uploads
from docmark.streaming import intake, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def us(ts: str, name: str | None = None) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).alias(name or ts)


def digest(col: str, name: str) -> Column:
    return F.md5(F.col(col).cast("binary")).alias(name)


# --- the flagship ------------------------------------------------------------


@query
def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, checked and converted: ``page_id, mime, error, markdown``."""
    checked = validation.checked_uploads(b.uploads_pages(spark, sf_dir), b.LIMITS)
    routed = pipeline.route_by_type(checked)
    return routed.select("page_id", "mime", "error", "markdown")


# --- sources and sinks -------------------------------------------------------


def _listed(uploads_: DataFrame, rejects: DataFrame) -> DataFrame:
    """Files with their number, what intake says of them, and the digest of what was read."""
    checked = validation.checked_uploads(uploads_).select(
        "path", "filename", "length", "error", F.sha2("content", 256).alias("sha256"))
    refused = rejects.select("path", "filename", "length", "error", F.lit(None).cast("string").alias("sha256"))
    return checked.unionByName(refused).select(
        F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long").alias("file"),
        names.file_ext(F.col("filename")).alias("ext"), "length", "error", "sha256")


@query
def read_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold all documents, read from their folder under the default limit."""
    path = scratch_path(spark, "files")
    b.documents_in_files(spark, sf_dir, path)
    return _listed(*uploads.read_uploads(spark, path))


@query
def uploads_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.uploads_documents(spark, sf_dir)
    return files.select(
        "doc_id", "filename", "length", F.sha2("content", 256).alias("sha256"))


@query
def stream_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as they arrive, with a sink for uploads and one for rejects."""
    path, out = scratch_path(spark, "files"), scratch_path(spark, "arrived")
    b.documents_in_files(spark, sf_dir, path)
    running = [w.trigger(availableNow=True).start() for w in uploads.write_uploads(spark, path, out)]
    for query_ in running:
        query_.awaitTermination()
    taken, refused = uploads.stream_uploads(spark, path)
    return _listed(spark.read.schema(taken.schema).parquet(f"{out}/uploads"),
                   spark.read.schema(refused.schema).parquet(f"{out}/rejects"))


def _converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pipeline.process_corpus(
        b.batched(b.uploads_documents(spark, sf_dir)), limits=b.LIMITS)
    return pipeline.split_corpus(done)[0]


@query
def write_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted documents, written and read back."""
    path = scratch_path(spark, "standalone")
    out = _converted_documents(spark, sf_dir).select(
        "task_id", "filename", "route", "markdown")
    sinks.write_standalone(out, path, "route")
    return spark.read.parquet(path).select(
        "task_id", "file_name", "route", F.md5("data").alias("content_md5"))


@query
def write_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package manifests, written and read back."""
    path = scratch_path(spark, "package")
    docs, images = b.asset_relations(spark, sf_dir)
    sinks.write_package(assets.package_manifest(docs, images), path)
    return spark.read.parquet(path).select(
        "doc_id", "page_index", "image_index", "path", F.md5("data").alias("content_md5"))


def _outputs(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Outputs of the successful tasks that retention has kept."""
    kept, _ = status.retention(_finished(events), _now(spark, sf_dir), b.KEEP_S * 14)
    return kept.filter(F.col("status") == "SUCCESS").select(
        "task_id",
        F.concat(F.lit("result_"), F.substring("task_id", 1, 8),
                 F.when(F.substring("task_id", 1, 1) < "8", ".md").otherwise(".zip"))
        .alias("file_name"))


def _finished(events: DataFrame) -> DataFrame:
    return status.finished_tasks(events)


def _now(spark: SparkSession, sf_dir: str) -> Column:
    """The last event's time, as a scalar subquery of the same job."""
    last = b.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")))
    return last.scalar()


@query
def resolve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.status_events(spark, sf_dir)
    requests = events.select(F.col("event_id").alias("request_id"), "task_id")
    return deliveries.resolve_status(requests, status.latest_state(events)).drop("task_id")


@query
def resolve_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for each document's task and batch, and for a batch that never was."""
    members = _batch_members(spark, sf_dir)
    taken = members.join(
        validation.batch_first_reject(members).filter("recorded").select("task_id"),
        "task_id", "left_semi")
    record = b.batch_records(members)
    ids = F.array(
        F.struct(F.concat(F.lit("t"), F.col("doc_id")).alias("request_id"), F.col("task_id"),
                 F.lit(None).cast("string").alias("batch_id")),
        F.struct(F.concat(F.lit("b"), F.col("doc_id")).alias("request_id"),
                 F.lit(None).cast("string").alias("task_id"), F.col("batch_id")),
        F.struct(F.concat(F.lit("x"), F.col("doc_id")).alias("request_id"),
                 F.lit(None).cast("string").alias("task_id"),
                 F.concat(F.lit("x"), F.col("batch_id")).alias("batch_id")))
    requests = members.select(F.inline(ids))
    return deliveries.resolve_progress(requests, record, members, taken)


@query
def resolve_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.status_events(spark, sf_dir)
    requests = events.select(F.col("event_id").alias("request_id"), "task_id")
    out = deliveries.resolve_deliveries(
        requests, status.latest_state(events), _outputs(spark, sf_dir, events))
    return out.select("request_id", "http_status", "media_type", "file_name")


@query
def resolve_batch_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of runs with an archive: all members terminal."""
    events = b.status_events(spark, sf_dir)
    states = _member_states(events)
    closed = states.groupBy("batch_id").agg(
        F.bool_and(F.col("status").isin("SUCCESS", "FAILURE")).alias("done")
    ).filter("done")
    requests = states.select(F.col("task_id").alias("request_id"), "batch_id")
    return deliveries.resolve_batch_deliveries(requests, closed).select(
        "request_id", "http_status", "media_type", "file_name")


# --- validation --------------------------------------------------------------


@query
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.uploads_documents(spark, sf_dir)
    return validation.size_guard(files, b.SMALL_LIMIT).select("doc_id", "error")


@query
def file_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions and suffixes of names with many, no, leading and trailing dots."""
    docs = b.table(spark, sf_dir, "documents")
    name = _odd_name(F.col("doc_id"))
    return docs.select(
        "doc_id", names.file_ext(name).alias("ext"), names.path_suffix(name).alias("suffix"))


def _odd_name(doc_id: Column) -> Column:
    base = doc_id.cast("string")
    shape = doc_id % 6
    return (
        F.when(shape == 0, F.concat(F.lit("Doc."), base, F.lit(".TXT")))
        .when(shape == 1, F.concat(F.lit("."), base))
        .when(shape == 2, F.concat(F.lit("doc"), base))
        .when(shape == 3, F.concat(F.lit("doc"), base, F.lit(".")))
        .when(shape == 4, F.concat(F.lit(".."), base, F.lit(".Pdf")))
        .otherwise(F.concat(base, F.lit(".tar.gz"))))


@query
def supported_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.supported_type(b.uploads_documents(spark, sf_dir)).select("doc_id", "error")


@query
def declared_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.declared_mime(b.uploads_documents(spark, sf_dir)).select("doc_id", "mime")


@query
def utf8_prefix_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.uploads_documents(spark, sf_dir)
    content = F.col("content")
    return files.select(
        "doc_id", binary.utf8_prefix_ok(content).alias("strict_ok"),
        binary.utf8_prefix_ok(content, tolerate_cut=True).alias("tolerant_ok"))


@query
def binary_spoof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.uploads_documents(spark, sf_dir).select(
        "doc_id", binary.binary_spoof(F.col("content")).alias("spoofed"))


@query
def zip_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.uploads_documents(spark, sf_dir).select(
        "doc_id", binary.zip_container(F.col("content")).alias("is_zip"))


@query
def match_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.uploads_documents(spark, sf_dir).select("task_id", "content")
    files = files.unionByName(b.uploads_pages(spark, sf_dir).select("task_id", "content"))
    return files.select("task_id", binary.match_signature(F.col("content")).alias("matched"))


@query
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validation.checked_uploads(b.uploads_all(spark, sf_dir), b.LIMITS)
    return checked.select("filename", "length", "mime", "error")


def _batch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.batched(b.uploads_documents(spark, sf_dir))
    return validation.checked_uploads(files, b.LIMITS).select(
        "doc_id", "task_id", "batch_id", "pos", "error")


@query
def batch_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _batch_members(spark, sf_dir).drop("error")
    return validation.batch_size_gate(members).select("doc_id", "batch_id", "error")


@query
def batch_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.batch_cap(_batch_members(spark, sf_dir)).select(
        "batch_id", "doc_id", "truncated")


@query
def batch_first_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.batch_first_reject(_batch_members(spark, sf_dir)).select(
        "doc_id", "outcome", "recorded")


@query
def signature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.signature_scan(
        b.uploads_documents(spark, sf_dir), b.toxic_hashes(spark, sf_dir), b.PATTERNS)


@query
def signature_scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are listed, or hold the beginning of some benchmark item."""
    patterns = b.table(spark, sf_dir, "benchmark").select(
        F.encode(F.substring("text", 1, b.PATTERN_CHARS), "UTF-8").alias("pattern"))
    return scanning.signature_scan(
        b.uploads_documents(spark, sf_dir), b.toxic_hashes(spark, sf_dir), patterns, key="doc_id")


@query
def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.scan_verdict(*b.scan_results(spark, sf_dir))


@query
def resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.resolve_attempts(b.attempts(spark, sf_dir))


@query
def reconnect_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.reconnect_delays(b.connections(spark, sf_dir), split=b.user_split(spark, sf_dir))


def _xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    declared = F.when(
        F.col("doc_id") % 3 == 0,
        F.lit('<!DOCTYPE doc [<!ENTITY x SYSTEM "file:///etc/passwd">]>')
    ).when(F.col("doc_id") % 3 == 1, F.lit("<!DOCTYPE doc>")).otherwise("")
    raw = F.concat(
        F.lit('<?xml version="1.0"?>'), declared, F.lit("<doc>"), F.col("text"), F.lit("&x;</doc>"))
    return docs.select("doc_id", raw.cast("binary").alias("content"))


@query
def xml_entity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.xml_entity_guard(_xml_files(spark, sf_dir)).select(
        "doc_id", "error", digest("xml", "xml_md5"))


# --- scalar functions --------------------------------------------------------


@query
def clean_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("|\r\n  "))
    return docs.select("doc_id", F.md5(text.clean_cell(padded)).alias("cell_md5"))


@query
def grid_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with short, long and empty rows."""
    part = b.table(spark, sf_dir, "part")
    cells = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    grid = F.when(F.col("p_partkey") % 7 == 0, F.array(F.array().cast("array<string>"))).otherwise(
        F.array(
            F.array(F.lit("na|me"), F.lit(" brand ")),
            F.array(cells[0], cells[1]), F.array(cells[0]), F.array(*cells),
            F.array(F.lit(None).cast("string"), F.concat(cells[2], F.lit("\nx")))))
    return part.select("p_partkey", tables.grid_to_markdown(grid).alias("markdown"))


@query
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages")
    return pages.select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


@query
def text_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.uploads_documents(spark, sf_dir)
    return files.select(
        "doc_id", F.md5(text.text_to_markdown(F.col("content"))).alias("markdown_md5"))


@query
def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as delimited text with quoted fields, back to a table."""
    orders = b.table(spark, sf_dir, "orders")
    line = F.concat(
        F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderpriority"),
        F.lit(', ""'), F.col("o_orderstatus"), F.lit('"""'))
    csv = assembly.whole_text(
        assembly.text_chunks(orders, ["o_custkey"], ["o_orderkey"], line, "\r\n"), ["o_custkey"], "csv")
    body = F.concat(F.lit("key,priority\n"), F.col("csv"))
    return csv.select("o_custkey", tables.csv_to_markdown(body).alias("markdown"))


@query
def json_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    cut = F.when(F.col("event_id") % 5 == 0, F.substr("props", F.lit(2))).otherwise(F.col("props"))
    return events.select(
        "event_id", text.json_to_markdown(cut).alias("markdown"),
        text.json_is_valid(cut).alias("valid"))


@query
def xml_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xml_files(spark, sf_dir).select(
        "doc_id", F.md5(text.xml_to_markdown(F.col("content"))).alias("markdown_md5"))


@query
def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(e) for e in (
        "png", "jpg", "JPEG", "gif", "webp", "bmp", "tiff", "svg")])
    ext = F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.select(
        "doc_id", F.md5(binary.data_uri(F.encode("text", "UTF-8"), ext)).alias("uri_md5"))


@query
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    given = F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat("p_brand", F.lit(".v2.PNG"))).when(
        key % 4 == 2, F.col("p_name"))
    name = names.asset_name(given, F.col("p_size"), key)
    return part.select("p_partkey", name.alias("name"), names.asset_ext(name).alias("extension"))


@query
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    mode = F.when(F.col("doc_id") % 4 == 0, "package").otherwise("standalone")
    return docs.select(
        "doc_id", names.output_name(_odd_name(F.col("doc_id")), mode).alias("output_name"))


def _full_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.status_events(spark, sf_dir).withColumn(
        "original_name", F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".txt"))
    ).withColumn("output_mode", F.lit("standalone")).withColumn(
        "batch_id", F.lit(None).cast("string"))
    return status.latest_state(events)


@query
def state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest states as JSON and what is read back from it."""
    packed = _full_states(spark, sf_dir).select("task_id", state.state_json().alias("state_json"))
    read = packed.withColumn("back", state.parse_state(F.col("state_json")))
    return read.select(
        "task_id", "state_json", F.col("back.stage").alias("stage"),
        F.col("back.error_reason").alias("error_reason"))


@query
def size_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", names.size_mb(F.col("n_chars") * 1000).alias("mb"))


# --- joins -------------------------------------------------------------------


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused, infected and unconverted files, and some with an unknown error."""
    done = pipeline.process_corpus(
        b.uploads_documents(spark, sf_dir), b.toxic_hashes(spark, sf_dir), b.PATTERNS,
        limits=b.LIMITS)
    failures = pipeline.split_corpus(done)[1]
    odd = (F.col("doc_id") % 6 == 1) & (F.col("error") == "UnsupportedFileTypeError")
    return failures.select("doc_id", F.when(odd, "KeyError").otherwise(F.col("error")).alias("error"))


@query
def attach_error_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.attach_error_info(_failures(spark, sf_dir))


@query
def failure_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.failure_stage(_failures(spark, sf_dir))


@query
def assign_lines_to_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids, lines, pages = b.layout_relations(spark, sf_dir)
    regions = layout.text_regions(layout.order_tables(grids), pages)
    return layout.assign_lines_to_regions(lines, regions).select(
        "page_no", "line_no", "top", "ord", "text")


def _document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task_id, status`` of the accepted documents after conversion."""
    done = pipeline.process_corpus(b.batched(b.uploads_documents(spark, sf_dir)), limits=b.LIMITS)
    return done.filter(F.col("phase") != "intake").select(
        "task_id", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILURE").alias("status"))


@query
def expand_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _batch_members(spark, sf_dir)
    return status.expand_batches(
        b.batch_records(members), _document_states(spark, sf_dir)).select(
        "batch_id", "pos", "task_id", "status")


@query
def successful_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.status_events(spark, sf_dir)
    return status.successful_outputs(
        b.run_members(events), status.latest_state(events), _outputs(spark, sf_dir, events)
    ).select("batch_id", "task_id", "file_name")


@query
def apply_known_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = b.user_split(spark, sf_dir)
    events = b.status_events(spark, sf_dir, split)
    known = status.apply_known_tasks(
        events.filter(F.col("op") != "init"), events.filter(F.col("op") == "init"), b.TTL_S,
        split=split)
    return known.select("task_id", "event_id", "op")


# --- aggregations ------------------------------------------------------------


@query
def cells_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as cells, rows of two to four of them."""
    key = F.col("o_orderkey")
    cells = [
        F.struct(F.lit(0).alias("col"), key.cast("string").alias("cell")),
        F.struct(F.lit(1).alias("col"), F.col("o_orderstatus").alias("cell")),
    ]
    third = F.struct(F.lit(2).alias("col"), F.concat(F.lit(" "), "o_orderpriority").alias("cell"))
    fourth = F.struct(F.lit(3).alias("col"), F.lit(None).cast("string").alias("cell"))
    row = F.when(key % 3 == 0, F.array(*cells)).when(
        key % 5 == 0, F.array(*cells, third, fourth)).otherwise(F.array(*cells, third))
    long = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("table_id"), key.alias("row"), F.inline(row))
    return assembly.cells_to_markdown(long)


@query
def frame_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.frame_to_markdown(
        b.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey",
        ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query
def assemble_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as parts of one page."""
    turns = b.table(spark, sf_dir, "conversations")
    parts = turns.select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("ord"),
        F.when(F.col("turn") % 5 == 3, " \n ").otherwise(
            F.concat(F.lit("  "), "text", F.lit("\n\n"))).alias("text"))
    return assembly.assemble_page(parts).withColumn("text", F.md5("text"))


@query
def assemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as pages, some of them empty."""
    turns = b.table(spark, sf_dir, "conversations")
    pages = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
        F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.col("text")).otherwise("").alias("text"))
    docs = pages.select("doc_id").distinct()
    made = assembly.assemble_document(pages, docs)
    return made.select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query
def inline_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, images = b.asset_relations(spark, sf_dir)
    return assets.inline_assets(docs, images)


@query
def link_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, images = b.asset_relations(spark, sf_dir)
    return assets.link_assets(docs, images)


@query
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, images = b.asset_relations(spark, sf_dir)
    made = assets.package_manifest(docs, images)
    return made.select(
        "doc_id", "page_index", "image_index", "path", F.md5("data").alias("content_md5"))


@query
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.status_events(spark, sf_dir)
    members = b.run_members(events)
    good = status.successful_outputs(
        members, status.latest_state(events), _outputs(spark, sf_dir, events))
    return assets.batch_manifest(good.join(members, ["batch_id", "task_id"]))


def _member_states(events: DataFrame) -> DataFrame:
    return b.run_members(events).join(status.latest_state(events), "task_id")


@query
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.batch_rollup(_member_states(b.status_events(spark, sf_dir)))


@query
def batch_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of runs, with a timeout of ten days."""
    return _barriers(b.status_events(spark, sf_dir)).select(
        "batch_id", us("closes_at"), "timed_out", "members", "included")


@query
def count_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_conversions(b.status_events(spark, sf_dir))


@query
def count_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_visitors(b.table(spark, sf_dir, "events"))


@query
def current_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.current_stats(
        count_visitors(spark, sf_dir), count_conversions(spark, sf_dir))


@query
def kept_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters after all events were added in four batches, one of them twice."""
    kept = stats.Counters(spark, scratch_path(spark, "counters"))
    events = b.status_events(spark, sf_dir)
    for number in (0, 1, 2, 1, 3):
        kept.add(events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == number), number)
    return kept.current()


# --- windows -----------------------------------------------------------------


@query
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.latest_state(b.status_events(spark, sf_dir)).select(
        "task_id", "stage", "status", "error_reason", us("updated_at"))


def _until(spark: SparkSession, sf_dir: str) -> Column:
    """Just after the last event: followers know all that happened up to it."""
    return _now(spark, sf_dir) + F.expr("INTERVAL 0.000001 SECONDS")


def _sent(spark: SparkSession, sf_dir: str, split: bool | None) -> DataFrame:
    return status.stage_transitions(
        b.status_events(spark, sf_dir, split), split=split, ttl_s=b.TTL_S, until=_until(spark, sf_dir))


_SENT = ("task_id", "event_id", "stage", "status", "error_reason", "emit_no", "error")


@query
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _sent(spark, sf_dir, b.user_split(spark, sf_dir))
    return sent.select(*_SENT, us("ts", "sent_at"))


@query
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = b.user_split(spark, sf_dir)
    beats = status.heartbeats(
        _sent(spark, sf_dir, split), b.BEAT_S, check_range=False, until=_until(spark, sf_dir), split=split)
    return beats.select("task_id", "event_id", "beat_no", us("beat_at"))


def _batch_sent(spark: SparkSession, sf_dir: str, split: bool | None) -> DataFrame:
    events = b.status_events(spark, sf_dir, split)
    rollups = status.rollup_history(
        events, b.run_members(events), split=split, ttl_s=b.TTL_S, until=_until(spark, sf_dir))
    return status.batch_transitions(rollups, split=split)


_ROLLED = ("batch_id", "event_id", "status", "stage", "error_reason", "error")


@query
def batch_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _batch_sent(spark, sf_dir, b.user_split(spark, sf_dir))
    return sent.select(*_ROLLED, us("ts", "sent_at"))


@query
def batch_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of the followers of batches."""
    split = b.user_split(spark, sf_dir)
    beats = status.heartbeats(
        _batch_sent(spark, sf_dir, split), b.BEAT_S, check_range=False, until=_until(spark, sf_dir),
        split=split, key="batch_id")
    return beats.select("batch_id", "event_id", "beat_no", us("beat_at"))


@query
def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids, _, _ = b.layout_relations(spark, sf_dir)
    return layout.order_tables(grids).select(
        "doc_id", "page_no", "table_id", "table_no", "top", "bottom")


@query
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids, _, pages = b.layout_relations(spark, sf_dir)
    return layout.text_regions(layout.order_tables(grids), pages)


@query
def number_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.number_assets(b.paged_images(spark, sf_dir)).select(
        "doc_id", "page_index", "image_index", "name", "extension")


@query
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of the latest states; some stages are unknown."""
    states = status.latest_state(b.status_events(spark, sf_dir)).withColumn(
        "stage", F.when(F.col("task_id") < "1", "SUCCESS").otherwise(F.col("stage")))
    return status.stage_timeline(states).select("task_id", "stage_no", "stage_key", "label", "mark")


# --- state and streams -------------------------------------------------------


@query
def state_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = b.user_split(spark, sf_dir)
    out = status.state_ttl(b.status_events(spark, sf_dir, split), b.TTL_S, split=split)
    return out.select("task_id", "event_id", us("valid_until"), "lapsed")


def _barriers(events: DataFrame) -> DataFrame:
    """Batches of runs, with a timeout of ten days."""
    members = b.run_members(events)
    inits = events.filter(F.col("op") == "init").select("task_id", F.col("ts").alias("_init"))
    starts = members.join(inits, "task_id").groupBy("batch_id").agg(F.min("_init").alias("started_at"))
    ends = status.finished_tasks(events)
    states = members.join(starts, "batch_id").join(ends, "task_id", "left")
    return status.batch_barrier(states, timeout_s=10 * 86_400)


@query
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs and states of tasks and archives of batches, purged by their own clocks and read again."""
    path = scratch_path(spark, "retention")
    events = b.status_events(spark, sf_dir)
    now = b.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    tasks = _finished(events).select(F.col("task_id").alias("id"), "status", "finished_at")
    closed = _barriers(events).select(
        F.col("batch_id").alias("id"), F.lit("ARCHIVE").alias("status"), F.col("closes_at").alias("finished_at"))
    rows = []
    for kind, table in (("task", tasks), ("batch", closed)):
        expiring.write_by_end(table, f"{path}/{kind}")
        written = spark.read.parquet(f"{path}/{kind}")
        gone = expiring.expired(written, now, b.KEEP_S)
        gone.write.parquet(f"{path}/{kind}-purged")  # what goes, kept here to be shown
        expiring.purge(spark, f"{path}/{kind}", now, b.KEEP_S)
        left = spark.read.schema(written.schema).parquet(f"{path}/{kind}").drop(expiring.DAY)
        purged = spark.read.parquet(f"{path}/{kind}-purged")
        rows += [left.withColumn("kept", F.lit(True)), purged.withColumn("kept", F.lit(False))]
        rows[-2:] = [r.withColumn("kind", F.lit(kind)) for r in rows[-2:]]
        if kind == "task":
            states = status.without_purged(
                status.latest_state(events), purged.withColumnRenamed("id", "task_id"))
            rows.append(states.select(
                F.col("task_id").alias("id"), "status", F.col("updated_at").alias("finished_at"),
                F.lit(True).alias("kept"), F.lit("state").alias("kind")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.select("kind", "id", "status", us("finished_at"), "kept")


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """``(stream, table, folder)``: the status events as files that arrive one after the other.

    A file holds what happened in a stretch of time and, in no order, rows that have slipped from
    earlier ones by anything up to the TTL. A tick at the end moves the clock to the last event.
    """
    path = scratch_path(spark, "progress")
    slip = F.pmod(F.xxhash64("event_id"), F.lit(b.TTL_S * 1_000_000))
    b.status_events(spark, sf_dir).withColumn("_at", F.unix_micros("ts") + slip).write.parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    seen = log.agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high"),
                   F.max("ts").alias("last")).first()
    files = max(b.STREAM_FILES, -(-seen.n // b.STREAM_FILE_ROWS))
    width = ((seen.high or 0) - (seen.low or 0)) // files + 1
    log.withColumn("_file", F.floor((F.col("_at") - F.lit(seen.low)) / width)).repartition("_file").write.partitionBy(
        "_file").parquet(f"{path}/parts")
    parts = spark.read.schema(f"{progress.EVENTS}, _file long").parquet(f"{path}/parts")
    for number in range(files):
        # one file is one micro-batch; its row groups are what tasks can share
        parts.where(F.col("_file") == number).drop("_file").coalesce(1).write.mode("append").option(
            "parquet.block.size", b.STREAM_BLOCK_BYTES).parquet(f"{path}/in")
    tick = log.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(b.TTL_S))).alias("ts"))
    tick.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
                  for f in parts.drop("_file").schema]).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(progress.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return stream, log, path


def _run(writer, spark: SparkSession, path: str, table: str) -> DataFrame:
    writer.trigger(availableNow=True).start().awaitTermination()
    return progress.results(spark, path, table)


@query
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, _, path = _arriving(spark, sf_dir)
    sent = _run(progress.stream_transitions(
        stream, path, ttl_s=b.TTL_S, split=b.user_split(spark, sf_dir)), spark, path, "sent")
    return sent.select(*_SENT, us("ts", "sent_at"))


@query
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, _, path = _arriving(spark, sf_dir)
    beats = _run(progress.stream_heartbeats(
        stream, path, b.BEAT_S, check_range=False, ttl_s=b.TTL_S, split=b.user_split(spark, sf_dir)),
        spark, path, "beats")
    return beats.select("task_id", "event_id", "beat_no", us("beat_at"))


@query
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, events, path = _arriving(spark, sf_dir)
    # written once, so that a micro-batch reads members and not the whole log
    b.run_members(events).write.parquet(f"{path}/members")
    rolled = _run(progress.stream_rollup(
        stream, path, lambda session: session.read.parquet(f"{path}/members"), ttl_s=b.TTL_S, split=b.user_split(spark, sf_dir)),
        spark, path, "rollups")
    return rolled.select(*_ROLLED, us("ts", "sent_at"))


@query
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents*.parquet")
    checked = intake.stream_validate(b.documents_as_files(stream), b.LIMITS)
    return run_to_table(checked.select("doc_id", "mime", "error"), "validated")


# --- whole pipeline ----------------------------------------------------------


@query
def route_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = validation.validate_uploads(b.uploads_corpus(spark, sf_dir), b.LIMITS)
    return pipeline.route_by_type(accepted).select(
        "task_id", "route", "error", digest("markdown", "markdown_md5"))


@query
def assemble_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assemble_layout(*b.layout_relations(spark, sf_dir))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pipeline.convert_corpus(
        b.uploads_corpus(spark, sf_dir), "standalone", b.toxic_hashes(spark, sf_dir), b.PATTERNS,
        decoded=_decoded(spark, sf_dir), limits=b.LIMITS, verdicts=b.verdicts(spark, sf_dir),
        asset_errors=b.document_images(spark, sf_dir)[1])


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of decoded layouts and sheets: a conversation for each tenth document."""
    turns = b.table(spark, sf_dir, "conversations")
    pages = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    text_of = assembly.assemble_document(pages)
    return text_of.select(
        b.md5(F.col("doc_id") * 10 + F.when(F.col("doc_id") % 2 == 0, 7).otherwise(8)).alias("task_id"),
        "markdown")


@query
def convert_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    converted, _, _ = _corpus(spark, sf_dir)
    return converted.select(
        "task_id", "route", "output_name", digest("markdown", "markdown_md5"))


@query
def convert_corpus_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package entries of all converted files, with the images of layouts."""
    images, lost = b.document_images(spark, sf_dir)
    converted, _, _ = pipeline.convert_corpus(
        b.uploads_corpus(spark, sf_dir), "package", b.toxic_hashes(spark, sf_dir), b.PATTERNS,
        decoded=_decoded(spark, sf_dir), assets=images, limits=b.LIMITS, verdicts=b.verdicts(spark, sf_dir),
        asset_errors=lost)
    return pipeline.corpus_packages(converted, images).select(
        "task_id", "output_name", "page_index", "image_index", "path", F.md5("data").alias("data_md5"))


@query
def corpus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures, _ = _corpus(spark, sf_dir)
    return failures.select("task_id", "phase", "error")


@query
def corpus_status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, events = _corpus(spark, sf_dir)
    return events.select("task_id", "seq", "op", "stage", "status", "error_reason")


@query
def convert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.convert_batches(
        b.batched(b.uploads_documents(spark, sf_dir)), "package",
        b.toxic_hashes(spark, sf_dir), b.PATTERNS, _decoded(spark, sf_dir), b.LIMITS)


@query
def convert_batches_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that close in time: members that end late are left out."""
    made = pipeline.convert_batches(
        b.batched(b.uploads_documents(spark, sf_dir)), "standalone", b.toxic_hashes(spark, sf_dir), b.PATTERNS,
        _decoded(spark, sf_dir), b.LIMITS, times=b.document_times(spark, sf_dir))
    return made.select(
        "batch_id", "archive_name", "entry_no", "entry_name", "task_id", us("closes_at"), "timed_out", us("purge_at"))
