"""The conversion pipeline over a whole corpus.

Contents are read once. Everything that needs them is one projection over the files: intake
checks, digest and patterns of the scan, the route and the conversion. What other relations
decide (threat lists, verdicts and retries of a scanner, decoded layouts, lost assets) then meets
the projection's rows, which are written first where there is any, on keys and digests alone.
Failures are rows, so one bad file never stops another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmark import dims
from docmark.functions import text
from docmark.functions.binary import contains_any
from docmark.functions.html import html_to_markdown
from docmark.functions.names import output_name, path_suffix
from docmark.functions.tables import csv_to_markdown
from docmark.limits import DEFAULT, Limits
from docmark.operators import assets as asset_ops
from docmark.operators import status, validation
from docmark.scratch import scratch_path

#: Rows of a list of stopped files that go to all tasks (below 100 bytes each).
HASH_ROWS = 1_000_000

ROUTES = {
    ".pdf": "layout",
    ".docx": "cells",
    ".xlsx": "cells",
    ".html": "html",
    ".htm": "html",
    ".txt": "text",
    ".csv": "csv",
    ".json": "json",
    ".xml": "xml",
}
DECODED = ("layout", "cells")


def _text_markdown(route: Column, content: Column) -> Column:
    raw = content.cast("string")
    return (
        F.when(route == "html", html_to_markdown(raw))
        .when(route == "text", text.text_to_markdown(raw))
        .when(route == "csv", csv_to_markdown(raw))
        .when(route == "json", text.json_to_markdown(raw))
        .when(route == "xml", text.xml_to_markdown(raw)))


def route_by_type(accepted: DataFrame, decoded: DataFrame | None = None,
                  key: str = "task_id", strict_xml: bool = False) -> DataFrame:
    """Replace ``content`` by ``route, markdown, error``.

    The route follows the path's suffix. Rows that already carry an ``error`` keep it and
    are not converted. Files of formats whose bytes are decoded elsewhere (page layouts,
    cell sheets) take their text from ``decoded`` (``key, markdown[, error]``); without a
    text there they fail like any file that cannot be converted. XML is converted without
    its declarations, so that no entity is ever expanded; ``strict_xml`` refuses files that
    declare any.

    Without ``decoded`` this is one projection. With it, the projection's rows are written, and
    those that wait for a decoded text are joined on their own, so that no converted text is
    shuffled.
    """
    direct = _direct(accepted, strict_xml)
    if decoded is None:
        return direct.drop("_waits")
    return _with_decoded(_written(direct), decoded, key)


def _direct(accepted: DataFrame, strict_xml: bool) -> DataFrame:
    """The projection of :func:`route_by_type`; ``_waits`` marks files without a text of their own."""
    before = F.col("error") if "error" in accepted.columns else F.lit(None).cast("string")
    route = dims.lookup(path_suffix(F.col("filename")), ROUTES)
    attack = (
        F.lit(strict_xml) & (F.col("route") == "xml")
        & text.xml_has_entities(F.col("content")))
    waits = F.col("error").isNull() & F.coalesce(F.col("route").isin(*DECODED), F.lit(False))
    routed = accepted.withColumn("error", before).withColumn("route", route)
    own = F.coalesce(
        F.col("error"),
        F.when(F.col("route").isNull() | F.col("route").isin(*DECODED), dims.MARKDOWN_FAILED)
        .when(attack, dims.XML_ATTACK))
    return routed.withColumn("_waits", waits).withColumn("error", own).withColumn("markdown", F.when(
        F.col("error").isNull(), _text_markdown(F.col("route"), F.col("content")))).drop("content")


def _written(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "pipeline")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _with_decoded(direct: DataFrame, decoded: DataFrame, key: str) -> DataFrame:
    """Rows that wait (``_waits``) with their decoded text or error; the others as they are."""
    given = F.col("error") if "error" in decoded.columns else F.lit(None).cast("string")
    texts = decoded.select(key, "markdown", given.alias("_given"))
    met = direct.filter("_waits").drop("markdown", "error").join(texts, key, "left").withColumn(
        "error", F.coalesce("_given", F.when(F.col("markdown").isNull(), dims.MARKDOWN_FAILED)))
    return direct.filter("NOT _waits").drop("_waits").unionByName(met.drop("_given", "_waits"))


def _stops(rows: DataFrame, hashes: DataFrame | None, verdicts: DataFrame | None,
           asset_errors: DataFrame | None) -> DataFrame | None:
    """``task_id, _stop, _at`` of the files that other relations stop, first the scan.

    Threat lists are joined on digests, verdicts and lost assets on keys; only these move.
    """
    parts = []
    rank = lambda n, error, at: F.struct(
        F.lit(n).alias("n"), error.alias("error"), F.lit(at).alias("at")).alias("_s")
    if hashes is not None:
        known = hashes.select(F.col("sha256").alias("_sha")).distinct()
        parts.append(rows.select("task_id", "_sha").join(known, "_sha", "left_semi").select(
            "task_id", rank(0, F.lit(dims.VIRUS), "scan")))
    if verdicts is not None:
        bad = verdicts.filter(~F.col("verdict").isin("clean", "success"))
        parts.append(bad.select("task_id", F.when(F.col("verdict") == "infected", rank(0, F.lit(dims.VIRUS), "scan")).when(
            F.col("verdict") == "pending", rank(2, F.lit(None).cast("string"), "scan")).otherwise(
                rank(1, F.lit(dims.SCAN_UNAVAILABLE), "scan")).alias("_s")))
    if asset_errors is not None:
        parts.append(asset_errors.select("task_id", rank(3, F.col("error"), "assets")))
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("task_id").agg(F.min("_s").alias("_s")).select(
        "task_id", F.col("_s.error").alias("_stop"), F.col("_s.at").alias("_at"))


def _history(phase: Column, error: Column) -> Column:
    """Status events of one accepted file, from where it ended and its error.

    A scan that has not come to an end leaves the file at its stage.
    """
    def event(seq: int, op: str, stage: str | Column, status: str, reason: Column | None = None) -> Column:
        why = F.lit(None).cast("string") if reason is None else reason
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(op).alias("op"),
            (F.lit(stage) if isinstance(stage, str) else stage).alias("stage"),
            F.lit(status).alias("status"), why.alias("error_reason"))

    own = {k: dims.ERRORS[k][2] for k in dims.FAILURE_STAGE}
    reason = dims.lookup(error, own, dims.PIPELINE_MESSAGE)
    failed_at = dims.lookup(error, dims.FAILURE_STAGE, "PACKAGING")
    start = [
        event(0, "init", "UPLOADED", "PENDING"),
        event(1, "advance", "SCANNING", "ACTIVE"),
    ]
    parsing = [*start, event(2, "advance", "PARSING", "ACTIVE")]
    resolving = [*parsing, event(3, "advance", "RESOLVING_ASSETS", "ACTIVE")]
    done = [
        event(4, "advance", "PACKAGING", "ACTIVE"),
        event(5, "advance", "PACKAGING", "SUCCESS"),
    ]
    fail = lambda seq: event(seq, "fail", failed_at, "FAILURE", reason)
    return (
        F.when(phase == "done", F.array(*resolving, *done))
        .when((phase == "scan") & error.isNull(), F.array(*start))
        .when(phase == "scan", F.array(*start, fail(2)))
        .when(phase == "parse", F.array(*parsing, fail(3)))
        .otherwise(F.array(*resolving, fail(4))))


def process_corpus(uploads: DataFrame, hashes: DataFrame | None = None,
                   patterns: Sequence[bytes] = (), decoded: DataFrame | None = None,
                   limits: Limits = DEFAULT, verdicts: DataFrame | None = None,
                   asset_errors: DataFrame | None = None, strict_xml: bool = False,
                   write: bool = False) -> DataFrame:
    """Every upload with ``mime, phase, route, markdown, error`` and no content.

    ``phase`` is where it ended: intake (no task was made), scan, parse, assets or done.
    ``hashes`` (``sha256``) and ``patterns`` are known threats, ``verdicts`` (``task_id, verdict``)
    what a scanner has said after its retries, ``asset_errors`` (``task_id, error``) images that
    could not be extracted. A file waits in the scan while its verdict is pending.

    With any of these, or with ``write``, the projection is written, for callers that use the
    rows more than once; else it is lazy, without a shuffle.
    """
    checked = validation.checked_uploads(uploads, limits).withColumn(
        "_hit", contains_any(F.col("content"), patterns))
    if hashes is not None:
        checked = checked.withColumn("_sha", F.sha2(F.col("content"), 256))
    refused, hit = F.col("error").isNotNull(), F.coalesce("_hit", F.lit(False))
    screened = checked.withColumn("phase", F.when(refused, "intake").when(hit, "scan")).withColumn(
        "error", F.when(refused, F.col("error")).when(hit, dims.VIRUS)).drop("_hit")
    ended = F.coalesce("phase", F.when(F.col("error").isNull(), "done").otherwise("parse"))
    if not write and decoded is None and hashes is None and verdicts is None and asset_errors is None:
        return route_by_type(screened, strict_xml=strict_xml).withColumn("phase", ended)

    rows = _written(_direct(screened, strict_xml))
    stops = _stops(rows, hashes, verdicts, asset_errors)
    if decoded is not None:
        rows = _with_decoded(rows, decoded, "task_id")
    rows = rows.drop("_sha", "_waits").withColumn("phase", ended)
    if stops is None:
        return rows
    stops = _written(stops)
    few = stops.limit(HASH_ROWS + 1).count() <= HASH_ROWS
    met = rows.join(F.broadcast(stops) if few else stops, "task_id", "left")
    # a file that was refused has no scan, and one that the scan stopped no assets
    held = F.col("_at").isNotNull() & (F.col("phase") != "intake") & (
        (F.col("_at") == "scan") | (F.col("phase") == "done"))
    scanned = (F.col("phase") == "scan") & F.col("error").isNotNull()
    stopped = held & ~scanned
    return met.select(
        *[c for c in rows.columns if c not in ("phase", "error", "markdown")],
        F.when(stopped, F.col("_at")).otherwise(F.col("phase")).alias("phase"),
        F.when(stopped, F.col("_stop")).otherwise(F.col("error")).alias("error"),
        F.when(~stopped, F.col("markdown")).alias("markdown"))


def convert_corpus(uploads: DataFrame, mode: str = "standalone",
                   hashes: DataFrame | None = None, patterns: Sequence[bytes] = (),
                   decoded: DataFrame | None = None, assets: DataFrame | None = None,
                   limits: Limits = DEFAULT, **stops) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(converted, failures, status_events)`` of ``task_id, filename, content, length``.

    Standalone output embeds the assets (``task_id, page_index, image_index, name, data,
    extension``), any other mode links them; :func:`corpus_packages` makes the package of the
    latter. Contents are read and converted once, and the three results read what was written.
    """
    done = process_corpus(uploads, hashes, patterns, decoded, limits, write=True, **stops)
    return split_corpus(done, mode, assets)


def split_corpus(done: DataFrame, mode: str = "standalone", assets: DataFrame | None = None
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three results of :func:`convert_corpus` from processed rows."""
    good = done.filter(F.col("phase") == "done").withColumn(
        "output_name", output_name(F.col("filename"), F.lit(mode)))
    converted = good
    if assets is not None:
        append = asset_ops.inline_assets if mode == "standalone" else asset_ops.link_assets
        held = assets.join(good.select("task_id"), "task_id", "left_semi")
        texts = append(
            good.select(F.col("task_id").alias("doc_id"), "markdown"),
            held.withColumnRenamed("task_id", "doc_id"))
        converted = good.drop("markdown").join(
            texts.withColumnRenamed("doc_id", "task_id"), "task_id")
    converted = converted.drop("error", "phase")
    failures = done.filter(F.col("error").isNotNull()).drop("markdown", "route")
    events = done.filter(F.col("phase") != "intake").select(
        "task_id", F.inline(_history(F.col("phase"), F.col("error"))))
    return converted, failures, events


def corpus_packages(converted: DataFrame, assets: DataFrame) -> DataFrame:
    """Entries of the package of each converted file, from its linked text and its assets.

    ``task_id, output_name, page_index, image_index, path, data``.
    """
    names = converted.select("task_id", "output_name")
    docs = converted.select(F.col("task_id").alias("doc_id"), "markdown")
    held = assets.join(names.select("task_id"), "task_id", "left_semi").withColumnRenamed("task_id", "doc_id")
    entries = asset_ops.package_manifest(docs, held).withColumnRenamed("doc_id", "task_id")
    return entries.join(names, "task_id").select(
        "task_id", "output_name", "page_index", "image_index", "path", "data")


def convert_batches(uploads: DataFrame, mode: str = "standalone",
                    hashes: DataFrame | None = None, patterns: Sequence[bytes] = (),
                    decoded: DataFrame | None = None, limits: Limits = DEFAULT,
                    times: DataFrame | None = None, **stops) -> DataFrame:
    """Archive entries of every batch that is taken in, from ``batch_id, pos`` uploads.

    A batch with too many files, or with a bad one, leaves no batch record and so has no
    archive. Batch rules work on narrow columns; texts stay with their tasks.

    With ``times`` (``task_id, started_at, finished_at``) a batch closes when its last member
    has ended or its time is up, and members that have not ended by then are left out. Entries
    then have ``closes_at, timed_out`` and ``purge_at``, as an archive has a clock of its own.
    """
    done = process_corpus(uploads, hashes, patterns, decoded, limits, **stops)
    good = F.col("phase") == "done"
    members = _written(done.select(
        "batch_id", "pos", "task_id",
        F.when(good, output_name(F.col("filename"), F.lit(mode))).alias("file_name"),
        (F.col("phase") == "intake").alias("_refused")))
    # one pass over the narrow rows decides the batches
    taken = members.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("_refused").alias("_bad")
    ).filter((F.col("_n") <= limits.max_batch_files) & ~F.col("_bad")).select("batch_id")
    members = members.join(taken, "batch_id", "left_semi")
    if times is None:
        return asset_ops.batch_manifest(members.filter(F.col("file_name").isNotNull()))
    timed = members.join(times.select("task_id", "started_at", "finished_at"), "task_id", "left")
    starts = timed.groupBy("batch_id").agg(F.min("started_at").alias("started_at"))
    states = timed.drop("started_at").join(starts, "batch_id").withColumn(
        "status", F.when(F.col("file_name").isNull(), "FAILURE").otherwise("SUCCESS"))
    closed = status.batch_barrier(states, limits.barrier_timeout_s).select("batch_id", "closes_at", "timed_out")
    kept = states.join(closed, "batch_id").filter(
        F.col("file_name").isNotNull() & (F.col("finished_at").cast("timestamp") <= F.col("closes_at")))
    return asset_ops.batch_manifest(kept).join(closed, "batch_id").withColumn(
        "purge_at", F.col("closes_at") + F.make_dt_interval(secs=F.lit(limits.retention_s)))
