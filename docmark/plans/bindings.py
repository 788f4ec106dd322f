"""Operator inputs derived from the test tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmark.limits import DEFAULT
from docmark.operators.carry import Timeline, has_large_key
from docmark.sources.uploads import uploads_from_table

LIMITS = DEFAULT
SMALL_LIMIT = 16_384  # only for the query that shows the size rejection
TTL_S = 43_200
KEEP_S = 86_400
BEAT_S = 3_600
PATTERN_CHARS = 30
STREAM_FILES, STREAM_FILE_ROWS, STREAM_BLOCK_BYTES = 3, 1_000_000, 4 << 20
FAIL_REASON = "The document could not be converted to Markdown."
PATTERNS = (b'token = "', b"PRIVATE KEY")
XML_HEAD = '<?xml version="1.0"?><!DOCTYPE item [<!ENTITY who "nobody">]>'
EXTENSIONS = {5: ".csv", 6: ".json", 7: ".pdf", 8: ".docx", 9: ".exe"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5(*parts: Column | str) -> Column:
    return F.md5(F.concat(*[
        F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


# --- files -------------------------------------------------------------------


def uploads_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(table(spark, sf_dir, "documents"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of all kinds, some of them not what they claim."""
    kind = F.col("doc_id") % 10
    ext = F.lit(".txt")
    for k, e in EXTENSIONS.items():
        ext = F.when(kind == k, e).otherwise(ext)
    head = F.when(F.col("doc_id") % 20 == 7, "%PDF-1.4 ").when(
        (F.col("doc_id") % 20).isin(6, 8), "PK\x03\x04").otherwise("")
    files = uploads_from_table(
        docs, "doc_id", F.concat(head, F.col("text")), ext, prefix="doc_")
    return files.withColumn("task_id", md5(F.col("doc_id")))


def uploads_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return uploads_from_table(pages, "page_id", "html", ".html", prefix="page_").withColumn(
        "task_id", md5("p", F.col("page_id")))


def uploads_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as files of the kinds that documents and pages are not.

    The XML ones declare an entity and refer to it.
    """
    kind = F.pmod(F.crc32(F.col("item_id").cast("string").cast("binary")), F.lit(3))
    body = F.when(kind == 0, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))).when(
        kind == 1, F.concat(F.lit("PK\x03\x04"), F.col("text"))).otherwise(F.concat(
            F.lit(XML_HEAD), F.lit("<item>&who; "), F.col("text"), F.lit("</item>")))
    ext = F.when(kind == 0, ".htm").when(kind == 1, ".xlsx").otherwise(".xml")
    items = table(spark, sf_dir, "benchmark").select("item_id", body.alias("body"), ext.alias("ext"))
    return uploads_from_table(items, "item_id", "body", F.col("ext"), prefix="item_").withColumn(
        "task_id", md5("i", F.col("item_id")))


def uploads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = uploads_documents(spark, sf_dir).drop("doc_id")
    return docs.unionByName(uploads_pages(spark, sf_dir).drop("page_id"))


def uploads_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all nine kinds."""
    return uploads_all(spark, sf_dir).unionByName(uploads_items(spark, sf_dir).drop("item_id"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scanner said of the documents: by the length of their texts."""
    docs = table(spark, sf_dir, "documents")
    odd = F.col("n_chars") % 101
    return docs.select(md5(F.col("doc_id")).alias("task_id"), F.when(odd == 0, "infected").when(
        odd == 1, "unavailable").when(odd == 2, "pending").otherwise("clean").alias("verdict"))


def document_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(assets, errors)``: two images of the documents that are layouts, some of them lost."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 = 7").select(
        md5(F.col("doc_id")).alias("task_id"), "doc_id", "source")
    lost = docs.where("doc_id % 50 = 7").select(
        "task_id", F.when(F.col("doc_id") % 100 == 7, "PdfImageExtractionError").otherwise("KeyError").alias("error"))
    images = docs.select("task_id", F.col("source").alias("extension"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    return images.select(
        "task_id", F.lit(0).cast("long").alias("page_index"), F.col("i").cast("long").alias("image_index"),
        F.concat(F.lit("img"), F.when(F.col("i") == 1, F.substring("task_id", 1, 1)).otherwise(F.lit("0")), F.lit(".png")).alias("name"),
        F.concat("task_id", F.col("i").cast("string")).cast("binary").alias("data"), F.lit("png").alias("extension")), lost


def document_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the documents' tasks began and ended: a tenth of a second a character."""
    docs = table(spark, sf_dir, "documents")
    begun = F.lit(1_700_000_000_000).cast("long") + F.col("doc_id") * 1000
    return docs.select(
        md5(F.col("doc_id")).alias("task_id"), F.timestamp_millis(begun).alias("started_at"),
        F.timestamp_millis(begun + F.col("n_chars") * 100).alias("finished_at"))


def batched(files: DataFrame) -> DataFrame:
    """Files in batches: of 7 where ``doc_id div 84`` is even, else of 12 (over the limit)."""
    doc = F.col("doc_id")
    seven = F.floor(doc / 84) % 2 == 0
    return files.withColumn(
        "batch_id",
        F.when(seven, md5("b", F.floor(doc / 7))).otherwise(md5("c", F.floor(doc / 12)))
    ).withColumn("pos", F.when(seven, doc % 7).otherwise(doc % 12))


def batch_records(members: DataFrame) -> DataFrame:
    """``batch_id, task_ids``: the JSON record of each batch (12 members at most)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "task_id")))["task_id"]
    return members.groupBy("batch_id").agg(F.to_json(listed).alias("task_ids"))


FILE_DOCS = 200


def documents_in_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Documents as files of three kinds below a folder, 200 ids to a file.

    A third of the files are texts, a third CSV and a third JSON lines; the number of a file
    is in its folder's name.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))
    docs = docs.withColumn("file", F.floor(F.col("doc_id") / FILE_DOCS))
    kind = F.pmod("file", F.lit(3))
    texts = docs.where(kind == 0).groupBy("file").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"], "\n").alias("value"))
    texts.write.partitionBy("file").text(f"{path}/txt")
    lines = docs.drop("text").repartition("file").sortWithinPartitions("file", "doc_id")
    lines.where(kind == 1).write.partitionBy("file").csv(f"{path}/csv")
    lines.where(kind == 2).write.partitionBy("file").json(f"{path}/json")


def toxic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the contents labelled toxic."""
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    # digests first, so that no content moves
    digests = uploads_documents(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))
    return digests.join(toxic, "doc_id", "left_semi").select("sha256").distinct()


# --- status ------------------------------------------------------------------


def user_split(spark: SparkSession, sf_dir: str) -> bool | None:
    """How to window over anything that belongs to one user.

    Tasks and their batches are each within one user, so without a large user none of
    them is large; with one, every operator counts its own keys.
    """
    return None if has_large_key(table(spark, sf_dir, "events"), ["user_id"]) else False


def status_events(spark: SparkSession, sf_dir: str, split: bool | None = None) -> DataFrame:
    """A user's events as the life of tasks: each signup starts the user's next one."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    line = Timeline(["user_id"], ["ts", "event_id"], split)
    ev = line.spread(ev)
    ev = line.window(
        ev, run=line.running_sum((F.col("event_type") == "signup").cast("long")))
    kind = F.col("event_type")
    op = F.when(kind == "signup", "init").when(kind == "error", "fail").otherwise("advance")
    stage = F.when(kind == "signup", "UPLOADED").when(kind == "view", "SCANNING").when(
        kind.isin("click", "error"), "PARSING").otherwise("PACKAGING")
    status = F.when(kind == "signup", "PENDING").when(kind == "purchase", "SUCCESS").when(
        kind == "error", "FAILURE").otherwise("ACTIVE")
    return ev.select(
        md5("u", F.col("user_id"), "-", F.col("run")).alias("task_id"),
        "event_id", "ts", op.alias("op"), stage.alias("stage"), status.alias("status"),
        F.when(kind == "error", FAIL_REASON).alias("error_reason"), "user_id", "run")


def run_members(events: DataFrame) -> DataFrame:
    """``batch_id, pos, task_id``: ten consecutive tasks of a user make a batch."""
    return events.filter(F.col("op") == "init").select(
        md5("r", F.col("user_id"), "-", F.floor(F.col("run") / 10)).alias("batch_id"),
        (F.col("run") % 10).alias("pos"), "task_id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "transient").when(kind == "click", "permanent").otherwise(
        "success")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), "ts", "event_id", outcome.alias("outcome"))


def scan_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(files, results)``: a user whose events are all purchases would have no rows."""
    ev = table(spark, sf_dir, "events")
    high = F.col("value") > 150
    status = F.when((F.col("event_type") == "error") & high, "FOUND").when(
        (F.col("event_type") == "signup") & high, "ERROR").otherwise("OK")
    results = ev.select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("ord"), status.alias("status"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id")).join(
        results.select("file_id").distinct().withColumn("_a", F.lit(True)), "file_id", "left"
    ).select("file_id", F.coalesce("_a", F.lit(False)).alias("answered"))
    return files, results


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), "ts", "event_id",
        (F.col("event_type") != "error").alias("ok"))


# --- layouts and assets ------------------------------------------------------


def layout_relations(spark: SparkSession, sf_dir: str
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tables, lines, pages)``: a customer's orders are pages, line items their contents."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_no"))
    pages = orders.withColumn("height", F.lit(800.0))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    ).join(orders, F.col("l_orderkey") == F.col("page_no"))
    # rows with the same id have the same contents, so that their order does not matter
    table_id = F.concat_ws("-", *[F.col(c).cast("string") for c in (
        "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])
    line_no = F.col("l_partkey") * 10 + F.col("l_linenumber")
    top = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 37).cast("double")
    bottom = top + (40 + F.col("l_suppkey") % 80).cast("double")
    box = F.when(
        F.col("l_partkey") % 11 == 0, F.array(F.lit(0.0), top, F.lit(500.0))
    ).otherwise(F.array(F.lit(0.0), top, F.lit(500.0), bottom))
    grid = F.array(
        F.array(F.lit("part"), F.lit("flag|status")),
        F.array(F.col("l_partkey").cast("string"),
                F.concat("l_returnflag", F.lit("\n"), "l_linestatus")))
    tables = items.filter(F.col("l_suppkey") % 3 == 0).select(
        "doc_id", "page_no", table_id.alias("table_id"), box.alias("bbox"), grid.alias("grid"))
    text = F.when(F.col("l_suppkey") % 7 == 0, "   ").otherwise(F.concat(
        F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" "),
        F.col("l_partkey").cast("string")))
    line_top = (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 90).cast("double")
    lines = items.select(
        "doc_id", "page_no", line_no.alias("line_no"), line_top.alias("top"),
        (line_top + 10.0).alias("bottom"), text.alias("text"))
    return tables, lines, pages


def asset_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(docs, assets)``: an order is a document, its line items are images."""
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string")).alias("markdown"))
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("png", "JPG", "gif", "tiff", "svg")]),
        (F.col("l_partkey") % 5 + 1).cast("int"))
    # the part and supplier make the image's place unique within its order
    image = F.col("l_partkey") * 1_000 + F.col("l_suppkey") % 1_000
    name = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("logo."), ext)).otherwise(
        F.concat(F.lit("img"), F.col("l_partkey").cast("string"), F.lit("."), ext))
    data = F.concat_ws(
        "|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).cast("binary")
    assets = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"),
        image.alias("image_index"), name.alias("name"), data.alias("data"),
        F.lower(ext).alias("extension"))
    return docs, assets


def paged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested images of each document: its lines are pages, words before a full stop images."""
    docs = table(spark, sf_dir, "documents")
    words = F.transform(
        F.split("text", "\n"),
        lambda page: F.transform(
            F.regexp_extract_all(page, F.lit(r"(\S*)\. "), F.lit(1)),
            lambda w: F.struct(w.alias("name"), F.encode(w, "UTF-8").alias("data"))))
    return docs.select("doc_id", words.alias("pages"))
