"""Small fixed dimensions and the expressions that look them up.

All of them are literals: Catalyst folds the map once per query, so a lookup is a
projection and neither a join nor a broadcast is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. They must equal the service's for the results to be the same.
# ---------------------------------------------------------------------------

PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

EXTENSION_MIME = {
    ".pdf": PDF,
    ".docx": DOCX,
    ".xlsx": XLSX,
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xml": "application/xml",
}
TEXT_EXTENSIONS = (".txt", ".csv", ".json", ".xml", ".html", ".htm")
ZIP_EXTENSIONS = (".docx", ".xlsx")

ZIP_MAGIC = b"PK\x03\x04"
PDF_MAGIC = b"%PDF"
# (offset, magic, mime); the first match in this order wins.
SIGNATURES = (
    (0, PDF_MAGIC, PDF),
    (0, ZIP_MAGIC, DOCX),
    (0, b"<?xml", "application/xml"),
    (0, b"<html", "text/html"),
    (0, b"<!DOCTYPE", "text/html"),
    (0, b"{", "application/json"),
    (0, b"[", "application/json"),
)

IMAGE_MIME = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
}
DEFAULT_IMAGE_MIME = "application/octet-stream"

# stage -> label, in pipeline order; the position is the rank.
STAGES = {
    "UPLOADED": "File Uploaded & Validated",
    "SCANNING": "Sandbox Isolation & Malware Scan",
    "PARSING": "Parsing Text & Tables",
    "RESOLVING_ASSETS": "Resolving Image Assets",
    "PACKAGING": "Packaging Artifacts",
}
TERMINAL = ("SUCCESS", "FAILURE")

# error class -> (context, HTTP status, user message)
ERRORS = {
    "IngestionError": ("ingestion", 400, "The file could not be accepted for processing."),
    "ParsingError": ("parsing", 422, "The document could not be converted."),
    "AssetError": ("asset", 500, "The output package could not be assembled."),
    "PayloadTooLargeError": ("ingestion", 413, "File exceeds the maximum allowed size of 50 MB."),
    "BatchSizeLimitExceededError": (
        "ingestion", 400, "Batch upload exceeds the maximum allowed count of 10 files."),
    "MagicNumberMismatchError": (
        "ingestion", 400,
        "The uploaded file could not be validated. Please check the file and try again."),
    "UnsupportedFileTypeError": (
        "ingestion", 400,
        "This file type is not supported. Accepted types: "
        "PDF, DOCX, XLSX, HTML, TXT, CSV, JSON, XML."),
    "SandboxCreationError": (
        "ingestion", 500,
        "An unexpected error occurred while preparing the conversion environment."),
    "VirusDetectedError": (
        "ingestion", 400,
        "The file was rejected by the security scanner. Please ensure it is free of malware."),
    "AntivirusUnavailableError": (
        "ingestion", 503,
        "The security scanning service is temporarily unavailable. Please try again shortly."),
    "TaskNotFoundError": ("ingestion", 404, "The requested conversion task was not found."),
    "TaskAlreadyPurgedError": (
        "ingestion", 410,
        "The conversion result has expired and is no longer available for download."),
    "MarkdownCompilationError": (
        "parsing", 422,
        "The document could not be converted to Markdown. "
        "The file may be corrupted or unsupported."),
    "PdfImageExtractionError": (
        "parsing", 422, "Image assets could not be extracted from the PDF."),
    "XmlInjectionAttemptError": (
        "parsing", 400, "The file was rejected due to a security policy violation."),
    "Base64EncodingError": (
        "asset", 500,
        "An error occurred while embedding image assets into the Markdown output."),
    "ZipPackagingError": (
        "asset", 500, "The output package could not be created. Please try again."),
}
GENERIC_STATUS = 500
GENERIC_MESSAGE = "An unexpected error occurred. Please try again."
PIPELINE_MESSAGE = "An unexpected error occurred during processing."

TOO_LARGE = "PayloadTooLargeError"
UNSUPPORTED = "UnsupportedFileTypeError"
MISMATCH = "MagicNumberMismatchError"
BATCH_LIMIT = "BatchSizeLimitExceededError"
VIRUS = "VirusDetectedError"
SCAN_UNAVAILABLE = "AntivirusUnavailableError"
MARKDOWN_FAILED = "MarkdownCompilationError"
XML_ATTACK = "XmlInjectionAttemptError"
NOT_FOUND = "TaskNotFoundError"
PURGED = "TaskAlreadyPurgedError"

# errors that fail a task at another stage than the last one
FAILURE_STAGE = {
    VIRUS: "SCANNING",
    SCAN_UNAVAILABLE: "SCANNING",
    MARKDOWN_FAILED: "PARSING",
}


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of ``table`` at ``key``; ``default`` (or NULL) for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def stage_rank(stage: Column) -> Column:
    """Position of a stage in the pipeline; an unknown stage ranks 0."""
    return lookup(stage, {s: i for i, s in enumerate(STAGES)}, 0)

# What followers are told when a state has lapsed.
TASK_NOT_FOUND = "task_not_found"
NO_TASKS_FOUND = "no_tasks_found"
