"""File listings: newest file, inventory per tenant, upload checks, whole-file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.functions import vocab


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of ``root/<tenant>/<name>`` as (tenant, path, modified, size); no content is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(
            F.element_at(F.split("path", "/"), -2).alias("tenant"),
            "path",
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("size"),
        )
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty when there is none."""
    return F.regexp_extract(F.lower(file_name(path)), r"\.([^.]*)$", 1)


def audit_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin(*vocab.TABLE_EXTENSIONS), "data")
        .when(ext.isin("txt", "doc", "docx"), "document")
        .otherwise("other")
    )


def latest_file(files: DataFrame) -> DataFrame:
    """Newest table file of each tenant (ties go to the larger path)."""
    tables = files.filter(extension(F.col("path")).isin(*vocab.TABLE_EXTENSIONS))
    return tables.groupBy("tenant").agg(
        F.max_by("path", F.struct("modified", "path")).alias("path"),
        F.max("modified").alias("modified"),
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Per tenant: is there any usable file, and how many of each audit type."""
    shown = ~file_name(F.col("path")).startswith(".")
    usable = shown & extension(F.col("path")).isin(*vocab.DATA_EXTENSIONS)
    kind = audit_type(F.col("path"))
    return files.groupBy("tenant").agg(
        F.bool_or(usable).alias("has_data"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("pdf", "data", "document", "other")],
    )


# --- fixed values: leading bytes of common formats ----------------------------------------------
SIGNATURES = (
    ("25504446", "application/pdf"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("4D5A", "application/vnd.microsoft.portable-executable"), ("7F454C46", "application/x-elf"),
    ("1F8B", "application/gzip"), ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/x-rar-compressed"), ("504B0506", "application/zip"),
)
OPEN_XML = "application/vnd.openxmlformats-officedocument"
#: Bytes that no text holds.
BINARY_BYTES = r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]"
# ------------------------------------------------------------------------------------------------


def sniff_mime(content: Column) -> Column:
    """Content type from the leading bytes; an unknown binary is ``application/octet-stream``."""
    magic = F.hex(F.substring(content, 1, 8))
    lead = F.decode(F.substring(content, 1, 4096), "iso-8859-1")
    head = F.lower(F.ltrim(F.substring(lead, 1, 64)))
    zipped = (
        F.when(lead.contains("xl/"), f"{OPEN_XML}.spreadsheetml.sheet")
        .when(lead.contains("word/"), f"{OPEN_XML}.wordprocessingml.document")
        .otherwise("application/zip")
    )
    found = F.when(magic.startswith("504B0304"), zipped)
    for signature, name in SIGNATURES:
        found = found.when(magic.startswith(signature), name)
    marked = magic.startswith("FFFE") | magic.startswith("FEFF")  # UTF-16
    return (
        found.when(~marked & lead.rlike(BINARY_BYTES), "application/octet-stream")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html")
        .when(head.startswith("{"), "application/json")
        .otherwise("text/plain")
    )


def upload_check(files: DataFrame, max_bytes: int = vocab.UPLOAD_MAX_BYTES) -> DataFrame:
    """Adds ``mime``, ``mime_ok`` and ``size_ok`` to rows with ``path`` and ``content``.

    Both OLE office types share one signature, so it stands for either of them; an xlsx may look like
    a plain zip.
    """
    ext, mime = extension(F.col("path")), F.col("mime")
    ok = F.lit(False)
    for name, allowed in vocab.ALLOWED_MIME.items():
        hits = [mime.startswith(a) for a in allowed]
        if name in ("xls", "doc"):
            hits.append(mime == "application/x-ole-storage")
        if name == "xlsx":
            hits.append(mime == "application/zip")
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        ok = ok | ((ext == name) & any_hit)
    return (
        files.withColumn("mime", sniff_mime(F.col("content")))
        .withColumn("mime_ok", ok)
        .withColumn("size_ok", F.octet_length("content") <= max_bytes)
    )


def decode_text(content: Column) -> Column:
    """Bytes as utf-8 text; undecodable bytes become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_text(F.col("content")).alias("text"))


def json_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """A log with one raw JSON body per line as (file, body); fields are read on use."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


def display_widths(df: DataFrame, ceiling: int = 60) -> DataFrame:
    """Per column the filled cells and the display width: longest text or name plus two, up to
    ``ceiling``."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [
            F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"w{i}"),
            F.count(F.col(f"`{c}`")).alias(f"n{i}"),
        ]
    longest = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("filled"),
            F.least(
                F.greatest(F.coalesce(f"w{i}", F.lit(0)), F.lit(len(c))) + 2, F.lit(ceiling)
            ).cast("long").alias("width"),
        )
        for i, c in enumerate(df.columns)
    ]))
    return longest.select(rows.alias("r")).select("r.*")


