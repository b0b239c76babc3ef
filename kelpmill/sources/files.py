"""Files as documents: recursive scan, incremental rule, live ids, mapping, latest export by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.sources.extract import extracted

#: Folders and extensions that are passed over, how the content of a file is taken by its extension.
SKIP_FOLDERS = (".git", "node_modules", "dist", ".next", ".omc", ".sisyphus", ".claude")
SKIP_EXTENSIONS = ("bak", "gitkeep", "plist", "lock", "ds_store")
TEXT = ("md", "txt", "csv", "json", "jsonl", "js", "ts", "tsx", "py", "sh")
STRUCTURED = ("html", "htm", "pdf", "docx", "xlsx", "pptx", "hwpx")
STUBS = {"gsheet": "Google Sheet", "gdoc": "Google Doc", "gscript": "Google Apps Script", "gslides": "Google Slides", "gform": "Google Form"}
IMAGES = ("png", "jpg", "jpeg", "gif", "svg")
ARCHIVES = ("zip", "apk", "tar", "gz")
MOST_TEXT, MOST_STUB = 512 * 1024, 1024  # bytes


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Path relative to root, name, extension, size, modification time and content, lazily read. Files without a byte
    have no row: the file source leaves them out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.replace("file://", "").rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    name = F.substring_index(rel, "/", -1)
    ext = F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(""))
    rows = rows.select(rel.alias("source_id"), name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    inside = F.exists(F.slice(F.split("source_id", "/"), 1, F.greatest(F.size(F.split("source_id", "/")) - 1, F.lit(0))), lambda f: f.isin(*SKIP_FOLDERS))
    return rows.filter(~inside & ~F.col("ext").isin(*SKIP_EXTENSIONS) & (F.octet_length("name") <= 255))


def incremental(files: DataFrame, since: Column, known: DataFrame) -> DataFrame:
    """Changed since, or never seen."""
    ids = known.select("source_id").distinct().withColumn("_known", F.lit(True))
    return files.join(ids, "source_id", "left").filter((F.col("mtime") > since) | F.col("_known").isNull()).drop("_known")


def untranscribed(files: DataFrame, since: Column | None, known: DataFrame | None) -> DataFrame:
    """Of recordings the list of known ids decides alone; only without a list the modification time does."""
    if known is not None:
        return files.join(known.select("source_id").distinct(), "source_id", "left_anti")
    return files if since is None else files.filter(F.col("mtime") > since)


def live_ids(files: DataFrame) -> DataFrame:
    """An empty scan is an error of the caller, not a reason to delete."""
    return files.select("source_id").distinct()


def content(name: Column, path: Column, ext: Column, size: Column, data: Column) -> Column:
    """text and structured files by their text, links to online documents by their address, others by what is
    known of them; notes tell what was too large, empty or unreadable."""
    head = F.concat(F.lit("File: "), name, F.lit("\nPath: "), path)
    sized = F.concat(head, F.lit("\nSize: "), X.human_size(size))
    text = F.when(ext.isin(*TEXT, *STRUCTURED), extracted(F.when(ext.isin(*TEXT, *STRUCTURED), data), name))
    url = F.regexp_extract(F.when(ext.isin(*STUBS), data.cast("string")), r"""https?://[^\s"']+""", 0)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in STUBS.items() for x in kv]), ext)
    return (
        F.when(ext.isin(*TEXT) & (size > MOST_TEXT), F.concat(sized, F.lit("\n[large file — metadata only]")))
        .when(ext.isin(*TEXT), F.coalesce(F.nullif(text, F.lit("")), F.concat(sized, F.lit("\n[content unavailable]"))))
        .when(ext.isin(*STRUCTURED), F.coalesce(F.nullif(text, F.lit("")), F.concat(sized, F.lit("\n[no text content extracted]"))))
        .when(ext.isin(*STUBS) & (size == 0), F.concat(head, F.lit("\n[Google Drive stub — metadata only]")))
        .when(ext.isin(*STUBS) & (size > MOST_STUB), F.concat(sized, F.lit("\n[content too large for inline indexing]")))
        .when(ext.isin(*STUBS), F.concat(kind, F.lit(": "), name, F.lit("\nPath: "), path, F.lit("\nURL: "), F.coalesce(url, F.lit(""))))
        .when(ext.isin(*IMAGES), F.concat(F.lit("Image"), F.substring(sized, 5, 1 << 30)))
        .when(ext.isin(*ARCHIVES), F.concat(F.lit("Archive"), F.substring(sized, 5, 1 << 30)))
        .otherwise(sized)
    )


def documents(files: DataFrame) -> DataFrame:
    """One document per file."""
    meta = F.to_json(F.struct(F.col("source_id").alias("path"), "ext", "size", F.regexp_replace("source_id", "/?[^/]*$", "").alias("dir")))
    body = content(F.col("name"), F.col("source_id"), F.col("ext"), F.col("size"), F.col("content"))
    return files.select(F.lit("filesystem").alias("source_type"), "source_id", F.col("name").alias("title"), body.alias("content"), meta.alias("metadata"), F.col("mtime").alias("collected_at"))


def latest_by_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """The greatest name, then the newest."""
    return files.filter(F.col("name").startswith(prefix)).agg(F.max_by("source_id", F.struct("name", "mtime")).alias("source_id"))


def upload_id(name: Column, data: Column) -> Column:
    """S27."""
    return F.concat(F.lit("upload:"), F.substring(F.sha2(F.concat(name.cast("binary"), data), 256), 1, 12))


def audio_kind(data: Column) -> Column:
    """Container of a recording by its first bytes, or null."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("52494646") & head.endswith("57415645"), "wav").when(head.startswith("494433") | head.rlike("^FF[EF]"), "mp3").when(F.substring(head, 9, 8) == "66747970", "m4a").when(head.startswith("664C6143"), "flac").when(head.startswith("4F676753"), "ogg")


def audio_fault(name: Column, data: Column) -> Column:
    """why a recording can't be one, or null: too short, or an m4a or mp4 file without its mark."""
    short = F.coalesce(F.octet_length(data), F.lit(0)) < 8
    return F.when(short, "too short").when(F.lower(name).rlike(r"\.(m4a|mp4)$") & (F.hex(F.substring(data, 5, 4)) != "66747970"), "no m4a file")


#: File names that tell when a recording was made.
FULL_TIME = r"_(\d{14})(?:-\d+)?(?:\.\w+)?$"
SHORT_TIME = r"_(\d{6}_\d{6})(?:\.\w+)?$"


def recorded_at(name: Column, mtime: Column) -> Column:
    """The time at the end of a file name, with four or two digits of a year, else the modification time."""
    read = lambda text, layout: F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(layout))
    full = F.when(F.regexp_extract(name, FULL_TIME, 1).rlike("^20|^2100"), read(F.regexp_extract(name, FULL_TIME, 1), "yyyyMMddHHmmss"))
    short = read(F.concat(F.lit("20"), F.nullif(F.regexp_replace(F.regexp_extract(name, SHORT_TIME, 1), "_", ""), F.lit(""))), "yyyyMMddHHmmss")
    return F.coalesce(full, short, mtime)
