"""Scanning a folder of mixed files into a manifest, with faults kept as rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.text import preview
from ..session import ship_package
from . import documents as D
from .tabular import sql_table_names, tables_in, text_of_tables

# A pluggable reader takes (path, bytes) and returns text.
Reader = Callable[[str, bytes], str]

_FIELDS = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("sheet_names", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
_ROWS = T.ArrayType(T.ArrayType(T.StringType()))
_TABLES = T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("rows", _ROWS)]))
PARSED = T.StructType([*_FIELDS.fields, T.StructField("tables", _TABLES)])

_MISSING = {
    ".pdf": "no PDF reader is registered",
    ".ppt": "legacy slides need a conversion reader",
    ".xls": "no reader for the legacy workbook format is registered",
}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root``: path, length, modificationTime, content.

    The content is a column like any other: a query that does not ask for it
    lists the files without opening them.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system itself writes it, with scheme and host (``s3a://lake/data``, ``file:/srv/lake``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def below(path, root: str):
    """``path`` relative to a qualified root; slashes after a scheme may be one or three."""
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1:/")
    return P.relative_to(plain(path), re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/*", r"\1:/", root).rstrip("/"))


def _read(path: str, data: bytes, readers: dict[str, Reader]) -> dict:
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
    out = {"columns": [], "sheet_names": [], "metadata": {}, "tables": None}
    if ext in readers:
        return out | {"content": readers[ext](path, data)}
    if ext in (".txt", ".md"):
        return out | {"content": D.decode(data)}
    if ext in (".html", ".htm"):
        return out | {"content": D.html_text(D.decode(data))}
    if ext in (".csv", ".xlsx"):
        return out | {"content": "", "tables": tables_in(path, data)}
    if ext == ".sql":
        text = D.decode(data)
        return out | {"content": text, "metadata": {"table_names": ",".join(sql_table_names(text))}}
    if ext == ".docx":
        return out | {"content": D.docx_text(data)}
    if ext == ".pptx":
        content, slides = D.pptx_text(data)
        return out | {"content": content, "metadata": {"slide_count": str(slides)}}
    if ext == ".epub":
        content, title = D.epub_text(data)
        return out | {"content": content, "metadata": {"title": title or ""}}
    if ext in _MISSING:
        raise RuntimeError(_MISSING[ext])
    if ext in (".jpg", ".jpeg", ".png", ".webp", ".m4a", ".mp3", ".wav", ".mp4"):
        raise RuntimeError(f"no reader is registered for {ext}")
    return out | {"content": "", "status": "skipped", "error_message": "Unsupported file type."}


def parse_files(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Add ``parsed`` to (path, content); one bad file gives one error row."""
    ship_package(files.sparkSession)
    registered = dict(readers or {})

    @F.pandas_udf(PARSED)
    def parse(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, data in zip(path, content):
            try:
                row = {"status": "ok", "error_message": None} | _read(p, bytes(data), registered)
            except Exception as exc:
                row = {"content": "", "columns": [], "sheet_names": [], "metadata": {}, "tables": None, "status": "error", "error_message": str(exc) or type(exc).__name__}
            rows.append(row)
        return pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])

    read = files.withColumn("parsed", parse("path", "content"))
    # what a table holds is found by expressions over its rows, every row of it
    read = read.withColumn("_shaped", F.when(F.col("parsed.tables").isNotNull(), text_of_tables(F.col("parsed.tables"), F.lower("path").endswith(".csv"))))
    fields = [
        (F.coalesce(F.col("_shaped")[f.name], F.col("parsed")[f.name]) if f.name in ("content", "columns", "sheet_names") else F.col("parsed")[f.name]).alias(f.name)
        for f in _FIELDS.fields
    ]
    return read.withColumn("parsed", F.struct(*fields)).drop("_shaped")


def build_manifest(spark: SparkSession, root: str, readers: dict[str, Reader] | None = None, files: DataFrame | None = None) -> DataFrame:
    """The manifest with the full text as ``content``."""
    parsed = parse_files(scan(spark, root) if files is None else files, readers)
    clean = F.regexp_replace("path", "^file:/*", "/")
    relative = below(F.col("path"), qualified(spark, root))
    base = parsed.select(
        relative.alias("relative_path"), clean.alias("absolute_path"), F.col("length").alias("size_bytes"), "modificationTime", "parsed.*"
    )
    return base.select(
        P.file_id(F.col("relative_path")).alias("file_id"),
        P.basename(F.col("relative_path")).alias("filename"),
        "relative_path",
        "absolute_path",
        P.extension(F.col("relative_path")).alias("extension"),
        P.modality(F.col("relative_path")).alias("modality"),
        P.mime_type(F.col("relative_path")).alias("mime_type"),
        "size_bytes",
        "modificationTime",
        preview(F.col("content"), 1200).alias("text_preview"),
        F.array_sort(F.array_distinct("columns")).alias("columns"),
        "sheet_names",
        "metadata",
        P.cache_name(F.col("relative_path")).alias("cache_name"),
        F.lit(None).cast("string").alias("image_caption"),
        F.lit(None).cast("string").alias("image_description"),
        F.lit(None).cast("double").alias("ocr_confidence"),
        "status",
        "error_message",
        "content",
    )


def load_or_build_manifest(spark: SparkSession, root: str, store: str, rebuild: bool = False, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Read the stored manifest, re-rooted to ``root``; build and store it when absent."""
    from .sinks import exists

    if rebuild or not exists(spark, store):
        build_manifest(spark, root, readers).write.mode("overwrite").parquet(store)
    stored = spark.read.parquet(store)
    return stored.withColumn("absolute_path", F.concat_ws("/", F.lit(root.rstrip("/")), "relative_path"))


def retry_failed(
    manifest: DataFrame, files: DataFrame, root: str, statuses: tuple[str, ...] = ("error",), extensions: tuple[str, ...] | None = None,
    readers: dict[str, Reader] | None = None,
) -> DataFrame:
    """Parse only the rows with a failing status again and put the results in their place."""
    failing = F.col("status").isin(*statuses)
    if extensions:
        failing = failing & F.col("extension").isin(*extensions)
    relative = below(F.col("path"), qualified(manifest.sparkSession, root))
    again = files.join(manifest.filter(failing).select(F.col("relative_path").alias("_rel")), relative == F.col("_rel"), "left_semi")
    fresh = build_manifest(manifest.sparkSession, root, readers, files=again)
    kept = manifest.join(fresh.select("file_id"), "file_id", "left_anti")
    return kept.unionByName(fresh)
