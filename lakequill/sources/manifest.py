"""The file catalogue as a table: one row per file, with text as ``content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import preview


def catalogue(files: DataFrame, path: Column, content: Column, size: Column | None = None) -> DataFrame:
    """Manifest columns for files whose text is already extracted."""
    named = files.select(
        P.slashes(path).alias("relative_path"), F.coalesce(content, F.lit("")).alias("content"),
        (F.octet_length(content) if size is None else size).cast("bigint").alias("size_bytes"),
    )
    return named.select(
        P.file_id(F.col("relative_path")).alias("file_id"),
        P.basename(F.col("relative_path")).alias("filename"),
        "relative_path",
        P.extension(F.col("relative_path")).alias("extension"),
        P.modality(F.col("relative_path")).alias("modality"),
        P.mime_type(F.col("relative_path")).alias("mime_type"),
        "size_bytes",
        preview(F.col("content"), 1200).alias("text_preview"),
        "content",
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The document table seen as a lake of text files ``source/doc_id.txt``."""
    return catalogue(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
