"""Writers: run outputs, logs, reports, indexes, path-safe bundles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import safe_name, slashes
from ..functions.text import markdown_cell


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there: its success marker, on any file system Spark knows."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as exc:
        if _is_missing(exc):
            return False
        raise


def _is_missing(exc: AnalysisException) -> bool:
    """Nothing is there yet: no such path, or no file in it."""
    return exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; arrays and maps become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, or an empty table of the schema when nothing was written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as exc:
        if _is_missing(exc):
            return spark.createDataFrame([], schema)
        raise


def markdown_rows(rows: DataFrame) -> DataFrame:
    """One ``| a | b |`` line per row, in a column ``line``."""
    cells = [markdown_cell(F.col(c)) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(rows: DataFrame) -> str:
    """A report table as text, every row of it; for summaries of one row per run, method or bucket."""
    lines = [r["line"] for r in markdown_rows(rows).collect()]
    if not lines:
        return "_No rows._"
    head = "| " + " | ".join(c.replace("|", "\\|") for c in rows.columns) + " |"
    return "\n".join([head, "| " + " | ".join("---" for _ in rows.columns) + " |", *lines])


def log_run(record: DataFrame, folder: str, sort_columns: list[str]) -> str:
    """Append one run to the log and return the whole board, best first, as markdown."""
    write_json(record, folder, append=True)
    board = record.sparkSession.read.json(folder)
    return markdown_table(board.orderBy(*[F.desc_nulls_last(c) for c in sort_columns]))


def error_report(summary: DataFrame, tables: dict[str, DataFrame]) -> str:
    facts = summary.first().asDict()
    lines = ["# Error analysis", ""] + [f"- {k.replace('_', ' ')}: {v}" for k, v in facts.items()]
    for title, rows in tables.items():
        lines += ["", f"## {title}", "", markdown_table(rows)]
    return "\n".join(lines)


# ---- vector index ----


def fingerprint(chunks: DataFrame, model: str) -> Column:
    """Order-free fingerprint of ids, lengths, text and model, as one scalar.

    Row hashes are summed, so it is one partial aggregate over any number of
    rows; it also changes with content and model, which lengths alone miss.
    """
    row = F.xxhash64("chunk_id", F.length("text"), F.sha1("text"), F.lit(model))
    total = chunks.agg(F.sum(row.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return total.select(F.substring(F.sha1(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string"))), 1, 24)).scalar()


def save_index(vectors: DataFrame, chunks: DataFrame, folder: str, kind: str, model: str) -> None:
    """Vectors as parquet and one meta row."""
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = vectors.sparkSession
    meta = spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(model).alias("model_name"),
        chunks.agg(F.count("*").alias("n")).scalar().alias("num_chunks"), fingerprint(chunks, model).alias("fingerprint"),
    )
    meta.write.mode("overwrite").json(f"{folder}/meta")


def load_index(spark: SparkSession, chunks: DataFrame, folder: str, kind: str, model: str) -> DataFrame | None:
    """Stored vectors when kind, model and fingerprint still match, else None."""
    meta = read_json_or(spark, f"{folder}/meta", "kind string, model_name string, num_chunks bigint, fingerprint string")
    fits = meta.filter((F.col("kind") == kind) & (F.col("model_name") == model) & (F.col("fingerprint") == fingerprint(chunks, model)))
    return None if fits.isEmpty() else spark.read.parquet(f"{folder}/vectors")


def embedding_preview(vectors: DataFrame, dimensions: int = 12) -> DataFrame:
    from ..functions.vectors import l2_norm

    return vectors.select("chunk_id", F.slice("embedding", 1, dimensions).alias("preview"), l2_norm(F.col("embedding")).alias("l2_norm"))


# ---- path-safe bundles ----


def safe_paths(paths: DataFrame, path_col: str) -> DataFrame:
    """(original_path, safe_path): ASCII-safe parts; a repeated safe path gets a hash of the original name."""
    rows = paths.select(F.col(path_col).alias("original_path")).distinct()
    parts = F.transform(F.split("original_path", "/"), safe_name)
    rows = rows.withColumn("_safe", F.array_join(parts, "/"))
    # Only the smallest original keeps the plain name; an aggregate, so a hot name is no problem.
    owner = rows.groupBy("_safe").agg(F.min("original_path").alias("_owner"))
    digest = F.substring(F.sha2("original_path", 256), 1, 8)
    renamed = F.regexp_replace("_safe", "^(.*?)(\\.[^./]*)?$", "$1")
    suffix = F.regexp_extract("_safe", "(\\.[^./]*)$", 1)
    return rows.join(owner, "_safe").select(
        "original_path",
        F.when(F.col("original_path") == F.col("_owner"), F.col("_safe")).otherwise(F.concat(renamed, F.lit("_"), digest, suffix)).alias("safe_path"),
    )


def rewrite_paths(wanted: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Add ``rewritten``: exact original, else the only original that ends in the path, else the path itself.

    Every original is listed under each of its path suffixes, so the suffix
    test is an equi-join.
    """
    rows = wanted.select(slashes(F.col(col)).alias(col)).distinct()
    pieces = F.split("original_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    keyed = mapping.select("original_path", "safe_path", F.posexplode(tails).alias("_depth", col))
    hit = rows.join(keyed, col).groupBy(col).agg(
        F.max(F.when(F.col("_depth") == 0, F.col("safe_path"))).alias("_exact"),
        F.count_if(F.col("_depth") > 0).alias("_n"), F.max(F.when(F.col("_depth") > 0, F.col("safe_path"))).alias("_only"),
    )
    return rows.join(hit, col, "left").select(
        col, F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only")), F.col(col)).alias("rewritten")
    )
