"""The lake itself: manifest, HTML text, parse audit, retries, evidence paths, tables in files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths as P
from ..functions.text import collapse_spaces
from ..operators import answering as O
from ..scale import table, widen
from ..sources import sinks, tabular
from ..sources.documents import html_text as visible_text
from ..sources.manifest import documents_as_files
from . import sqltext as S
from .registry import query
from .text import documents

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
             ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))


def _html_sql():
    out = "html"
    for pattern in ("(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>", "(?s)<!--.*?-->", "<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for entity, plain in _ENTITIES:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_HTML = _html_sql()


@query("html_text_builtin", f"SELECT page_id, md5({_HTML}) AS text_md5, CAST(length({_HTML}) AS INT) AS n_chars FROM pages")
def html_text_builtin(spark, folder):
    """S20 with built-in functions only."""
    t = F.regexp_replace("html", "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, plain in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    pages = widen(table(spark, folder, "pages")).select("page_id", collapse_spaces(t).alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("html_text", f"SELECT page_id, md5({_HTML}) AS text_md5 FROM pages")
def html_text(spark, folder):
    """The reader's own parser, every entity and nested hidden element."""

    @F.pandas_udf(StringType())
    def read(html: pd.Series) -> pd.Series:
        return html.map(visible_text)

    return widen(table(spark, folder, "pages")).select("page_id", F.md5(read("html")).alias("text_md5"))


_FILES = f"""m AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, text FROM documents)"""


@query(
    "manifest_rows",
    f"""WITH {_FILES} SELECT substr(sha1(lower(path)), 1, 16) AS file_id, doc_id || '.txt' AS filename, path AS relative_path, '.txt' AS extension, 'document' AS modality,
        'text/plain' AS mime_type, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, substr(sha1(path), 1, 16) || '_' || doc_id || '.txt' AS cache_name FROM m""",
)
def manifest_rows(spark, folder):
    """S02-S04, S42, X06, X08, X09."""
    m = documents_as_files(documents(spark, folder)).withColumn("cache_name", P.cache_name(F.col("relative_path")))
    return m.select("file_id", "filename", "relative_path", "extension", "modality", "mime_type", "size_bytes", "cache_name")


@query(
    "page_modalities",
    """WITH e AS (SELECT lower(regexp_extract(url, '[^/.](\\.[^./]+)$', 1)) AS ext FROM pages)
    SELECT CASE WHEN ext IN ('.csv', '.xlsx', '.xls', '.sql') THEN 'table' WHEN ext IN ('.pdf', '.docx', '.pptx', '.ppt', '.txt', '.md', '.html', '.htm', '.epub') THEN 'document' ELSE 'unknown' END AS modality,
    count(*) AS files FROM e GROUP BY ALL""",
)
def page_modalities(spark, folder):
    """S04, S06."""
    return table(spark, folder, "pages").groupBy(P.modality(F.col("url")).alias("modality")).agg(F.count("*").alias("files"))




@query(
    "lake_chunks",
    f"""WITH {_FILES}, f AS (SELECT substr(sha1(lower(path)), 1, 16) AS file_id, path, doc_id || '.txt' AS name, text FROM m),
    s AS (SELECT file_id, {S.squeeze(f"'Filename: ' || name || ' Path: ' || path || ' Modality: document ' || name || ' ' || path || ' ' || CASE WHEN length({S.squeeze('text')}) <= 1200 THEN {S.squeeze('text')} ELSE substr({S.squeeze('text')}, 1, 1197) || '...' END || ' ' || text")} AS s FROM f)
    SELECT file_id || '::' || i AS chunk_id, CAST(i AS INT) AS chunk_index, md5(substr(s, CAST(i AS INT) * 1950 + 1, 2200)) AS text_md5
    FROM (SELECT *, unnest(range({S.windows('length(s)', 2200, 250)})) AS i FROM s)""",
)
def lake_chunks(spark, folder):
    """Header, preview and whole text in overlapping windows."""
    from ..operators.chunking import lake_chunks as cut

    return cut(documents_as_files(documents(spark, folder))).select("chunk_id", "chunk_index", F.md5("text").alias("text_md5"))


def _statused(spark, folder):
    """Manifest with a status from the labels: toxic documents failed to parse, unlabelled ones were skipped."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    m = documents_as_files(documents(spark, folder)).withColumn("doc_id", F.regexp_extract("filename", "^([0-9]+)", 1).cast("bigint")).join(labels, "doc_id", "left")
    status = F.when(F.col("toxic").isNull(), F.lit("skipped")).when(F.col("toxic") == 1, F.lit("error")).otherwise(F.lit("ok"))
    return m.select("*", status.alias("status"), F.array().cast("array<string>").alias("columns"), F.lit(None).cast("double").alias("ocr_confidence"), F.lit("").alias("image_caption"))


_AUDIT = f"""a AS (SELECT d.doc_id, source || '/' || d.doc_id || '.txt' AS path, text, CASE WHEN toxic IS NULL THEN 'skipped' WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS status
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    x AS (SELECT *, length(text) AS chars, text AS t FROM a),
    y AS (SELECT *, 2 * len(regexp_extract_all(t, 'Ã.|Â.|Ä.|Å.|Æ.|áº|á»|â€|â€™|â€œ')) + len(regexp_extract_all(t, '[\\x{{80}}-\\x{{9f}}]')) + 3 * len(regexp_extract_all(t, chr(65533))) >= 2 AS moji FROM x),
    z AS (SELECT *, array_to_string(list_filter([CASE WHEN status = 'error' THEN 'parse_error' END, CASE WHEN status = 'skipped' THEN 'unsupported' END,
        CASE WHEN status = 'ok' AND chars < 30 THEN 'empty_text' END, CASE WHEN moji THEN 'mojibake' END], lambda f: f IS NOT NULL), ',') AS flags FROM y),
    v AS (SELECT *, CASE WHEN contains(flags, 'parse_error') OR contains(flags, 'empty_text') THEN 'error' WHEN flags <> '' THEN 'warn' ELSE 'ok' END AS severity FROM z)"""


@query("text_audit", f"WITH {_AUDIT} SELECT path AS relative_path, status, CAST(chars AS INT) AS text_chars, severity, flags FROM v")
def text_audit(spark, folder):
    """E05, E13, O10, X11."""
    return O.audit(_statused(spark, folder)).select("relative_path", "status", "text_chars", "severity", "flags")


@query(
    "audit_by_modality",
    f"""WITH {_AUDIT} SELECT 'document' AS modality, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (severity = 'ok') AS ok, count(*) FILTER (severity = 'warn') AS warn,
    count(*) FILTER (severity = 'error') AS error FROM v""",
)
def audit_by_modality(spark, folder):
    """G22."""
    return O.audit_by_modality(O.audit(_statused(spark, folder)))


@query(
    "resumable_retry",
    f"""WITH {_AUDIT} SELECT path AS relative_path, CASE WHEN status = 'error' THEN 'ok' ELSE status END AS status FROM v""",
)
def resumable_retry(spark, folder):
    """Only failing rows are parsed again; the results replace them."""
    from ..sources.lake import parse_files

    m = _statused(spark, folder).select("file_id", "relative_path", "status", "content")
    failing = m.filter("status = 'error'")
    raw = failing.select("file_id", F.col("relative_path").alias("path"), F.encode("content", "UTF-8").alias("content"))
    fresh = parse_files(raw).select("file_id", F.col("path").alias("relative_path"), F.col("parsed.status").alias("status"))
    kept = m.join(fresh.select("file_id"), "file_id", "left_anti").select("file_id", "relative_path", "status")
    return kept.unionByName(fresh).select("relative_path", "status")


@query("safe_paths")
def safe_paths(spark, folder):
    """ASCII-safe names, repeated names told apart (checked by brute force in the tests)."""
    return sinks.safe_paths(table(spark, folder, "pages").select(F.regexp_replace("url", "^https?://", "").alias("p")), "p")


@query(
    "rewritten_evidence",
    "SELECT doc_id || '.txt' AS evidence, 'safe/' || source || '/' || doc_id || '.txt' AS rewritten FROM documents",
)
def rewritten_evidence(spark, folder):
    """A bare file name finds the only path that ends in it."""
    files = documents_as_files(documents(spark, folder))
    mapping = files.select(F.col("relative_path").alias("original_path"), F.concat(F.lit("safe/"), F.col("relative_path")).alias("safe_path"))
    return sinks.rewrite_paths(files.select(F.col("filename").alias("evidence")), "evidence", mapping)


@query(
    "source_matches",
    f"""WITH {_FILES}, e AS (SELECT upper(doc_id || '.txt') AS expected FROM labels) SELECT path AS candidate, expected FROM m JOIN e ON lower(expected) = lower(doc_id || '.txt')""",
)
def source_matches(spark, folder):
    """Full path or base name, ignoring case, as equi-joins."""
    from ..operators.metrics import source_matches as match

    files = documents_as_files(documents(spark, folder)).select(F.col("relative_path").alias("candidate"))
    wanted = table(spark, folder, "labels").select(F.upper(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("expected"))
    return match(files, wanted, "candidate", "expected")


@query(
    "dump_tables",
    "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders",
)
def dump_tables(spark, folder):
    """Every order written as an INSERT statement, then read back out of the text."""
    o = widen(table(spark, folder, "orders"))
    values = F.concat(
        F.lit("INSERT INTO orders (k, s, p, t) VALUES ("), F.col("o_orderkey").cast("string"), F.lit(", '"), F.col("o_orderstatus"), F.lit("', "),
        F.col("o_totalprice").cast("string"), F.lit(", '"), F.col("o_orderpriority"), F.lit("');"),
    )
    cells = tabular.dump_cells(o.select(F.col("o_orderkey").cast("string").alias("path"), values.alias("content"))).filter("row_no > 0")
    c = F.col("cells")
    return cells.select(
        c[0].cast("bigint").alias("o_orderkey"), c[1].alias("o_orderstatus"), c[2].cast("double").alias("o_totalprice"), c[3].alias("o_orderpriority")
    )


@query("csv_tables", "SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS rows_read, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey")
def csv_tables(spark, folder):
    """Customers written as CSV text with a title line per 1000 keys, then parsed back into Spark rows."""
    c = table(spark, folder, "customer")
    part = F.floor(F.col("c_custkey") / 1000)
    # At most 1000 customers per file by construction.
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string")))), "\n")
    files = c.groupBy(part.alias("p")).agg(F.encode(F.concat(F.lit("Customer list\nkey,nation,balance\n"), body), "UTF-8").alias("content"))
    cells = tabular.table_cells(files.select(F.concat(F.lit("lake/part"), F.col("p").cast("string"), F.lit(".csv")).alias("path"), "content"))
    rows = cells.filter("row_no > 0").select(F.col("cells")[1].cast("int").alias("nation"), F.col("cells")[2].cast("double").alias("b"))
    return rows.groupBy("nation").agg(F.count("*").alias("rows_read"), F.round(F.sum("b"), 2).alias("balance"))
