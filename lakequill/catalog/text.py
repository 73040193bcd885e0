"""Text keys, tokens, chunks and sentences over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators.bm25 import document_frequencies
from ..operators.ranking import top_k
from ..scale import table, widen
from . import sqltext as S
from .registry import query

SQUEEZED = S.squeeze("text")


def documents(spark, folder):
    return widen(table(spark, folder, "documents"))


@query(
    "norm_text",
    f"""SELECT doc_id, md5({S.key('text')}) AS key_md5, CAST(length({S.key('text')}) AS INT) AS key_chars,
        md5({SQUEEZED}) AS squeezed_md5, md5(replace({S.key('text')}, ' ', '')) AS compact_md5 FROM documents""",
)
def norm_text(spark, folder):
    """Collapsed text, match key, compact key."""
    keyed = documents(spark, folder).select("doc_id", T.match_key(F.col("text")).alias("k"), T.collapse_spaces(F.col("text")).alias("s"))
    return keyed.select(
        "doc_id", F.md5("k").alias("key_md5"), F.length("k").alias("key_chars"), F.md5("s").alias("squeezed_md5"),
        F.md5(F.replace("k", F.lit(" "), F.lit(""))).alias("compact_md5"),
    )


@query(
    "tokenize_docs",
    f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct
        FROM (SELECT doc_id, {S.toks('text')} AS t FROM documents)""",
)
def tokenize_docs(spark, folder):
    """X07."""
    t = documents(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(
    "term_df_top",
    f"""WITH p AS (SELECT doc_id, unnest({S.toks('text')}) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term ORDER BY df DESC, term LIMIT 100""",
)
def term_df_top(spark, folder):
    """Most widespread terms."""
    freq = document_frequencies(documents(spark, folder), "doc_id", "text")
    return freq.select("term", "df", "cf").orderBy(F.desc("df"), "term").limit(100)


def _chunk_sql(size, overlap, body):
    step = size - overlap
    return f"""SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(substr(s, i * {step} + 1, {size})) AS text_md5,
        CAST(least(length(s) - i * {step}, {size}) AS INT) AS char_count, CAST(i * {step} AS INT) AS start_char,
        CAST(least(i * {step} + {size}, length(s)) AS INT) AS end_char
        FROM (SELECT doc_id, s, unnest(range({S.windows('length(s)', size, overlap)})) AS i FROM (SELECT doc_id, {body} AS s FROM documents))"""


@query("fixed_chunks", _chunk_sql(2200, 250, SQUEEZED))
def fixed_chunks(spark, folder):
    """Overlapping windows over collapsed text."""
    cut = C.fixed_chunks(documents(spark, folder), "text", ["doc_id"], 2200, 250)
    return cut.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "char_count", "start_char", "end_char")


@query("fixed_spans", _chunk_sql(1200, 0, "text"))
def fixed_spans(spark, folder):
    """Plain windows over the text as it is."""
    cut = C.fixed_chunks(documents(spark, folder), "text", ["doc_id"], 1200, 0, compact=False)
    return cut.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "char_count", "start_char", "end_char")


_LENGTHS = f"""WITH d AS (SELECT doc_id, {SQUEEZED} AS s FROM documents),
    a AS (SELECT 'fixed_2200' AS method, doc_id, unnest(range({S.windows('length(s)', 2200, 250)})) AS i, length(s) AS n, 1950 AS step, 2200 AS size FROM d),
    b AS (SELECT 'fixed_1200' AS method, doc_id, unnest(range({S.windows('length(s)', 1200, 0)})) AS i, length(s) AS n, 1200 AS step, 1200 AS size FROM d),
    c AS (SELECT method, doc_id, least(n - i * step, size) AS chars FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""


@query(
    "chunk_stats",
    _LENGTHS + """ SELECT method, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(avg(chars), 2) AS mean_chars,
        round(quantile_cont(CAST(chars AS DOUBLE), 0.95), 2) AS p95_chars, CAST(max(chars) AS INT) AS max_chars FROM c GROUP BY method""",
)
def chunk_stats(spark, folder):
    """G19 lengths, U05.  A length is at most the window size, so the percentile's value map is bounded."""
    docs = documents(spark, folder)
    parts = [
        C.fixed_chunks(docs, "text", ["doc_id"], size, lap).select(F.lit(f"fixed_{size}").alias("method"), "doc_id", "char_count")
        for size, lap in ((2200, 250), (1200, 0))
    ]
    per_doc = parts[0].unionByName(parts[1])
    return per_doc.groupBy("method").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.round(F.avg("char_count"), 2).alias("mean_chars"),
        F.round(F.percentile("char_count", F.lit(0.95)), 2).alias("p95_chars"), F.max("char_count").alias("max_chars"),
    )


@query(
    "sentence_split",
    f"""SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS max_len,
        md5(array_to_string(s, chr(10))) AS text_md5 FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)""",
)
def sentence_split(spark, folder):
    """C05."""
    s = documents(spark, folder).select("doc_id", C.sentences(F.col("text")).alias("s"))
    return s.select(
        "doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("max_len"),
        F.md5(F.array_join("s", "\n")).alias("text_md5"),
    )


@query(
    "clean_structure",
    r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g') AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), ' +$', '') AS t FROM a)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM b""",
)
def clean_structure(spark, folder):
    """S37."""
    return documents(spark, folder).select("doc_id", F.md5(T.clean_structure(F.col("text"))).alias("text_md5"))


_MOJI = "Ã.|Â.|Ä.|Å.|Æ.|áº|á»|â€|â€™|â€œ"


@query(
    "mojibake_score",
    f"""SELECT doc_id, CAST(2 * len(regexp_extract_all(text, '{_MOJI}')) + len(regexp_extract_all(text, '[\\x{{80}}-\\x{{9f}}]'))
        + 3 * len(regexp_extract_all(text, chr(65533))) AS INT) AS score FROM documents""",
)
def mojibake_score(spark, folder):
    """X11, X12."""
    return documents(spark, folder).select("doc_id", T.mojibake_score(F.col("text")).cast("int").alias("score"))


@query(
    "previews",
    f"""SELECT doc_id, CASE WHEN length(s) <= 1200 THEN s ELSE substr(s, 1, 1197) || '...' END AS preview FROM (SELECT doc_id, {SQUEEZED} AS s FROM documents)""",
)
def previews(spark, folder):
    """X05, S02 preview."""
    return documents(spark, folder).select("doc_id", T.preview(F.col("text"), 1200).alias("preview"))


@query(
    "dedupe_keep_max",
    f"""WITH k AS (SELECT doc_id, md5({S.key('text')}) AS key, n_chars FROM documents)
        SELECT key, count(*) AS copies, max(n_chars) AS n_chars, min(doc_id) FILTER (n_chars = m) AS doc_id
        FROM (SELECT *, max(n_chars) OVER (PARTITION BY key) AS m FROM k) GROUP BY key""",
)
def dedupe_keep_max(spark, folder):
    """One row per key, the best one kept.  Partial aggregates make a hot key cheap."""
    keyed = documents(spark, folder).select("doc_id", F.md5(T.match_key(F.col("text"))).alias("key"), "n_chars")
    best = F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg"))).alias("_best")
    grouped = keyed.groupBy("key").agg(F.count("*").alias("copies"), best)
    return grouped.select("key", "copies", F.col("_best.n_chars").alias("n_chars"), (-F.col("_best.neg")).alias("doc_id"))


@query("mojibake_repaired", "SELECT doc_id, md5(text) AS repaired FROM documents WHERE text IS NOT NULL")
def mojibake_repaired(spark, folder):
    """Texts whose UTF-8 bytes were read as Latin-1 come back as they were; plain texts stay."""
    texts = documents(spark, folder).filter("text IS NOT NULL")
    broken = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return texts.select("doc_id", F.md5(T.repair_mojibake(broken)).alias("repaired"))
