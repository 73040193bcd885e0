"""Question analysis over conversation turns and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import questions as Q
from ..functions.text import match_key
from ..scale import table, widen
from . import sqltext as S
from .registry import query
from .text import documents

_KEYED = f"k AS (SELECT conv_id, turn, role, text, {S.key('text')} AS key FROM conversations)"


def turns(spark, folder):
    """Every conversation turn as a question."""
    return widen(table(spark, folder, "conversations"))


@query(
    "language_guess",
    f"""WITH d AS (SELECT doc_id, text, {S.key('text')} AS key FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(lower(text), '[{V.VIETNAMESE_LETTERS}]') THEN 'vi'
        WHEN {' OR '.join(f"contains(' ' || key || ' ', ' {t} ')" for t in V.VIETNAMESE_WORDS)} THEN 'vi' ELSE 'en' END AS language FROM d""",
)
def language_guess(spark, folder):
    """Q03."""
    return documents(spark, folder).select("doc_id", Q.language(F.col("text")).alias("language"))


def _first(pairs, default, fn):
    return "CASE " + " ".join(f"WHEN {fn('key', terms)} THEN '{name}'" for name, terms in pairs) + f" ELSE '{default}' END"


@query(
    "question_families",
    f"""WITH {_KEYED} SELECT conv_id, turn, {_first(V.QUESTION_FAMILIES, 'document_open', S.anyof)} AS family,
        {_first(V.OPERATION_TERMS, 'unknown', S.anyof)} AS operation FROM k""",
)
def question_families(spark, folder):
    """Q15, G01."""
    k = turns(spark, folder).select("conv_id", "turn", match_key(F.col("text")).alias("key"))
    return k.select("conv_id", "turn", Q.question_family(F.col("key")).alias("family"), Q.operation(F.col("key")).alias("operation"))


_STOP = "', '".join(V.STOPWORDS)


@query(
    "question_profiles",
    f"""WITH {_KEYED}, p AS (SELECT *, {S.word('key', V.COMPUTATION_TERMS)} AS computes, {S.word('key', V.MULTI_SOURCE_TERMS)} AS several FROM k),
    q AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '["“”'']([^"“”'']+)["“”'']', 1), lambda x: trim(x)), lambda x: x <> '') AS quoted,
        list_filter({S.toks('text')}, lambda t: length(t) >= 3 AND NOT list_contains(['{_STOP}'], t)) AS plain FROM p),
    o AS (SELECT conv_id, turn, t, min(pos) AS pos FROM (SELECT conv_id, turn, unnest(list_concat(quoted, plain)) AS t, generate_subscripts(list_concat(quoted, plain), 1) AS pos FROM q) GROUP BY ALL),
    w AS (SELECT conv_id, turn, string_agg(t, '|' ORDER BY pos) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM o) GROUP BY ALL)
    SELECT conv_id, turn, computes AS requires_computation, several AS needs_multiple_sources, coalesce(keywords, '') AS keywords,
        CASE WHEN {S.word('key', V.IMAGE_WORDS)} THEN 'image' WHEN {S.word('key', V.AUDIO_WORDS)} THEN 'audio'
             WHEN computes OR {S.word('key', V.TABLE_WORDS)} THEN 'table' WHEN several THEN 'cross_file' ELSE 'auto' END AS modality_hint,
        regexp_matches(key, '^(did|do|does|is|are|was|were)([^a-z0-9_]|$)') OR contains(key, 'yes/no') AS binary
    FROM q LEFT JOIN w USING (conv_id, turn)""",
)
def question_profiles(spark, folder):
    """Q01, Q02, Q05-Q08, X10, U04."""
    t = turns(spark, folder).select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.lit("exact_match").alias("answer_type"))
    p = Q.profile(t)
    return p.select(
        "qid.conv_id", "qid.turn", "requires_computation", "needs_multiple_sources", F.array_join("keywords", "|").alias("keywords"), "modality_hint",
        F.coalesce(F.try_element_at("format_instructions", F.lit("binary")) == "true", F.lit(False)).alias("binary"),
    )


@query(
    "question_profiles_earlier",
    f"""WITH {_KEYED}, p AS (SELECT *, {S.anyof('key', V.COMPUTATION_SUBSTRINGS)} AS computes, {S.anyof('key', V.MULTI_SOURCE_SUBSTRINGS)} AS several FROM k)
    SELECT conv_id, turn, computes AS requires_computation, several AS needs_multiple_sources,
        CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN {S.anyof('key', V.VIETNAMESE_SUBSTRINGS)} OR regexp_matches(lower(text), '[{V.VIETNAMESE_LETTERS}]') THEN 'vi' ELSE 'en' END AS language,
        CASE WHEN {S.anyof('key', V.IMAGE_SUBSTRINGS)} THEN 'image' WHEN {S.anyof('key', V.AUDIO_SUBSTRINGS)} THEN 'audio' WHEN {S.anyof('key', V.DOCUMENT_SUBSTRINGS)} THEN 'document'
             WHEN computes OR {S.anyof('key', V.TABLE_SUBSTRINGS)} THEN 'table' WHEN several THEN 'cross_file' ELSE 'document' END AS modality_hint FROM p""",
)
def question_profiles_earlier(spark, folder):
    """The earlier analyser tests substrings."""
    t = turns(spark, folder).select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.lit("").alias("answer_type"))
    return Q.profile(t, "earlier").select("qid.conv_id", "qid.turn", "requires_computation", "needs_multiple_sources", "language", "modality_hint")


@query(
    "file_hints",
    """WITH q AS (SELECT page_id, 'Open "' || regexp_extract(url, '[^/]+$') || '.csv" and reports/' || page_id || '.txt or site' || page_id || '/* please' AS question FROM pages)
    SELECT page_id, 'reports/' || page_id || '.txt' AS last_hint, 'site' || page_id || '/*' AS wildcard, 'table' AS modality_hint FROM q""",
)
def file_hints(spark, folder):
    """Q04, Q06 on questions composed from page addresses."""
    name = F.regexp_extract("url", "[^/]+$", 0)
    pid = F.col("page_id").cast("string")
    q = table(spark, folder, "pages").select(
        F.col("page_id").alias("qid"), F.lit("").alias("answer_type"),
        F.concat(F.lit('Open "'), name, F.lit('.csv" and reports/'), pid, F.lit(".txt or site"), pid, F.lit("/* please")).alias("question"),
    )
    p = Q.profile(q)
    reports = F.filter("explicit_file_hints", lambda h: F.startswith(h, F.lit("reports/")))
    return p.select(F.col("qid").alias("page_id"), F.get(reports, F.lit(0)).alias("last_hint"), F.get("wildcard_patterns", F.lit(0)).alias("wildcard"), "modality_hint")


@query(
    "solver_routes",
    f"""WITH {_KEYED}, m AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS has_table, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 AS has_document FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, CASE WHEN contains(key, 'sql') THEN 'sql_calculation' WHEN has_table AND {S.anyof('key', V.CALCULATION_TERMS)} THEN 'tabular_calculation'
        WHEN has_document THEN 'document_qa' ELSE 'open_qa' END AS route FROM k JOIN m USING (conv_id)""",
)
def solver_routes(spark, folder):
    """Q14: routed by the modalities of the candidates, here derived from the roles of the conversation."""
    rows = turns(spark, folder)
    kinds = F.when(F.col("role") == "system", F.lit("table")).when(F.col("role") == "user", F.lit("document")).otherwise(F.lit("none"))
    per = rows.groupBy("conv_id").agg(F.collect_set(kinds).alias("modalities"))  # at most three values
    k = rows.select("conv_id", "turn", match_key(F.col("text")).alias("key")).join(per, "conv_id")
    return k.select("conv_id", "turn", Q.solver_route(F.col("key"), F.array().cast("array<string>"), F.col("modalities")).alias("route"))
