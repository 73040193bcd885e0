"""Answer formatting, extraction, context budgets, validation and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import match_key
from ..operators import answering as O
from ..operators.tables import value_counts
from ..scale import settle, table, widen
from ..sources.manifest import documents_as_files
from . import sqltext as S
from .registry import query
from .text import documents

@query(
    "format_answers",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'No' WHEN 'error' THEN 'B' WHEN 'purchase' THEN printf('%.2f', value)
        ELSE CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS answer FROM events""",
)
def format_answers(spark, folder):
    """yes/no, choice, decimals and integers composed from events."""
    e = widen(table(spark, folder, "events"))
    kind, text = F.col("event_type"), F.col("value").cast("string")
    raw = (
        F.when(kind == "click", F.lit(" yes. ")).when(kind == "view", F.lit("**No**")).when(kind == "error", F.lit("The answer is B"))
        .when(kind == "purchase", F.concat(F.lit("value: "), text)).otherwise(F.concat(F.lit("["), F.floor("value").cast("string"), F.lit("]()")))
    )
    question = (
        F.when(kind == "error", F.lit("Which?\nA. one\nB. two")).when(kind == "purchase", F.lit("What is the mean, rounded to 2 decimal places?"))
        .otherwise(F.lit("How many rows are there?"))
    )
    rows = e.select("event_id", raw.alias("answer"), question.alias("question"), F.lit("exact_match").alias("answer_type"))
    return A.normalize_answers(rows).select("event_id", "answer")


@query(
    "choose_option",
    """SELECT event_id, CASE WHEN abs(10 - value) <= abs(20 - value) AND abs(10 - value) <= abs(40 - value) THEN 'A'
        WHEN abs(20 - value) <= abs(40 - value) THEN 'B' ELSE 'C' END AS choice FROM events""",
)
def choose_option(spark, folder):
    """X23-X25."""
    e = table(spark, folder, "events")
    question = F.lit("Pick the closest.\nA. about 10\nB) 20 units\nC. 40")
    return e.select("event_id", A.choose_option(question, F.col("value").cast("string")).alias("choice"))


@query(
    "value_formats",
    "SELECT event_id, printf('%.1f', value) AS one, printf('%.0f', value) AS none, CASE WHEN value = trunc(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.10g', value) END AS free FROM events",
)
def value_formats(spark, folder):
    """X20."""
    e = widen(table(spark, folder, "events"))
    v = F.col("value")
    return e.select(
        "event_id", A.format_number(v, F.lit(1.0)).alias("one"), A.format_number(v, F.lit(0.0)).alias("none"),
        A.format_number(v, F.lit(None).cast("double")).alias("free"),
    )


@query(
    "evidence_lists",
    """SELECT page_id, CAST(3 AS INT) AS from_json_text, CAST(2 AS INT) AS from_bare_list, '["' || url || '","p' || page_id || '"]' AS as_json FROM pages""",
)
def evidence_lists(spark, folder):
    """List cells as JSON or bare text, evidence as JSON."""
    url, pid = F.col("url"), F.concat(F.lit("p"), F.col("page_id").cast("string"))
    as_json = A.evidence_json(F.array(url, pid, url))
    cells = table(spark, folder, "pages").select(
        "page_id", F.to_json(F.array(url, pid, F.lit("x"))).alias("a"), F.concat(F.lit("['"), url, F.lit("', '"), pid, F.lit("']")).alias("b"), as_json.alias("as_json")
    )
    return cells.select(
        "page_id", F.size(A.text_list(F.col("a"))).alias("from_json_text"), F.size(A.text_list(F.col("b"))).alias("from_bare_list"), "as_json"
    )


@query(
    "extractive_sentence",
    f"""WITH p AS (SELECT u.conv_id, u.turn, u.text, a.text AS reply FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'),
    t AS (SELECT conv_id, turn, unnest(list_filter(string_split({S.key('text')}, ' '), lambda x: length(x) > 2)) AS token FROM p),
    x AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(reply, '([.!?])\\s+', '\\1' || chr(9246), 'g'), '\\n+', chr(9246), 'g'), chr(9246)) AS parts FROM p),
    s AS (SELECT conv_id, turn, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM x),
    h AS (SELECT s.conv_id, s.turn, pos, sentence, count(token) AS hits FROM s JOIN t ON t.conv_id = s.conv_id AND t.turn = s.turn AND contains({S.key('sentence')}, token) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, pos) AS n FROM h)
    SELECT p.conv_id, p.turn, CASE WHEN b.sentence IS NULL THEN 'Not enough data to answer.' WHEN length({S.squeeze('b.sentence')}) <= 600 THEN {S.squeeze('b.sentence')}
        ELSE substr({S.squeeze('b.sentence')}, 1, 597) || '...' END AS answer, coalesce(hits, 0) AS score FROM p LEFT JOIN b ON b.conv_id = p.conv_id AND b.turn = p.turn AND n = 1""",
)
def extractive_sentence(spark, folder):
    """User turns as questions, the next assistant turn as context (an equi-join on the turn number)."""
    c = widen(table(spark, folder, "conversations"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = settle(c.filter("role = 'user'").join(reply, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("qid"), "text", "reply"))
    blocks = pairs.select("qid", F.lit(0).alias("pos"), F.lit("reply").alias("relative_path"), F.col("reply").alias("text"))
    asked = pairs.select("qid", F.col("text").alias("question"), F.lit("llm_judge").alias("answer_type"))
    found = O.extract_sentences(blocks, asked)
    return found.select("qid.conv_id", "qid.turn", "answer", F.col("score").cast("bigint").alias("score"))


@query(
    "context_budget",
    """WITH n AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id, CAST(rank AS INT) AS rank, CAST(length(substr(text, 1, CAST(least(12000, greatest(65000 // least(n, CASE WHEN n > 8 THEN 24 ELSE 8 END), 1000)) AS BIGINT))) AS INT) AS chars
    FROM n WHERE rank <= CASE WHEN n > 8 THEN 24 ELSE 8 END""",
)
def context_budget(spark, folder):
    """Sources as questions, their documents as candidates; a top-k report of 24 files."""
    from ..operators.ranking import top_k

    docs = documents(spark, folder)
    named = docs.select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("relative_path"), "n_chars", "doc_id", F.lit("document").alias("modality"))
    total = named.groupBy("qid").agg(F.count("*").alias("_all"))
    ranked = top_k(named, ["qid"], [F.desc("n_chars"), F.asc("doc_id")], 25).join(total, "qid").withColumn("needs_multiple_sources", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("string").alias("relative_path"), F.col("text").alias("content"))
    blocks = O.context_blocks(ranked.select("qid", "relative_path", "modality", "rank", "needs_multiple_sources"), texts)
    return blocks.select(F.col("qid").alias("source"), F.col("relative_path").cast("bigint").alias("doc_id"), "rank", F.length("text").alias("chars"))


@query(
    "prompt_blocks",
    r"""SELECT doc_id, md5('[File: ' || source || '/' || doc_id || '.txt] (modality: document)' || chr(10) || CASE WHEN length(t) <= 9000 THEN t ELSE substr(t, 1, 8997) || '...' END) AS block_md5
    FROM (SELECT doc_id, source, trim(text) AS t FROM documents)""",
)
def prompt_blocks(spark, folder):
    """D03, D04."""
    files = documents_as_files(documents(spark, folder))
    block = O.prompt_block(F.col("relative_path"), F.col("modality"), F.col("content"))
    return files.select(F.regexp_extract("filename", "^([0-9]+)", 1).cast("bigint").alias("doc_id"), F.md5(block).alias("block_md5"))


def _judged(spark, folder):
    """Labels as ground truth; a length rule as the prediction."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, folder, "labels")
    questions = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("How many quality points has document "), F.col("doc_id").cast("string"), F.lit("?")).alias("question"),
        F.when(F.col("toxic") == 1, F.lit("llm_judge")).otherwise(F.lit("exact_match")).alias("answer_type"),
        F.coalesce(F.col("quality").cast("string"), F.lit("Not enough data to answer.")).alias("groundtruth"),
    )
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    answers = docs.filter("n_chars > 20").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("n_chars") < 200, F.lit("Not enough data to answer.")).when(F.col("n_chars") > 1000, F.lit("1")).otherwise(F.lit("0")).alias("answer"),
        F.when(F.col("n_chars") < 200, F.lit("[]")).otherwise(A.evidence_json(F.array(path, F.lit("other/x.png")))).alias("evidences"),
    )
    return questions, answers


_JUDGED = """q AS (SELECT d.doc_id AS id, source, n_chars, CASE WHEN toxic = 1 THEN 'llm_judge' ELSE 'exact_match' END AS answer_type, coalesce(CAST(quality AS VARCHAR), 'none') AS truth
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    j AS (SELECT *, CASE WHEN n_chars <= 20 THEN NULL WHEN n_chars < 200 THEN 'none' WHEN n_chars > 1000 THEN '1' ELSE '0' END AS answer FROM q),
    k AS (SELECT *, answer_type = 'exact_match' AND coalesce(answer, '') = truth AS correct, coalesce(answer, '') = 'none' AS pn, truth = 'none' AS tn, n_chars >= 200 AS has_evidence FROM j),
    b AS (SELECT *, CASE WHEN correct THEN 'exact_correct' WHEN pn AND NOT tn THEN 'not_enough_when_answer_exists' WHEN NOT pn AND tn THEN 'answered_when_should_not'
        WHEN NOT has_evidence THEN 'evidence_miss' WHEN answer_type = 'exact_match' THEN 'exact_value_mismatch' ELSE 'llm_judge_review' END AS bucket FROM k)"""


def _enriched(spark, folder):
    questions, answers = _judged(spark, folder)
    files = documents_as_files(documents(spark, folder)).select("relative_path", "modality", "filename")
    expected = files.select(
        F.regexp_extract("filename", "^([0-9]+)", 1).cast("bigint").alias("id"), F.array("relative_path").alias("expected_sources")
    )
    return O.enrich_errors(O.error_rows(questions, answers), files, expected)


@query(
    "left_join_error_analysis",
    f"""WITH {_JUDGED} SELECT id, bucket AS analysis_bucket, 'calculation' AS question_family,
        CASE WHEN has_evidence THEN 'document,unknown' ELSE '' END AS evidence_modalities, CAST(CASE WHEN has_evidence THEN 2 ELSE 0 END AS INT) AS evidence_count,
        CASE WHEN answer_type <> 'exact_match' THEN 'semantic_or_unjudged' WHEN correct THEN '' ELSE 'exact_mismatch' END AS error_type FROM b""",
)
def left_join_error_analysis(spark, folder):
    """J01, J15, J16, J24, E02-E04, X34."""
    return _enriched(spark, folder).select("id", "analysis_bucket", "question_family", "evidence_modalities", "evidence_count", "error_type")


@query(
    "error_summary",
    f"""WITH {_JUDGED} SELECT count(*) AS total_rows, count(*) FILTER (answer_type = 'exact_match') AS exact_total, count(*) FILTER (correct) AS exact_correct,
        round(count(*) FILTER (correct) / count(*) FILTER (answer_type = 'exact_match'), 4) AS exact_accuracy, count(*) FILTER (answer_type = 'llm_judge') AS llm_judge_total,
        count(*) FILTER (pn) AS not_enough_predictions, count(*) FILTER (NOT has_evidence) AS empty_evidence_rows FROM b""",
)
def error_summary(spark, folder):
    """G14, G21."""
    return O.error_summary(_enriched(spark, folder))


@query("error_buckets", f"WITH {_JUDGED} SELECT bucket AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM b), 2) AS percent FROM b GROUP BY bucket")
def error_buckets(spark, folder):
    """G13, E14."""
    return value_counts(_enriched(spark, folder), "analysis_bucket")


@query(
    "submission_violations",
    f"""WITH {_JUDGED}, s AS (SELECT * FROM b) SELECT CAST(id AS VARCHAR) AS id, 'empty answer' AS problem, '' AS detail FROM s WHERE n_chars <= 20
    UNION ALL SELECT CAST(id AS VARCHAR), 'evidences is not a JSON list', '' FROM s WHERE n_chars <= 20
    UNION ALL SELECT CAST(id AS VARCHAR), 'evidence file does not exist', 'other/x.png' FROM s WHERE has_evidence""",
)
def submission_violations(spark, folder):
    """K05, S44."""
    questions, answers = _judged(spark, folder)
    rows = questions.select("id").join(answers, "id", "left").select("id", "answer", "evidences")
    return O.submission_violations(rows, documents_as_files(documents(spark, folder)))


@query(
    "finalized_answers",
    f"""WITH {_JUDGED} SELECT id, CASE WHEN pn OR answer IS NULL THEN 'Not enough data to answer.' ELSE answer END AS answer,
        CASE WHEN has_evidence AND NOT pn AND answer IS NOT NULL THEN '["' || source || '/' || id || '.txt"]' ELSE '[]' END AS evidences FROM b WHERE n_chars > 20""",
)
def finalized_answers(spark, folder):
    """F13, F14, A09 shell: normalised answers, evidence limited to known paths."""
    questions, answers = _judged(spark, folder)
    parsed = answers.select(F.col("id").alias("qid"), "answer", F.from_json("evidences", "array<string>").alias("evidences"), F.lit("rule").alias("strategy"))
    asked = questions.select(F.col("id").alias("qid"), "question", "answer_type")
    return O.submission(O.finalize(parsed, asked, documents_as_files(documents(spark, folder))))
