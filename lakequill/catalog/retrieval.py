"""BM25, character-gram TF-IDF, fused file retrieval, direct hits, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.questions import profile
from ..functions.text import match_key, words
from ..operators import chunking as C
from ..operators import hybrid as H
from ..operators import bounded as B
from ..operators.containment import passages_in_texts
from ..operators.direct import direct_matches, glob_matches, named_in_question, path_names, quoted_groups
from ..operators.overlap import overlap_top_k
from ..operators.ranking import top_k
from ..scale import settle, store, table, widen
from ..sources.manifest import documents_as_files
from . import sqltext as S
from .registry import query
from .text import documents


def questions(spark, folder):
    """Benchmark passages as questions, whole."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("exact_match").alias("answer_type")
    )


def lake(spark, folder):
    """Manifest and chunk table; chunks are read several times, so they are built once."""
    manifest = documents_as_files(documents(spark, folder))
    return manifest, store(C.lake_chunks(manifest))


# ---------------------------------------------------------------- BM25


def _bm25_sql(docs, doc_id, doc_text, asks, qid, q_text, tag=""):
    """CTEs ending in bm<tag>(qid, id, score)."""
    return f"""
    t{tag} AS (SELECT {doc_id} AS id, {S.toks(doc_text)} AS t FROM {docs}),
    st{tag} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t{tag}),
    tf{tag} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM t{tag}) GROUP BY ALL),
    df{tag} AS (SELECT term, count(*) AS df FROM tf{tag} GROUP BY term),
    qt{tag} AS (SELECT qid, term, count(*) AS qtf FROM (SELECT {qid} AS qid, unnest({S.toks(q_text)}) AS term FROM {asks}) GROUP BY ALL),
    bm{tag} AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM qt{tag} JOIN tf{tag} USING (term) JOIN df{tag} USING (term), st{tag} GROUP BY qid, id)"""


@query(
    "bm25_topk",
    f"""WITH {_bm25_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
    r AS (SELECT qid AS item_id, id AS doc_id, round(score, 6) AS score FROM bm),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""",
)
def bm25_topk(spark, folder):
    """R01, J13, O02."""
    return _best_docs(spark, folder, B.TERMS)


def _best_docs(spark, folder, signal):
    built = document_index(spark, folder, signal)
    found = B.best_texts(built, 10).select("item_id", F.col("id").alias("doc_id"), F.round("v", 6).alias("score"))
    return top_k(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], 10)


def document_index(spark, folder, signal):
    """Whole documents and all passages, by one signal."""
    asks = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    return B.index(documents(spark, folder), asks, signals=[signal], id_col="doc_id", text_col="text", qid="item_id", query_col="question", stored=True)


# ---------------------------------------------------------------- character grams


def _grams_sql(name, source, id_expr, text_expr):
    return f"""
    {name}_w AS (SELECT id, ' ' || word || ' ' AS w, count(*) AS c FROM (SELECT {id_expr} AS id,
        unnest(string_split(regexp_replace(lower({text_expr}), '\\s+', ' ', 'g'), ' ')) AS word FROM {source}) WHERE word <> '' GROUP BY ALL),
    {name} AS (SELECT id, substr(w, CAST(i AS INT) + 1, n) AS gram, sum(c) AS tf FROM (SELECT id, w, c, n, unnest(range(length(w) - n + 1)) AS i
        FROM {name}_w, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n) GROUP BY ALL)"""


def _cosine_sql(source, id_expr, text_expr, asks, qid_expr, q_text, count_sql, tag="", with_query=False):
    """CTEs ending in cs<tag>(qid, id, score)."""
    head = f"""{_grams_sql('g' + tag, source, id_expr, text_expr)}, {_grams_sql('h' + tag, asks, qid_expr, q_text)},
    nn{tag} AS (SELECT count(*) AS n FROM {count_sql}), gf{tag} AS (SELECT gram, count(*) AS df FROM g{tag} GROUP BY gram)"""
    if not with_query:
        return head + f""",
    gi{tag} AS (SELECT gram, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM gf{tag}, nn{tag}),
    gw{tag} AS (SELECT id, gram, tf * idf AS w FROM g{tag} JOIN gi{tag} USING (gram)),
    gn{tag} AS (SELECT id, sqrt(sum(w * w)) AS norm FROM gw{tag} GROUP BY id),
    hw{tag} AS (SELECT id AS qid, gram, tf * idf AS w FROM h{tag} JOIN gi{tag} USING (gram)),
    hn{tag} AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM hw{tag} GROUP BY qid),
    dp{tag} AS (SELECT qid, id, sum(g.w * h.w) AS d FROM gw{tag} g JOIN hw{tag} h USING (gram) GROUP BY qid, id),
    cs{tag} AS (SELECT qid, id, d / (gn{tag}.norm * hn{tag}.norm) AS score FROM dp{tag} JOIN gn{tag} USING (id) JOIN hn{tag} USING (qid))"""
    return head + f""",
    gi{tag} AS (SELECT gram, ln((2.0 + n) / (1 + df)) + 1 AS idf0, ln((2.0 + n) / (2 + df)) + 1 AS idf1 FROM gf{tag}, nn{tag}),
    b0{tag} AS (SELECT id, sum(tf * idf0 * tf * idf0) AS base FROM g{tag} JOIN gi{tag} USING (gram) GROUP BY id),
    hw{tag} AS (SELECT id AS qid, gram, tf * coalesce(idf1, ln((2.0 + n) / 2) + 1) AS w, idf0, idf1 FROM h{tag} LEFT JOIN gi{tag} USING (gram), nn{tag}),
    hn{tag} AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM hw{tag} GROUP BY qid),
    dp{tag} AS (SELECT qid, g.id, sum(g.tf * h.idf1 * h.w) AS d, sum(g.tf * g.tf * (h.idf1 * h.idf1 - h.idf0 * h.idf0)) AS shift
        FROM g{tag} g JOIN hw{tag} h USING (gram) GROUP BY qid, g.id),
    cs{tag} AS (SELECT qid, id, d / (sqrt(base + shift) * hn{tag}.norm) AS score FROM dp{tag} JOIN b0{tag} USING (id) JOIN hn{tag} USING (qid))"""


_COSINE_TAIL = """, r AS (SELECT qid AS item_id, id AS doc_id, round(score, 6) AS score FROM cs),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10"""


@query("chargram_tfidf_topk", f"WITH {_cosine_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text', 'documents')}{_COSINE_TAIL}")
def chargram_tfidf_topk(spark, folder):
    """Idf fitted on the corpus only."""
    return _best_docs(spark, folder, B.GRAMS)


@query(
    "chargram_with_query_topk",
    f"WITH {_cosine_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text', 'documents', with_query=True)}{_COSINE_TAIL}",
)
def chargram_with_query_topk(spark, folder):
    """Idf fitted on the corpus plus the query."""
    return _best_docs(spark, folder, B.GRAMS_QUERY)


# ---------------------------------------------------------------- fused retrieval over chunks

_PREVIEW = f"CASE WHEN length({S.squeeze('text')}) <= 1200 THEN {S.squeeze('text')} ELSE substr({S.squeeze('text')}, 1, 1197) || '...' END"
_STOP = "', '".join(V.STOPWORDS)
_CHUNKS_SQL = f"""
    m AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, text FROM documents),
    f AS (SELECT substr(sha1(lower(path)), 1, 16) AS file_id, path, {S.squeeze(f"'Filename: ' || name || chr(10) || 'Path: ' || path || chr(10) || 'Modality: document' || chr(10) || name || chr(10) || path || CASE WHEN {S.squeeze('text')} = '' THEN '' ELSE chr(10) || {_PREVIEW} END || CASE WHEN text = '' THEN '' ELSE chr(10) || text END")} AS s FROM m),
    c AS (SELECT file_id, path, CAST(i AS INT) AS chunk_index, file_id || '::' || i AS chunk_id, substr(s, CAST(i AS INT) * 1950 + 1, 2200) AS text
        FROM (SELECT *, unnest(range({S.windows('length(s)', 2200, 250)})) AS i FROM f))"""
_PROFILE_SQL = f"""
    qk AS (SELECT item_id, text, {S.key('text')} AS k, {S.toks('text')} AS t FROM benchmark),
    kw AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM qk)
        WHERE length(term) >= 3 AND term NOT IN ('{_STOP}') GROUP BY ALL),
    kn AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS nr FROM kw),
    ks AS (SELECT item_id, string_agg(term, ' ' ORDER BY nr) AS words FROM kn GROUP BY item_id),
    q AS (SELECT item_id AS qid, text || ' ' || coalesce(words, '') AS sq, {S.word('k', V.MULTI_SOURCE_TERMS)} AS multi, k FROM qk LEFT JOIN ks USING (item_id))"""


def _fused_sql(wv, wb, with_query):
    return f"""{_CHUNKS_SQL}, {_PROFILE_SQL},
    {_bm25_sql('c', 'chunk_id', 'text', 'q', 'qid', 'sq')}, {_cosine_sql('c', 'chunk_id', 'text', 'q', 'qid', 'sq', 'c', with_query=with_query)},
    bo AS (SELECT qid, id, coalesce(cs.score, 0) AS v, coalesce(bm.score, 0) AS b FROM cs FULL JOIN bm USING (qid, id)),
    pk AS (SELECT qid, max(v) AS pv, max(b) AS pb FROM bo GROUP BY qid),
    fu AS (SELECT qid, id AS chunk_id, CASE WHEN pv > 0 THEN v / pv ELSE 0 END AS v, CASE WHEN pb > 0 THEN b / pb ELSE 0 END AS b FROM bo JOIN pk USING (qid)),
    fx AS (SELECT *, round({wv} * v + {wb} * b, 9) AS combined, CASE WHEN v > b * 1.3 THEN 'vector' WHEN b > v * 1.3 THEN 'bm25' ELSE 'hybrid' END AS reason FROM fu)"""


_HYBRID_SQL = f"""WITH {_fused_sql(0.5, 0.5, False)},
    sc AS (SELECT fx.*, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, chunk_id) AS rn FROM fx WHERE combined > 0),
    sd AS (SELECT sc.*, split_part(chunk_id, '::', 1) AS file_id, multi FROM sc JOIN q USING (qid)),
    pl AS (SELECT qid, file_id, multi, max(combined) AS score, max({{'c': combined, 'i': chunk_id, 'r': reason}}).r AS reason FROM sd GROUP BY ALL),
    rk0 AS (SELECT qid, term FROM (SELECT item_id AS qid, {S.key('term')} AS term FROM kn) JOIN q USING (qid) WHERE multi AND length(term) >= 4 AND term NOT LIKE '% %'),
    ho AS (SELECT DISTINCT term, file_id FROM (SELECT file_id, unnest({S.toks('text')}) AS term FROM c) SEMI JOIN rk0 USING (term)),
    rr AS (SELECT DISTINCT qid, file_id FROM ho JOIN rk0 USING (term) WHERE term IN (SELECT term FROM ho GROUP BY term HAVING count(*) <= 3)),
    bx AS (SELECT pl.qid, pl.file_id, path, pl.multi, round(score + CASE WHEN pl.multi AND NOT {S.word('k', V.IMAGE_WORDS)} AND NOT {S.word('k', V.AUDIO_WORDS)}
            AND NOT {S.word('k', V.TABLE_WORDS + V.COMPUTATION_TERMS)} THEN 0.05 ELSE 0 END, 9) + CASE WHEN rr.file_id IS NULL THEN 0 ELSE 3 END AS score,
            CASE WHEN rr.file_id IS NULL THEN reason ELSE 'rare_keyword' END AS reason
        FROM pl JOIN f USING (file_id) JOIN q USING (qid) LEFT JOIN rr ON rr.qid = pl.qid AND rr.file_id = pl.file_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM bx),
    top AS (SELECT * FROM rk WHERE rank <= CASE WHEN multi THEN 14 ELSE 8 END)"""


@query("hybrid_topk", f"{_HYBRID_SQL} SELECT qid AS item_id, path AS relative_path, score, reason, CAST(rank AS INT) AS rank FROM top")
def hybrid_topk(spark, folder):
    """Flagship: R10, R12-R14, W08, G16, F09, F10, O01, O02, J02, J06, J19, R16 over chunks."""
    manifest, chunks = lake(spark, folder)
    found = H.retrieve(settle(profile(questions(spark, folder))), manifest, chunks)
    return found.select(F.col("qid").alias("item_id"), "relative_path", "score", "reason", "rank")


@query(
    "hybrid_top_chunks",
    f"""{_HYBRID_SQL},
    s4 AS (SELECT fx.qid, chunk_id, combined AS score, row_number() OVER (PARTITION BY fx.qid, top.file_id ORDER BY combined DESC, chunk_id) AS rank
        FROM fx JOIN top ON top.qid = fx.qid AND top.file_id = split_part(chunk_id, '::', 1) WHERE combined > 0)
    SELECT qid AS item_id, chunk_id, s4.score, CAST(rank AS INT) AS rank, md5(text) AS text_md5 FROM s4 JOIN c USING (chunk_id) WHERE rank <= 4""",
)
def hybrid_top_chunks(spark, folder):
    """The four best chunks of every candidate file per question."""
    manifest, chunks = lake(spark, folder)
    asked = settle(profile(questions(spark, folder)))
    indexes = H.retrieval_index(asked, chunks)
    best = H.top_chunks(indexes, settle(H.retrieve(asked, manifest, chunks, indexes=indexes)), chunks)
    return best.select(F.col("qid").alias("item_id"), "chunk_id", F.col("combined").alias("score"), "rank", F.md5("text").alias("text_md5"))


@query(
    "hybrid_sumpool",
    f"""WITH {_fused_sql(0.55, 0.45, True)},
    z AS (SELECT qid, file_id, path, score, reason FROM (SELECT qid, split_part(chunk_id, '::', 1) AS file_id,
            sum(combined + CASE WHEN hint = 'document' THEN 0.35 WHEN hint = 'cross_file' THEN 0.1 ELSE 0 END) AS score,
            max({{'c': combined, 'i': chunk_id, 'r': reason}}).r AS reason
        FROM fx JOIN (SELECT qid, CASE WHEN {S.anyof('k', V.IMAGE_SUBSTRINGS)} THEN 'image' WHEN {S.anyof('k', V.AUDIO_SUBSTRINGS)} THEN 'audio'
            WHEN {S.anyof('k', V.DOCUMENT_SUBSTRINGS)} THEN 'document' WHEN {S.anyof('k', V.TABLE_SUBSTRINGS + V.COMPUTATION_SUBSTRINGS)} THEN 'table'
            WHEN {S.anyof('k', V.MULTI_SOURCE_SUBSTRINGS)} THEN 'cross_file' ELSE 'document' END AS hint FROM q) USING (qid)
        WHERE combined > 0 GROUP BY ALL) JOIN f USING (file_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, path) AS rank FROM z)
    SELECT qid AS item_id, path AS relative_path, round(score, 9) AS score, reason, CAST(rank AS INT) AS rank FROM y WHERE rank <= 8""",
)
def hybrid_sumpool(spark, folder):
    """The earlier product's sum pooling."""
    manifest, chunks = lake(spark, folder)
    found = H.retrieve_sum_pooled(settle(profile(questions(spark, folder), "earlier")), manifest, chunks)
    return found.select(F.col("qid").alias("item_id"), "relative_path", "score", "reason", "rank")


@query(
    "rare_keyword_files",
    f"""WITH {_PROFILE_SQL}, w AS (SELECT item_id, {S.key('term')} AS term FROM kn),
    h AS (SELECT DISTINCT term, doc_id FROM (SELECT doc_id, unnest({S.toks('text')}) AS term FROM documents)),
    r AS (SELECT term FROM h GROUP BY term HAVING count(*) <= 3)
    SELECT DISTINCT item_id, doc_id FROM w JOIN h USING (term) SEMI JOIN r USING (term) WHERE length(term) >= 4 AND term NOT LIKE '% %'""",
)
def rare_keyword_files(spark, folder):
    """J19, R16."""
    found = H.rare_keyword_files(profile(questions(spark, folder)), documents(spark, folder), file_col="doc_id")
    return found.select(F.col("qid").alias("item_id"), "doc_id")


@query("containment_join", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_join(spark, folder):
    """Gold pairs: documents that hold a passage verbatim, by an anchored equi-join instead of all pairs."""
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("passage"))
    return passages_in_texts(documents(spark, folder), items, hid="doc_id", hay_col="text", nid="item_id", needle_col="passage")


@query(
    "keyword_overlap_topk",
    f"""WITH d AS (SELECT doc_id, {S.key('text')} AS k FROM documents),
    q AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(string_split({S.key('text')}, ' ')) AS token FROM benchmark) WHERE token <> ''),
    s AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d ON contains(k, token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""",
)
def keyword_overlap_topk(spark, folder):
    """Question tokens contained anywhere in the text.

    A token is looked up in the vocabulary (it may sit inside a longer word),
    which turns containment in texts into an equi-join on words.
    """
    asks = table(spark, folder, "benchmark").select("item_id", F.explode(F.array_distinct(words(match_key(F.col("text"))))).alias("token"))
    held = documents(spark, folder).select("doc_id", F.array_distinct(words(match_key(F.col("text")))).alias("words"))
    return overlap_top_k(held, asks, id_col="doc_id", words_col="words", qid="item_id", token="token", k=8)


# ---------------------------------------------------------------- names and patterns


_ASKED_SQL = """a AS (SELECT DISTINCT event_type AS et, json_extract_string(props, '$.k') AS k FROM events),
    q AS (SELECT et || ' ' || k AS qid, lower('Count the ' || et || ' rows of ' || k || '.txt') AS qk, k || '.txt' AS hk, CASE WHEN et = 'click' THEN 'src' || k || '/' END AS pre FROM a),
    f AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name FROM documents)"""


def file_questions(spark, folder):
    """Questions that name files, composed from events: a file hint each, and a folder pattern for clicks."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    asked = table(spark, folder, "events").select(kind.alias("et"), k.alias("k")).distinct()
    return asked.select(
        F.concat_ws(" ", "et", "k").alias("qid"),
        F.concat(F.lit("Count the "), F.col("et"), F.lit(" rows of "), F.col("k"), F.lit(".txt")).alias("question"),
        F.array(F.concat("k", F.lit(".txt"))).alias("hints"),
        F.when(F.col("et") == "click", F.array(F.concat(F.lit("src"), F.col("k"), F.lit("/*"))))
        .otherwise(F.array().cast("array<string>")).alias("patterns"),
    )


@query(
    "direct_match",
    f"""WITH {_ASKED_SQL}, p AS (SELECT qid, path, CASE WHEN pre IS NOT NULL AND starts_with(path, pre) THEN 'explicit_pattern' WHEN hk = name THEN 'explicit_file'
        WHEN length(hk) >= 5 AND contains(path, hk) THEN 'explicit_text' WHEN contains(qk, name) THEN 'filename_in_question' END AS reason FROM q, f)
    SELECT qid, path, reason FROM p WHERE reason IS NOT NULL""",
)
def direct_match(spark, folder):
    """Patterns, names, parts of paths, names inside questions."""
    return direct_matches(settle(file_questions(spark, folder)), documents_as_files(documents(spark, folder)))


@query(
    "direct_match_inline_globs",
    f"""WITH {_ASKED_SQL}, p AS (SELECT qid, path, CASE WHEN hk = name THEN 'explicit_file' WHEN contains(path, hk) THEN 'explicit_text'
        WHEN pre IS NOT NULL AND starts_with(path, pre) THEN 'explicit_pattern' WHEN contains(qk, name) THEN 'filename_in_question' END AS reason FROM q, f)
    SELECT qid, path, reason FROM p WHERE reason IS NOT NULL""",
)
def direct_match_inline_globs(spark, folder):
    """The earlier rule, where hints may be globs and no minimum length applies."""
    asked = file_questions(spark, folder).withColumn("hints", F.concat("hints", "patterns"))
    return direct_matches(settle(asked), documents_as_files(documents(spark, folder)), inline_wildcards=True)


@query(
    "glob_filter",
    """WITH g AS (SELECT DISTINCT source, '*' || replace(source, 'src', '') || '?ref=*' AS glob, '.*' || replace(source, 'src', '') || '.ref=.*' AS rx FROM documents)
    SELECT DISTINCT source, url FROM g JOIN pages ON regexp_full_match(url, rx)""",
)
def glob_filter(spark, folder):
    """Shell patterns built from source names, matched on page addresses."""
    sources = table(spark, folder, "documents").select("source").distinct()
    globs = sources.select("source", F.concat(F.lit("*"), F.regexp_replace("source", "src", ""), F.lit("?ref=*")).alias("glob"))
    files = table(spark, folder, "pages").select("url", F.col("url").alias("_key"))
    return glob_matches(globs, files, nid="source", pattern_col="glob", path="url", path_key="_key", any_folder=False).select("source", "url")


_URLS = """urls AS (SELECT DISTINCT regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path FROM pages),
    k AS (SELECT path, trim(regexp_replace(lower(path), '[^a-z0-9_./* -]+', ' ', 'g')) AS key FROM urls),
    hosts AS (SELECT DISTINCT split_part(path, '/', 1) AS host FROM urls), folders AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM urls),
    q AS (SELECT 'part|' || split_part(path, '/', 2) AS qid, split_part(path, '/', 2) AS phrase FROM urls GROUP BY ALL UNION ALL SELECT 'host|' || host, host FROM hosts UNION ALL SELECT 'folder|' || folder, folder FROM folders)"""


def page_paths(spark, folder):
    """Urls of pages without scheme, query and fragment, as paths of files."""
    return table(spark, folder, "pages").select(F.regexp_extract("url", "^[^:]*://([^?#]*)", 1).alias("relative_path")).distinct()


def folder_questions(paths):
    step = F.split("relative_path", "/")
    at = lambda n: F.coalesce(F.get(step, F.lit(n)), F.lit(""))
    ask = lambda kind, phrase: paths.select(phrase.alias("p")).distinct().select(F.concat(F.lit(kind + "|"), "p").alias("qid"), F.concat(F.lit('How many files are in "'), "p", F.lit('"?')).alias("question"))
    return ask("part", at(1)).unionByName(ask("host", at(0))).unionByName(ask("folder", F.concat(at(0), F.lit("/"), at(1))))


@query(
    "quoted_folder_files",
    f"""WITH {_URLS} SELECT qid, count(*) AS n_files, min(path) AS first_path FROM q JOIN k
        ON list_contains(string_split(key, '/'), lower(phrase)) OR starts_with(key, lower(phrase) || '/') WHERE phrase <> '' GROUP BY qid""",
)
def quoted_folder_files(spark, folder):
    """Files of the folders and path parts that questions quote."""
    paths = settle(page_paths(spark, folder))
    found = quoted_groups(folder_questions(paths), path_names(paths))
    return found.groupBy("qid").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))


@query(
    "named_paths",
    f"""WITH {_URLS}, asked AS (SELECT qid, phrase, trim(regexp_replace(lower('How many files are in "' || phrase || '"?'), '[^a-z0-9_./* -]+', ' ', 'g')) AS text FROM q),
    names AS (SELECT DISTINCT path, name FROM (SELECT path, unnest(list_concat([key, regexp_replace(string_split(key, '/')[-1], '([^.])\\.[^.]*$', '\\1')], string_split(key, '/'))) AS name FROM k) WHERE name <> ''),
    found AS (SELECT DISTINCT qid, path FROM asked JOIN names ON contains(text, name) UNION SELECT qid, path FROM asked JOIN k ON phrase <> '' AND contains(key, lower(phrase)))
    SELECT qid, count(*) AS n_files, min(path) AS first_path FROM found GROUP BY qid""",
)
def named_paths(spark, folder):
    """Files of which questions hold the path, the name or a part, or quote a piece of the path."""
    paths = settle(page_paths(spark, folder))
    found = named_in_question(folder_questions(paths), paths)
    return found.groupBy("qid").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))
