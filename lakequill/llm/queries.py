"""The registered queries of this folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from ..scale import table
from ..session import ship_package
from . import bpe, quality
from .ann import nearest
from .embedding_dedup import embedding_groups
from .html_extract import extract_text
from .html_extract import fit as fit_pages
from .license_scan import BACK, RULES, SPAN, WEIGHT, digest, scan_licenses
from .line_dedup import drop_recurring_lines
from .mixing import mix_sources
from .negatives import mine_negatives
from .prefix_trie import conversation_trie
from .shared import LOWER, UPPER
from .simhash import simhash_groups
from .substring_dedup import cut_repeats
from .url_filter import filter_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, folder):
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Host, path, verdict of each rule.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op2_url_filter", f"""
WITH rules(rh, rp, rv) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN coalesce(instr(url, '://'), 0) = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT u.*, rh || rp AS rule, rv FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM j
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC) = 1""")
def op2_url_filter(spark, folder):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    judged = filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_mix_sources", r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST(sid % 3 AS INT) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w + sid * 0.0) AS final FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, coalesce(least(cap, final * w), cap) AS target FROM l, f),
b AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
  CASE WHEN b.source_size > 0 THEN least(2, b.budget // b.source_size) ELSE 0 END AS full_epochs,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(full_epochs * size + CASE WHEN full_epochs >= 2 THEN 0 ELSE
  greatest(0, least(budget - full_epochs * source_size - ahead, size)) END AS BIGINT) AS taken FROM p""")
def op6_mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_quality_ranker")
def op3_quality_ranker(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranker = quality.fit(docs, table(spark, folder, "labels").filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, ranker)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op5_simhash")
def op5_simhash(spark, folder):
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_line_templates", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
x AS (SELECT rid, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM d WHERE text IS NOT NULL),
t AS (SELECT rid, line, list_filter(string_split_regex(regexp_replace(line, '[^ \t\r\f\x0B]*[0-9][^ \t\r\f\x0B]*', '<*>', 'g'), '[ \t\r\f\x0B]+'), lambda y: y <> '') AS tokens FROM x),
l AS (SELECT *, len(tokens) AS n, list_slice(tokens, 1, 3) AS head FROM t WHERE len(tokens) >= 3),
k AS (SELECT n, head, line, any_value(tokens) AS tokens, count(*) AS docs FROM l GROUP BY ALL),
p AS (SELECT n, head, line, docs, unnest(tokens) AS token, unnest(range(n)) AS pos FROM k),
c AS (SELECT n, head, pos, token FROM p GROUP BY ALL HAVING sum(docs) >= 5 AND token <> '<*>'),
s AS (SELECT p.n, p.head, p.line, any_value(p.docs) AS docs, count(*) AS n_fixed, list(p.pos || ':' || p.token ORDER BY p.pos) AS shape
  FROM p JOIN c USING (n, head, pos, token) GROUP BY p.n, p.head, p.line HAVING count(*) >= 0.7 * p.n),
r AS (SELECT line FROM s JOIN (SELECT n, head, shape FROM s GROUP BY ALL HAVING sum(docs) >= 5) USING (n, head, shape)),
g AS (SELECT rid, list(line) AS gone FROM x JOIN (SELECT DISTINCT line FROM r) USING (line) GROUP BY rid),
j AS (SELECT d.*, gone, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda y: gone IS NULL OR NOT list_contains(gone, y)) AS kept FROM d LEFT JOIN g USING (rid)),
a AS (SELECT *, gone IS NOT NULL AND length(text) - length(array_to_string(kept, chr(10))) <= 0.5 * length(text) AS act FROM j)
SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(lines) END AS INT) AS n_lines,
  CAST(CASE WHEN act THEN len(lines) - len(kept) ELSE 0 END AS INT) AS n_dropped,
  md5(CASE WHEN act THEN array_to_string(kept, chr(10)) ELSE coalesce(text, '') END) AS kept_md5 FROM a""")
def op7_line_templates(spark, folder):
    kept = drop_recurring_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_and_check(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


@query("op10_substring_dedup")
def op10_substring_dedup(spark, folder):
    cut = cut_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_html_text")
def op9_html_text(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = extract_text(pages, fit_pages(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_embedding_groups")
def op8_embedding_groups(spark, folder):
    return embedding_groups(table(spark, folder, "embeddings"))


@query("op1_nearest")
def op1_nearest(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


def _license_sql() -> str:
    """The rules as rows: detections of each place, those that none covers, and the report."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({n}, {r.priority}, {text(r.label)}, {r.base}, {text(r.keyword)}, {text(f'^(?:{r.pattern}) ')}, {text(r.before and f'(?:^| ){r.before}$' or '')})" for n, r in enumerate(RULES))
    weights = " ".join(f"WHEN {p} THEN {w}" for p, w in WEIGHT.items())
    return rf"""
WITH r(ord, pri, label, base, kw, pattern, before) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT rid, w, unnest(list_filter(range(len(w)), lambda i: list_contains(words, w[i + 1]))) AS i FROM d, (SELECT list(DISTINCT kw) AS words FROM r)),
c AS (SELECT rid, i, r.*, regexp_extract(array_to_string(w[i + 1:i + {SPAN}], ' ') || ' ', pattern) AS hit,
  CASE WHEN before = '' THEN ' ' WHEN i = 0 THEN '' ELSE regexp_extract(array_to_string(w[greatest(1, i - {BACK - 1}):i], ' ') || ' ', before) END AS lead FROM k JOIN r ON w[i + 1] = kw),
m AS (SELECT *, i - length(ltrim(lead)) + length(replace(ltrim(lead), ' ', '')) AS s, i + length(hit) - length(replace(hit, ' ', '')) AS e FROM c WHERE hit <> '' AND lead <> ''),
f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.rid = m.rid AND o.pri <= m.pri AND o.s <= m.s AND o.e >= m.e
  AND (o.e - o.s > m.e - m.s OR (o.e - o.s = m.e - m.s AND (o.pri < m.pri OR (o.pri = m.pri AND o.ord < m.ord)))))),
b AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM m WHERE base GROUP BY rid),
l AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, min(pri) AS best FROM (SELECT rid, label, pri FROM f UNION ALL SELECT rid, label, pri FROM m WHERE base) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE best {weights} ELSE 0 END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)"""


@query("op12_license_scan", _license_sql())
def op12_license_scan(spark, folder):
    return scan_licenses(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *digest())


@query("op11_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""")
def op11_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


#: CRC-32 of ASCII text, bit by bit: a step is a byte to mix in or (-1) one shift.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END))"""


@query("op13_prefix_trie", f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.pos <= c.h) AS lent FROM c),
r AS (SELECT b.conv_id, t.pos, role, text FROM b JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT b.conv_id, pos - h + lent, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND pos > h),
k AS (SELECT conv_id, pos, octet_length(encode(text)) AS bytes, md5(string_agg(md5(role) || md5(text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM r),
m AS (SELECT conv_id, 0 AS depth, '' AS path, NULL AS above, 0 AS bytes FROM c
  UNION ALL SELECT conv_id, pos, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY pos), ''), bytes FROM k),
n AS (SELECT path, any_value(above) AS above, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY path),
s AS (SELECT above AS path, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN s USING (path)),
u AS (SELECT m.path, sum((w.n_convs - 1) * w.bytes) AS saved, count(*) FILTER (w.n_children = 0) AS leaves FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY 1) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w LEFT JOIN n AS p ON p.path = w.above JOIN u ON u.path = w.path LEFT JOIN e ON e.path = w.path""")
def op13_prefix_trie(spark, folder):
    conv = F.col("conv")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    nodes = conversation_trie(table(spark, folder, "conversations"), base=conv - conv % 5, heads=heads, most=8)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
