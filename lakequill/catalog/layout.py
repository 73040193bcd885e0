"""Word layout, rosters and scholarship rows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..scale import table, widen
from .registry import query


def words(spark, folder):
    """Order lines as recognised words: the order is the page, the part gives the block, quantity the confidence."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("block_num"), F.lit(0).alias("par_num"),
        (F.col("l_linenumber") % 3).alias("line_num"), F.col("l_linenumber").alias("word_num"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        F.when(F.col("l_quantity") < 5, F.lit("-1")).otherwise(F.col("l_quantity").cast("string")).alias("confidence"),
        F.col("l_suppkey").alias("left"), (F.col("l_linenumber") * 10).alias("top"), F.lit(8).alias("width"), F.lit(9).alias("height"),
    )


_WORDS = """w AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS block_num, l_linenumber % 3 AS line_num, l_linenumber AS word_num, 'w' || l_partkey AS text,
        l_quantity AS confidence, l_suppkey AS lft, l_linenumber * 10 AS top FROM lineitem WHERE l_quantity >= 5),
    l AS (SELECT doc, block_num, line_num, string_agg(text, ' ' ORDER BY lft, word_num, text) AS text, round(avg(confidence), 2) AS confidence, min(lft) AS lft, min(top) AS top,
        max(lft + 8) - min(lft) AS width, max(top + 9) - min(top) AS height FROM w GROUP BY ALL)"""


@query("ocr_lines", f"WITH {_WORDS} SELECT doc, block_num, line_num, md5(text) AS text_md5, confidence, lft AS left_edge, top, width, height FROM l")
def ocr_lines(spark, folder):
    """L01, L02, X49."""
    rows = L.lines(L.clean_words(words(spark, folder)), ["doc"])
    return rows.select("doc", "block_num", "line_num", F.md5("text").alias("text_md5"), "confidence", F.col("left").alias("left_edge"), "top", "width", "height")


@query(
    "ocr_blocks",
    f"""WITH {_WORDS} SELECT doc, block_num, md5(string_agg(text, chr(10) ORDER BY top, lft, line_num)) AS text_md5, round(avg(confidence), 6) AS confidence, count(*) AS line_count FROM l GROUP BY ALL""",
)
def ocr_blocks(spark, folder):
    """L03, O12."""
    rows = L.blocks(L.lines(L.clean_words(words(spark, folder)), ["doc"]), ["doc"], digits=6)
    return rows.select("doc", "block_num", F.md5("text").alias("text_md5"), "confidence", "line_count")


@query(
    "image_parse_scores",
    f"""WITH {_WORDS}, d AS (SELECT doc, string_agg(text, chr(10) ORDER BY top, lft, block_num, line_num) AS text, avg(confidence) AS conf, count(*) AS lines FROM l GROUP BY doc)
    SELECT doc, round(conf + least(length(text) / 100.0, 25), 6) AS score, conf < 40 OR length(text) < 30 AS weak FROM d""",
)
def image_parse_scores(spark, folder):
    """L05, F07."""
    rows = L.lines(L.clean_words(words(spark, folder)), ["doc"])
    per = rows.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "block_num", "line_num", "text"))), lambda e: e["text"]), "\n").alias("text"),
        F.avg("confidence").alias("conf"),
    )
    return per.select("doc", F.round(L.parse_score(F.col("text"), F.col("conf")), 6).alias("score"), L.weak_image(F.col("conf"), F.col("text")).alias("weak"))


def rosters(spark, folder):
    """One text per customer segment and nation: orders as projects, lines of the order's parts as members."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    members = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))), ", ").alias("names"))
    text = F.concat(
        F.lit("Project "), F.col("o_orderkey").cast("string"), F.lit(": order\nMembers: "), F.col("names"), F.lit(" + 2 SV\nObjective: ship\n")
    )
    return o.join(members, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc"), text.alias("text"))


@query(
    "project_members",
    "SELECT l_orderkey AS doc, CAST(l_orderkey AS VARCHAR) AS label, CAST(count(DISTINCT l_partkey) AS INT) AS member_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey",
)
def project_members(spark, folder):
    """Roster blocks in text, new people not counted.  An order has few lines, so the set is bounded."""
    return L.project_blocks(rosters(spark, folder), "doc", "text").select("doc", "label", "member_count")


@query(
    "largest_project",
    """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS answer, CAST(n AS INT) AS score FROM c ORDER BY n DESC, l_orderkey DESC LIMIT 1""",
)
def largest_project(spark, folder):
    """G26."""
    return L.largest_project(L.project_blocks(rosters(spark, folder), "doc", "text"), favour_combined=True)


@query(
    "best_scholarship",
    """SELECT upper(trim(split_part(p_name, ',', 1))) AS answer, CAST(p_size * 2 AS DOUBLE) AS slots FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size DESC, p_partkey DESC LIMIT 1""",
)
def best_scholarship(spark, folder):
    """Off-budget rows preferred, slot components summed, maximum taken."""
    p = widen(table(spark, folder, "part"))
    # The part number breaks ties of size: it enters as a negligible slot fraction and is rounded away.
    rows = p.select(
        F.col("p_name").alias("scholarship_name"), (F.col("p_type") == "ECONOMY").alias("off_budget"),
        F.array(F.col("p_size").cast("double"), F.col("p_size").cast("double"), F.col("p_partkey") * 1e-9).alias("slot_components"),
    )
    return L.best_scholarship(rows).select("answer", F.round("slots", 0).alias("slots"))


@query(
    "digit_counts",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]')) AS INT) AS digits, len(regexp_extract_all(text, '[0-9]')) = 1 AS exactly_one FROM documents",
)
def digit_counts(spark, folder):
    """A35, G28."""
    d = widen(table(spark, folder, "documents")).select("doc_id", L.digit_attributes(F.col("text")).alias("a"))
    n = F.coalesce("a.digit_count", F.lit(0))
    return d.select("doc_id", n.alias("digits"), (n == 1).alias("exactly_one"))
