"""Joinable columns of the star schema, and the tables that questions need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import joinable as J
from ..scale import settle, table
from .registry import query

# Columns of whole numbers and texts: amounts and times are no keys.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
}

_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in COLUMNS.items() for c in cols)
_PAIRS = f"""cells AS (SELECT t, c, v, count(*) AS n, ('0x' || substr(md5(v), 1, 15))::BIGINT AS h FROM ({_CELLS}) WHERE trim(v) <> '' GROUP BY t, c, v),
    samples AS (SELECT t, c, v, count(*) OVER (PARTITION BY t, c) AS sampled FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY h) AS place FROM cells) WHERE place <= {J.SKETCH}),
    pairs AS (SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, sampled, count(*) AS held, count(*) FILTER (b.n = 1) AS once,
        string_split(a.c, '_')[-1] = string_split(b.c, '_')[-1] AS same_name
        FROM samples a JOIN cells b ON a.v = b.v AND a.t <> b.t GROUP BY ALL HAVING count(*) >= 0.9 * sampled)"""


def _cells(spark, folder):
    def one(name, columns):
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return table(spark, folder, name).select(F.lit(name).alias("path"), F.lit("").alias("sheet"), F.inline_outer(pairs))

    return reduce(lambda a, b: a.unionByName(b), [one(t, columns) for t, columns in COLUMNS.items()])


@query("joinable_columns", f"WITH {_PAIRS} SELECT * FROM pairs")
def joinable_columns(spark, folder):
    """Which columns hold the values of which others, by sketches of the whole columns."""
    return J.joinable_columns(_cells(spark, folder)).select(*J.A, *J.B, "sampled", "held", "once", "same_name")


_WORDS = " UNION ".join(f"SELECT '{t}' AS t, regexp_replace('{w}', 's$', '') AS w" for t, cols in COLUMNS.items() for w in (t, *(c.split("_")[-1] for c in cols)))


@query(
    "table_shortlist",
    f"""WITH RECURSIVE {_PAIRS},
    keys AS (SELECT table_a AS a, table_b AS b FROM pairs WHERE same_name AND once >= 0.9 * held),
    links AS (SELECT a, b FROM keys UNION SELECT b, a FROM keys),
    questions AS (SELECT DISTINCT 'brand|' || p_brand AS qid, 'Which customers ordered parts of the brand ' || p_brand || '?' AS q FROM part
        UNION ALL SELECT 'nation|' || n_nationkey, 'How many suppliers has the region of number ' || n_nationkey || '?' FROM nation
        UNION ALL SELECT DISTINCT 'priority|' || o_orderpriority, 'How much do people spend at ' || o_orderpriority || '?' FROM orders),
    rare AS (SELECT t, w FROM ({_WORDS}) QUALIFY count(*) OVER (PARTITION BY w) <= 3),
    asked AS (SELECT qid, regexp_replace(unnest(regexp_extract_all(lower(q), '[a-z0-9]+')), 's$', '') AS w FROM questions),
    named AS (SELECT DISTINCT qid, t FROM asked JOIN rare USING (w)),
    walks AS (SELECT qid, t AS s, t, [t] AS path FROM named UNION ALL SELECT qid, s, b, list_append(path, b) FROM walks JOIN links ON a = t WHERE len(path) <= 3 AND NOT list_contains(path, b)),
    chains AS (SELECT qid, path FROM walks JOIN named USING (qid, t) WHERE s < t QUALIFY len(path) = min(len(path)) OVER (PARTITION BY qid, s, t)),
    bridges AS (SELECT DISTINCT qid, unnest(path) AS t FROM chains)
    SELECT qid, t AS "table", 'named' AS reason FROM named
    UNION ALL SELECT qid, t, 'bridge' FROM bridges ANTI JOIN named USING (qid, t)
    UNION ALL SELECT qid, NULL, 'all_tables' FROM questions WHERE qid NOT IN (SELECT qid FROM named)""",
)
def table_shortlist(spark, folder):
    """The tables that questions name and those that join them."""
    part, nation, orders = (table(spark, folder, n) for n in ("part", "nation", "orders"))
    ask = lambda df, kind, c, before: df.select(c).distinct().select(F.concat(F.lit(kind + "|"), F.col(c).cast("string")).alias("qid"), F.concat(F.lit(before), F.col(c).cast("string"), F.lit("?")).alias("question"))
    questions = ask(part, "brand", "p_brand", "Which customers ordered parts of the brand ").unionByName(ask(nation, "nation", "n_nationkey", "How many suppliers has the region of number "))
    questions = settle(questions.unionByName(ask(orders, "priority", "o_orderpriority", "How much do people spend at ")))
    columns = spark.createDataFrame([(t, c) for t, cols in COLUMNS.items() for c in cols], "table string, column string")  # names of the given tables
    return J.shortlist_tables(questions, columns, J.join_links(J.joinable_columns(_cells(spark, folder))))
