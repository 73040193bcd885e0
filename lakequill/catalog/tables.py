"""Table questions over the star schema, joins, set operations, profiles, SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_any, match_key
from ..operators import tableqa as Q
from ..operators import tables as T
from ..operators.answering import extract_sentences
from ..plans import cascade
from ..scale import settle, table
from .registry import query


def _answer(spark, folder, name, question):
    found = T.answer_table(table(spark, folder, name), question)
    return found.result.select("operation", F.round("value", 2).alias("value"))


@query("mean_by_filter", "SELECT 'mean' AS operation, round(avg(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = '1-URGENT'")
def mean_by_filter(spark, folder):
    """Filter and measure come from the question."""
    return _answer(spark, folder, "orders", "What is the average o_totalprice of orders with priority 1-URGENT?")


@query("sum_by_filter", "SELECT 'sum' AS operation, round(sum(p_retailprice), 2) AS value FROM part WHERE p_type = 'ECONOMY'")
def sum_by_filter(spark, folder):
    """G02."""
    return _answer(spark, folder, "part", "What is the total p_retailprice of ECONOMY parts?")


@query("median_by_filter", "SELECT 'median' AS operation, round(quantile_cont(c_acctbal, 0.5), 2) AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
def median_by_filter(spark, folder):
    """Exact median without one task holding all values."""
    return _answer(spark, folder, "customer", "What is the median c_acctbal in the building segment?")


@query("count_by_filter", "SELECT 'count' AS operation, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type = 'purchase'")
def count_by_filter(spark, folder):
    """G03, F02."""
    return _answer(spark, folder, "events", "How many purchase events are there?")


@query("mean_first_value_filter", "SELECT round(avg(value), 4) AS value FROM events WHERE event_type = 'error'")
def mean_first_value_filter(spark, folder):
    """One equality per column that the question does not name."""
    question = "Average value of an error, per row?"
    kept, _ = T.filter_first_value(table(spark, folder, "events"), question)
    column = T.measure_column_by_name(kept, question)
    return kept.agg(F.round(F.avg(T.as_number(column)), 4).alias("value"))


@query("pearson", "SELECT 'correlation' AS operation, round(corr(l_quantity, l_extendedprice), 6) AS value FROM lineitem")
def pearson(spark, folder):
    """G05, G06."""
    found = T.answer_table(table(spark, folder, "lineitem"), 'What is the correlation between "l_quantity" and "l_extendedprice"?')
    return found.result.select("operation", F.round("value", 6).alias("value"))


@query(
    "argmax_label",
    "SELECT 'max' AS operation, c_name AS label, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 1",
)
def argmax_label(spark, folder):
    """G11."""
    return T.answer_table(table(spark, folder, "customer"), "Which customer name has the highest c_acctbal?").result


@query("argmin_label", "SELECT 'min' AS operation, s_name AS label, s_acctbal AS value FROM supplier ORDER BY s_acctbal, s_name LIMIT 1")
def argmin_label(spark, folder):
    """G11."""
    return T.answer_table(table(spark, folder, "supplier"), "What is the name of the supplier with the lowest s_acctbal?").result


@query(
    "cross_file_extreme",
    """SELECT file, value FROM (SELECT 'customer' AS file, max(c_acctbal) AS value FROM customer UNION ALL SELECT 'supplier', max(s_acctbal) FROM supplier)
    ORDER BY value DESC LIMIT 1""",
)
def cross_file_extreme(spark, folder):
    """G12."""
    files = {name: table(spark, folder, name) for name in ("customer", "supplier")}
    return T.extreme_across(files, 'Which file has the highest "acctbal"?')


@query("gene_list_count", "SELECT 'count' AS operation, CAST(count(c_name) + 1 AS DOUBLE) AS value FROM customer")
def gene_list_count(spark, folder):
    """A one-column list whose header is itself an entry."""
    listed = table(spark, folder, "customer").select(F.col("c_name").alias("BRD8"))
    return T.answer_table(listed, "How many significant genes are listed?").result.select("operation", "value")


_COUNTS = "SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM {t}), 2) AS percent FROM {t} GROUP BY ALL"


@query(
    "value_counts_pct",
    " UNION ALL ".join(_COUNTS.format(c=c, t=t) for c, t in (("event_type", "events"), ("lang", "documents"), ("o_orderpriority", "orders"))),
)
def value_counts_pct(spark, folder):
    """G13, W12."""
    out = None
    for column, name in (("event_type", "events"), ("lang", "documents"), ("o_orderpriority", "orders")):
        part = T.value_counts(table(spark, folder, name), column).select(F.lit(column).alias("field"), "value", "count", "percent")
        out = part if out is None else out.unionByName(part)
    return out


_STAR = {
    "customer": [("c_custkey", "bigint", 1), ("c_name", "string", 0), ("c_nationkey", "int", 1), ("c_acctbal", "double", 1), ("c_mktsegment", "string", 0)],
    "part": [("p_partkey", "bigint", 1), ("p_name", "string", 0), ("p_brand", "string", 0), ("p_type", "string", 0), ("p_size", "int", 1), ("p_retailprice", "double", 1)],
    "orders": [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0), ("o_totalprice", "double", 1), ("o_orderdate", "timestamp_ntz", 0), ("o_orderpriority", "string", 0)],
    "labels": [("doc_id", "bigint", 1), ("quality", "int", 1), ("toxic", "int", 1)],
}


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS type, count({c}) AS non_null, {f'count({c})' if num else 'CAST(0 AS BIGINT)'} AS numeric_count, count(DISTINCT {c}) AS distinct_count FROM {t}"
        for t, cols in _STAR.items() for c, k, num in cols
    ),
)
def table_profile(spark, folder):
    """A02, G09, G10 profiles."""
    out = None
    for name in _STAR:
        p = T.table_profile(table(spark, folder, name))
        part = p.select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "type", "non_null",
                        F.col("numeric").alias("numeric_count"), F.col("distinct").alias("distinct_count"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "semi_join_chain",
    """WITH s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
    i AS (SELECT DISTINCT p_type AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey IN (SELECT c_custkey FROM s)),
    t AS (SELECT DISTINCT upper(trim(p_type)) AS target FROM part WHERE p_size > 40)
    SELECT string_agg(item, ' and ' ORDER BY item) AS answer, count(*) AS items FROM i WHERE item IN (SELECT target FROM t)""",
)
def semi_join_chain(spark, folder):
    """Samples, facts, targets; the answer is a short sorted list."""
    customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
    facts = (
        table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        .join(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    conditions = [F.contains(match_key(F.col("c_mktsegment")), F.lit("building")), F.col("c_acctbal") > 9000]
    items = T.join_chain(customer, "c_custkey", conditions, facts, "o_custkey", "p_type", part.filter("p_size > 40"), "p_type")
    return items.agg(F.array_join(F.array_sort(F.collect_set("item")), " and ").alias("answer"),
                     F.count("*").alias("items"))


@query(
    "relational_division",
    """SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""",
)
def relational_division(spark, folder):
    """Customers that used every priority."""
    orders = table(spark, folder, "orders")
    return T.divide(orders, "o_custkey", "o_orderpriority", orders)


def _nations(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c, s


@query("set_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, folder):
    """U01, U05."""
    c, s = _nations(spark, folder)
    return c.union(s).distinct()


@query("set_intersect", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, folder):
    """U02."""
    c, s = _nations(spark, folder)
    return c.intersect(s)


@query("set_except", "SELECT DISTINCT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(spark, folder):
    """U03."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"))
    return orders.subtract(table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")))


_SQL = """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


@query("sql_on_tables", _SQL)
def sql_on_tables(spark, folder):
    """One SELECT over named tables."""
    return T.query_views({n: table(spark, folder, n) for n in ("orders", "customer", "nation")}, _SQL)


@query(
    "json_extract",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
)
def json_extract(spark, folder):
    """Object found inside free text."""
    from ..functions.answers import json_object

    text = F.concat(F.lit("result: "), F.col("props"), F.lit(" done"))
    return table(spark, folder, "events").select("event_id", json_object(text, "k int")["k"].alias("k"))


@query(
    "question_modality_counts",
    """WITH k AS (SELECT role, lower(text) AS t FROM conversations)
    SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(t, 'image|anh|visible|digit|blue')) AS with_image_word FROM k GROUP BY role""",
)
def question_modality_counts(spark, folder):
    """Predicates counted per group."""
    rows = table(spark, folder, "conversations")
    hit = has_any(F.lower("text"), ("image", "anh", "visible", "digit", "blue"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(hit).alias("with_image_word"))


_OPS = (("average", "mean", "avg({x})"), ("total", "sum", "sum({x})"), ("median", "median", "quantile_cont({x}, 0.5)"), ("lowest", "min", "min({x})"), ("maximum", "max", "max({x})"))


def _asked(df, column, path, text, ops=_OPS):
    """Questions for every value of a column and every operation, each with its table."""
    words = F.array(*[F.lit(w) for w, _, _ in ops])
    rows = df.select(F.col(column).alias("v")).distinct().select("v", F.explode(words).alias("w"))
    return rows.select(F.concat_ws("|", F.lit(path), "w", "v").alias("qid"), F.format_string(text, "w", "v").alias("question"), F.lit(path).alias("path"), F.lit(1).alias("rank"))


def _asked_sql(name, column, x, ops=_OPS):
    return " UNION ALL ".join(
        f"SELECT '{name}|{w}|' || {column} AS qid, '{op}' AS operation, round({agg.format(x=x)}, 2) AS value FROM {name} GROUP BY {column}" for w, op, agg in ops
    )


@query(
    "table_answers",
    f"""{_asked_sql("customer", "c_mktsegment", "c_acctbal")} UNION ALL {_asked_sql("orders", "o_orderpriority", "o_totalprice", _OPS[:1])}
    UNION ALL SELECT 'part|' || p_type, 'count', CAST(count(*) AS DOUBLE) FROM part GROUP BY p_type
    UNION ALL SELECT 'one|' || c_name, 'mean', round(c_acctbal, 2) FROM customer
    UNION ALL SELECT 'pair|customer', 'correlation', round(corr(c_acctbal, c_nationkey), 2) FROM customer""",
)
def table_answers(spark, folder):
    """All questions over three tables in one plan; c_name has far more than 200 values."""
    customer, orders, part = (table(spark, folder, n) for n in ("customer", "orders", "part"))
    asked = _asked(customer, "c_mktsegment", "customer", "What is the %s c_acctbal in the segment %s?")
    asked = asked.unionByName(_asked(orders, "o_orderpriority", "orders", "Give the %s o_totalprice of orders with priority %s", _OPS[:1]))
    kinds = part.select(F.col("p_type").alias("v")).distinct()
    asked = asked.unionByName(kinds.select(F.concat(F.lit("part|"), "v").alias("qid"), F.format_string("How many parts have the type %s?", "v").alias("question"), F.lit("part").alias("path"), F.lit(1).alias("rank")))
    people = customer.select(F.concat(F.lit("one|"), "c_name").alias("qid"), F.format_string("What is the average c_acctbal of %s?", "c_name").alias("question"), F.lit("customer").alias("path"), F.lit(1).alias("rank"))
    pair = spark.createDataFrame([("pair|customer", "What is the correlation of 'c_acctbal' and 'c_nationkey'?", "customer", 1)], asked.schema)
    asked = asked.unionByName(people).unionByName(pair)
    cells = Q.long_table(customer, "customer", "c_custkey").unionByName(Q.long_table(orders, "orders", "o_orderkey")).unionByName(Q.long_table(part.select("p_partkey", "p_type"), "part", "p_partkey"))
    found = Q.answer_tables(asked.select("qid", "question"), asked.select("qid", "path", "rank"), cells)
    return found.select("qid", "operation", F.round("value", 2).alias("value"))


@query(
    "cascade_answers",
    """SELECT 'sql|' || l_orderkey AS qid, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS answer, 'sql_sum' AS strategy, 'dumps/' || l_orderkey || '.sql' AS source FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT 'roster|' || l_orderkey, CAST(arg_max(l_linenumber, l_quantity * 100 + l_linenumber) AS VARCHAR), 'context_roster', 'rosters/' || l_orderkey || '.txt' FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT 'table|' || c_mktsegment, CAST(count(*) AS VARCHAR), 'table_count', 'customer' FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'text|' || p_partkey, 'The item ' || p_name || ' comes from ' || p_brand || '.', 'extractive_fallback', 'parts/' || p_partkey || '.txt' FROM part""",
)
def cascade_answers(spark, folder):
    """Dumps of orders, rosters, a table and texts, each asked in one run of the solvers."""
    lines, customer, part = (table(spark, folder, n) for n in ("lineitem", "customer", "part"))
    order = F.col("l_orderkey").cast("string")
    row = F.format_string("(%s, '%s', %s, '%s')", F.col("l_quantity").cast("string"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"), "l_returnflag")
    people = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_quantity").cast("int")), lambda i: F.concat(F.lit("m"), i.cast("string"))), ", ")
    project = F.concat(F.lit("Project "), F.col("l_linenumber").cast("string"), F.lit(": work\nMembers: "), people)
    joined = lambda c, by: F.array_join(F.array_sort(F.collect_list(c)), by)  # noqa: E731  the lines of one order
    texts = lines.groupBy(order.alias("o")).agg(joined(row, ", ").alias("rows"), joined(project, "\n").alias("roster"))
    ddl = "CREATE TABLE lines (line INTEGER, code VARCHAR(9), quantity DECIMAL(12,2), flag CHAR(1), PRIMARY KEY (line));\nINSERT INTO lines (quantity, code, line, flag) VALUES "
    files = texts.select(F.concat(F.lit("sql|"), "o").alias("qid"), F.lit("What is the total quantity of code?").alias("question"), F.concat(F.lit("dumps/"), "o", F.lit(".sql")).alias("relative_path"),
                         F.lit("table").alias("modality"), F.lit(".sql").alias("extension"), F.concat(F.lit(ddl), "rows", F.lit(";")).alias("content"))
    files = files.unionByName(texts.select(F.concat(F.lit("roster|"), "o").alias("qid"), F.lit("Which project has the most members?").alias("question"), F.concat(F.lit("rosters/"), "o", F.lit(".txt")).alias("relative_path"),
                                           F.lit("document").alias("modality"), F.lit(".txt").alias("extension"), F.col("roster").alias("content")))
    key = F.col("p_partkey").cast("string")
    files = files.unionByName(part.select(F.concat(F.lit("text|"), key).alias("qid"), F.concat(F.lit("Where does the item "), "p_name", F.lit(" come from?")).alias("question"), F.concat(F.lit("parts/"), key, F.lit(".txt")).alias("relative_path"),
                                          F.lit("document").alias("modality"), F.lit(".txt").alias("extension"), F.concat(F.lit("The item "), "p_name", F.lit(" comes from "), "p_brand", F.lit(". Sold since long ago.")).alias("content")))
    segments = customer.select("c_mktsegment").distinct().select(F.concat(F.lit("table|"), "c_mktsegment").alias("qid"), F.concat(F.lit("How many customers are in the segment "), "c_mktsegment", F.lit("?")).alias("question"),
                                                                 F.lit("customer").alias("relative_path"), F.lit("table").alias("modality"), F.lit(".csv").alias("extension"), F.lit("Customers by segment.").alias("content"))
    files = settle(files.unionByName(segments))
    asked = files.select("qid", "question", F.lit("table").alias("modality_hint"), F.lit("").alias("answer_type"))
    candidates = files.select("qid", "relative_path", "modality", "extension", F.lit("explicit_file").alias("reason"), F.lit(1).alias("rank"))
    sentences = extract_sentences(files.select("qid", F.lit(1).alias("pos"), "relative_path", F.col("content").alias("text")), asked)
    found = cascade.solve(asked, candidates, files.select("relative_path", "extension", "content").distinct(), Q.long_table(customer, "customer", "c_custkey"), sentences)
    return found.select("qid", "answer", "strategy", F.element_at("evidences", 1).alias("source"))
