"""Dense vectors: norms, nearest neighbours, adjacent similarity, groups, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_norm, l2_normalize
from ..operators import semantic as M
from ..operators.dense import dense_top_k
from ..operators.scans import percentiles
from ..scale import table, widen
from .registry import query

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _dot(a, b):
    return _DOT.format(a=a, b=b)


_NORM = f"sqrt({_dot('embedding', 'embedding')})"


def embeddings(spark, folder):
    return widen(table(spark, folder, "embeddings"))


@query(
    "l2_norms",
    f"""SELECT vec_id, round({_NORM}, 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / {_NORM}, 6) AS first_unit,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / {_NORM}, 6) AS unit_sum FROM embeddings""",
)
def l2_norms(spark, folder):
    """X43, R31."""
    v = embeddings(spark, folder).select("vec_id", l2_norm(F.col("embedding")).alias("norm"), l2_normalize(F.col("embedding")).alias("u"))
    return v.select(
        "vec_id", F.round("norm", 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first_unit"),
        F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"),
    )


@query(
    "dense_topk",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS u FROM (SELECT *, {_NORM} AS n FROM embeddings)),
    s AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, round(list_dot_product(a.u, b.u), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT q, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
)
def dense_topk(spark, folder):
    """Every fiftieth vector is a query, against all."""
    v = embeddings(spark, folder)
    asks = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return dense_top_k(v, asks, id_col="vec_id", vec_col="embedding", qid="q", qvec_col="qv", k=10)


_PAIRS = f"""e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    n AS (SELECT label, vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e),
    s AS (SELECT label, vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 9) AS sim FROM n)"""


@query("adjacent_similarity", f"WITH {_PAIRS} SELECT label, vec_id, round(sim, 6) AS sim FROM s WHERE sim IS NOT NULL")
def adjacent_similarity(spark, folder):
    """W04."""
    rows = M.adjacent_similarity(embeddings(spark, folder).select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding")
    return rows.filter(F.col("sim").isNotNull()).select("label", "vec_id", F.round("sim", 6).alias("sim"))


@query(
    "similarity_percentiles",
    f"""WITH {_PAIRS} SELECT label, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.5), 6) AS p50,
        round(quantile_cont(sim, 0.95), 6) AS p95 FROM s WHERE sim IS NOT NULL GROUP BY label""",
)
def similarity_percentiles(spark, folder):
    """Exact interpolated percentiles per group."""
    rows = M.adjacent_similarity(embeddings(spark, folder).select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding")
    rows = rows.filter(F.col("sim").isNotNull()).select("label", "sim")
    found = percentiles(rows, ["label"], "sim", {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    return found.select("label", *[F.round(name, 6).alias(name) for name in ("p25", "p50", "p95")])


_GROUPS = f"""{_PAIRS}, p AS (SELECT label, round(quantile_cont(sim, 0.25), 9) AS t FROM s WHERE sim IS NOT NULL GROUP BY label),
    m AS (SELECT s.label, vec_id, CASE WHEN sim < t THEN 1 ELSE 0 END AS cut FROM s LEFT JOIN p USING (label)),
    g AS (SELECT label, vec_id, coalesce(sum(cut) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_id FROM m)"""


@query(
    "semantic_groups",
    f"WITH {_GROUPS} SELECT label, CAST(group_id AS INT) AS group_id, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM g GROUP BY ALL",
)
def semantic_groups(spark, folder):
    """W05, W06, C08 boundaries: gaps and islands below the percentile."""
    rows = M.boundary_groups(embeddings(spark, folder).select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding")
    return rows.groupBy("label", "group_id").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")
    )


@query(
    "pic_groups",
    """WITH d AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    p AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM d) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY pos) AS c FROM p GROUP BY label),
    s AS (SELECT label, vec_id, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 9) AS sim FROM d JOIN c USING (label)),
    t AS (SELECT label, vec_id, sim >= round(avg(sim) OVER (PARTITION BY label), 9) AS state FROM s),
    g AS (SELECT label, vec_id, state, CASE WHEN lag(state) OVER (PARTITION BY label ORDER BY vec_id) <> state THEN 1 ELSE 0 END AS ch FROM t),
    h AS (SELECT label, vec_id, state, sum(ch) OVER (PARTITION BY label ORDER BY vec_id) AS group_id FROM g)
    SELECT label, CAST(group_id AS INT) AS group_id, state, count(*) AS n, min(vec_id) AS first_id FROM h GROUP BY ALL""",
)
def pic_groups(spark, folder):
    """Similarity to the group centroid, runs of equal labels."""
    v = embeddings(spark, folder).select("label", "vec_id", "embedding")
    rows = M.summary_labels(v, M.centroids(v, ["label"], "embedding"), ["label"], "embedding", "centroid")
    runs = M.label_runs(rows.select("label", "vec_id", "state"), ["label"], "vec_id", "state")
    return runs.groupBy("label", "group_id", "state").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query(
    "late_pool",
    """WITH t AS (SELECT label, vec_id * 4 AS a, vec_id * 4 + 3 AS b, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    s AS (SELECT DISTINCT label, vec_id // 25 AS span_id, (vec_id // 25) * 100 AS sa, (vec_id // 25) * 100 + 110 AS sb FROM embeddings),
    j AS (SELECT label, span_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t JOIN s USING (label) WHERE b > sa AND a < sb),
    m AS (SELECT label, span_id, pos, avg(x) AS m FROM j GROUP BY ALL),
    n AS (SELECT label, span_id, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL)
    SELECT label, span_id, round(sum(m / n), 6) AS unit_sum, round(max(m / n), 6) AS largest FROM m JOIN n USING (label, span_id) GROUP BY ALL""",
)
def late_pool(spark, folder):
    """C17: vectors as tokens at four characters each, overlapping spans of 110 characters."""
    v = embeddings(spark, folder)
    tokens = v.select("label", (F.col("vec_id") * 4).alias("tok_start"), (F.col("vec_id") * 4 + 3).alias("tok_end"), F.col("embedding").alias("vector"))
    part = F.floor(F.col("vec_id") / 25)
    spans = v.select("label", part.alias("span_id"), (part * 100).alias("start_char"), (part * 100 + 110).alias("end_char")).distinct()
    pooled = M.pool_spans(tokens, spans, ["label"], "vector")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return pooled.select("label", "span_id", F.round(total, 6).alias("unit_sum"), F.round(F.array_max("vector"), 6).alias("largest"))
