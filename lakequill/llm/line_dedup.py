"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count and then by its first ``depth``
tokens; a token with a digit is a variable field from the start.  In a leaf,
a token that fewer than ``min_docs`` documents have at its place is generalised
to a variable field too.  What is left is the line's template.  A template is
recurring if at least ``min_docs`` documents hold it and at least ``alike`` of
its tokens are fixed; recurring lines are dropped from every document.  With
``long_tokens``, two documents are enough for lines of so many tokens or more:
a leaf has lines of one token count, so a leaf has one such number.

With ``keep_first`` (the id column) no document is exempt: every template's lines
stay in the text that holds it first (smallest id that is not null, then the
text's hash) and go from all others.  Copies of a whole text are one text: they
lose the same lines, so near-duplicate stages still see them as copies.  A text
that would lose all its lines keeps the first.  Without ``keep_first``, a document of which recurring lines make up more than ``most`` of the
characters stays untouched.  Lines with fewer than ``min_tokens`` tokens are
never dropped.

Everything is counted over all documents.  Leaves with fewer than ``min_docs``
documents go first, so only lines that may recur are ever split into rows of
tokens; counts are pre-aggregated, and a hot line or leaf is a partial sum in
each task.

Defined results: a null text stays null with no lines; an empty text has none
either.  A line counts once for each document row that holds it.  Repeated rows
count as documents.  Columns of ``docs`` are kept as they are, the text apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import broadcast_if_small, settle
from .shared import col, free_name

#: Fixed values of the tree and of what counts as recurring.
DEPTH, MIN_DOCS, MIN_TOKENS, ALIKE, MOST = 3, 5, 3, 0.7, 0.5
#: Tokens of a line that recurs from two documents on, where that is asked for.
LONG_TOKENS = 50
FIELD = "<*>"
_BLANKS = r"[ \t\r\f\x0B]+"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit as a field."""
    masked = F.regexp_replace(line, r"[^ \t\r\f\x0B]*[0-9][^ \t\r\f\x0B]*", FIELD)
    return F.filter(F.split(masked, _BLANKS), lambda t: t != "")


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))


def _doc_lines(text: Column, depth: int) -> Column:
    """Distinct lines of one text: line and its leaf, null for lines too short."""
    return F.transform(F.array_distinct(F.split(text, "\n")), lambda x: F.struct(x.alias("line"), _tokens(x).alias("tokens")))


def recurring_lines(
    texts: DataFrame, text_col: str = "text", *, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, alike: float = ALIKE,
    long_tokens: int | None = None,
) -> DataFrame:
    """The distinct lines (column line) whose template (columns leaf, shape) recurs."""
    need = lambda size: F.when(size >= long_tokens, min(2, min_docs)).otherwise(min_docs) if long_tokens else F.lit(min_docs)
    lines = (
        texts.select(F.explode_outer(_doc_lines(col(text_col), depth)).alias("x"))
        .filter(F.size("x.tokens") >= min_tokens)
        .select(F.col("x.line").alias("line"), F.col("x.tokens").alias("tokens"), _leaf(F.col("x.tokens"), depth).alias("leaf"))
    )
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.first(need(F.size("tokens"))).alias("need")).filter("n >= need").select("leaf")
    found = lines.join(broadcast_if_small(settle(leaves)), "leaf", "left_semi")
    kinds = settle(found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")).withColumn("need", need(F.size("tokens"))))
    placed = kinds.select("leaf", F.xxhash64("line").alias("id"), "n", "need", F.posexplode_outer("tokens").alias("at", "token"))
    common = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("docs"), F.first("need").alias("need")).filter((F.col("docs") >= F.col("need")) & (F.col("token") != FIELD))
    fixed = placed.select("leaf", "id", "at", "token").join(common.select("leaf", "at", "token"), ["leaf", "at", "token"])
    shapes = fixed.groupBy("leaf", "id").agg(F.count("*").alias("n_fixed"), F.bit_xor(F.xxhash64("at", "token")).alias("shape"))
    named = kinds.withColumn("id", F.xxhash64("line")).join(shapes, ["leaf", "id"]).filter(F.col("n_fixed") >= alike * F.size("tokens"))
    templates = named.groupBy("leaf", "shape").agg(F.sum("n").alias("docs"), F.first("need").alias("need")).filter("docs >= need")
    return named.join(templates.select("leaf", "shape"), ["leaf", "shape"], "left_semi").select("line", "leaf", "shape")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", *, most: float = MOST, keep_first: str | None = None, **tree) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, plus n_lines and n_dropped.

    Names n_lines and n_dropped that ``docs`` has already are replaced.
    """
    text = col(text_col)
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    ident = col(keep_first) if keep_first else F.lit(None)
    texts = base.select(ident.alias("id"), text.alias("text")).filter(F.col("text").isNotNull())
    dropped = settle(recurring_lines(texts, "text", **tree))
    # which of its lines a text loses depends on the text alone: joined by its hash
    key = lambda t: (F.xxhash64(t).alias("_h1"), F.hash(t).alias("_h2"))
    held = (
        texts.select("id", *key(F.col("text")), F.explode_outer(F.array_distinct(F.split("text", "\n"))).alias("line"))
        .join(broadcast_if_small(dropped if keep_first else dropped.select("line")), "line", "inner" if keep_first else "left_semi")
    )
    if keep_first:
        order = F.struct(F.col("id").isNull().alias("none"), "id", "_h1", "_h2")
        firsts = settle(held.groupBy("leaf", "shape").agg(F.min(order).alias("f")).select("leaf", "shape", F.col("f._h1").alias("_f1"), F.col("f._h2").alias("_f2")))
        held = held.join(broadcast_if_small(firsts), ["leaf", "shape"]).filter((F.col("_h1") != F.col("_f1")) | (F.col("_h2") != F.col("_f2")))
    held = held.groupBy("_h1", "_h2").agg(F.collect_set("line").alias("_lines"))  # at most the lines of one text
    names = [free_name(base, n) for n in ("_h1", "_h2", "_lines")]
    held = held.toDF(*names)
    h1, h2 = key(text)
    rows = base.withColumns({names[0]: F.xxhash64(text), names[1]: F.hash(text)}).join(held, names[:2], "left")
    lines, gone = F.split(text, "\n"), col(names[2])
    kept = F.filter(lines, lambda x: ~F.array_contains(gone, x))
    if keep_first:
        kept = F.when(F.size(kept) == 0, F.slice(lines, 1, 1)).otherwise(kept)
    kept_text = F.array_join(kept, "\n")
    act = gone.isNotNull() if keep_first else gone.isNotNull() & (F.length(text) - F.length(kept_text) <= most * F.length(text))
    n_lines = F.when(text.isNull() | (text == ""), 0).otherwise(F.size(lines))
    rows = rows.withColumns({"n_lines": n_lines, "n_dropped": F.when(act, F.size(lines) - F.size(kept)).otherwise(0)})
    rows = rows.withColumn(text_col, F.when(act, kept_text).otherwise(text))
    return rows.select(*[col(c) for c in base.columns], "n_lines", "n_dropped")
