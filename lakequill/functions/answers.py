"""Turning a raw answer into its submitted form."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed_values as V
from .text import collapse_spaces, has_any, match_key

_NUMBER = "[-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?"
_OPTION = "(?imd)^\\s*([A-D])[.)]\\s*(.+?)\\s*$"


@F.pandas_udf(StringType())
def format_number(value: pd.Series, places: pd.Series) -> pd.Series:
    """Fixed decimals if asked, else integer form, else ten significant digits.

    Rounds the binary value, half to even on ties; the JVM formatter rounds
    the decimal text half up and would give 0.87 for 0.865.
    """

    def one(x, n):
        if x is None or math.isnan(x):
            return V.NOT_ENOUGH_DATA
        if n is not None and not math.isnan(n):
            return f"{x:.{int(n)}f}"
        return str(int(x)) if float(x).is_integer() else f"{x:.10g}"

    return pd.Series([one(x, n) for x, n in zip(value, places)], dtype="object")


@F.pandas_udf(StringType())
def _rewrite_number(raw: pd.Series, places: pd.Series, wants_integer: pd.Series) -> pd.Series:
    def one(text, n, whole):
        if text is None:
            return None
        x = float(text)
        if n is not None and not math.isnan(n):
            return f"{x:.{int(n)}f}"
        if x.is_integer() and ("." not in text or whole):
            return str(int(x))
        shown = str(x)
        return shown if "e" in shown else shown.rstrip("0").rstrip(".")

    return pd.Series([one(t, n, w) for t, n, w in zip(raw, places, wants_integer)], dtype="object")


def strip_markdown(text: Column) -> Column:
    """Links and images become ``label (target)``, or whichever of both exists; emphasis marks go."""
    out = F.regexp_replace(text, "!?\\[\\s*\\]\\(\\s*\\)", "")
    out = F.regexp_replace(out, "!?\\[\\s*([^\\]]*?)\\s*\\]\\(\\s*\\)", "$1")
    out = F.regexp_replace(out, "!?\\[\\s*\\]\\(\\s*([^)]*?)\\s*\\)", "$1")
    out = F.regexp_replace(out, "!?\\[\\s*([^\\]]*?)\\s*\\]\\(\\s*([^)]*?)\\s*\\)", "$1 ($2)")
    return collapse_spaces(F.regexp_replace(out, "\\*\\*|__|`", ""))


def strip_prefix(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "(?i)^(final answer|answer|dap an|tra loi)\\s*[:：]\\s*", "")


_NOT_LETTER_BEFORE, _NOT_LETTER_AFTER = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def _yes_no(key: Column, question_key: Column) -> Column:
    compact = F.regexp_replace(key, "[^a-z]+", "")
    asked = question_key.rlike("^(?:" + "|".join(V.YES_NO_OPENERS) + ")")

    def says(word: str) -> Column:
        return asked & key.rlike(f"{_NOT_LETTER_BEFORE}{word}{_NOT_LETTER_AFTER}")

    return (
        F.when(compact.isin(*V.YES_WORDS) | (~compact.isin(*V.NO_WORDS) & says("yes")), F.lit("Yes"))
        .when(compact.isin(*V.NO_WORDS) | says("no"), F.lit("No"))
    )


def _multiple_choice(text: Column, question: Column) -> Column:
    """A bare letter always counts; a letter inside the answer only when the question lists options."""
    upper = F.upper(F.trim(text))
    letter = F.regexp_extract(upper, f"{_NOT_LETTER_BEFORE}([A-D]){_NOT_LETTER_AFTER}", 1)
    return F.when(upper.isin("A", "B", "C", "D"), upper).when(
        question.rlike("(?im)^\\s*[A-D][.)]\\s+") & (letter != ""), letter
    )


def rounding(key: Column) -> Column:
    out = None
    for word, n in (("two", 2), ("three", 3), ("one", 1)):
        test = has_any(key, (f"{word} decimal", f"{n} decimal"))
        out = F.when(test, F.lit(n)) if out is None else out.when(test, F.lit(n))
    return out.otherwise(F.regexp_extract(key, "rounded to (\\d+) decimal", 1).try_cast("int"))


def normalize_answers(rows: DataFrame, answer: str = "answer", question: str = "question", answer_type: str = "answer_type") -> DataFrame:
    """Replace the answer by its submitted form.

    Order: blank, markdown, not-enough, choice, yes/no, number, upper case,
    prefix.  A number counts only when no words surround it, unless the
    question has numeric intent.  Keys are staged as columns, so each is
    computed once per row; only the final number formatting is an Arrow function.
    """
    q = F.col(question)
    staged = rows.withColumns({"_raw": collapse_spaces(F.col(answer)), "_qk": match_key(q)})
    staged = staged.withColumn("_text", strip_markdown(F.col("_raw")))
    staged = staged.withColumns({"_key": match_key(F.col("_text")), "_found": F.regexp_extract("_text", _NUMBER, 0)})
    key, asked, text, found = F.col("_key"), F.col("_qk"), F.col("_text"), F.col("_found")
    settled = F.when(F.col("_raw") == "", F.lit(V.NOT_ENOUGH_DATA)).when(key == V.NOT_ENOUGH_DATA.lower(), F.lit(V.NOT_ENOUGH_DATA))
    staged = staged.withColumn("_early", F.coalesce(settled, _multiple_choice(text, q), _yes_no(key, asked)))
    wordy = F.replace(text, found, F.lit("")).rlike("[A-Za-z\\u00C0-\\u1EF9]") & ~has_any(asked, V.NUMERIC_INTENT_TERMS)
    raw = F.when(F.col("_early").isNull() & (found != "") & ~wordy, F.replace(found, F.lit(","), F.lit("")))
    staged = staged.withColumn("_number", _rewrite_number(raw, rounding(asked).cast("double"), F.contains(asked, F.lit("integer"))))
    sign = F.contains(asked, F.lit("percent")) & F.contains(q, F.lit("%"))
    number = F.when(sign, F.concat("_number", F.lit("%"))).otherwise(F.col("_number"))
    upper = F.contains(F.lower(q), F.lit("uppercase")) | F.contains(asked, F.lit("chu hoa"))
    rest = F.when(upper, F.upper(text)).otherwise(text)
    rest = F.when(F.lower(F.col(answer_type)) == "exact_match", strip_prefix(rest)).otherwise(rest)
    return staged.withColumn(answer, F.coalesce("_early", number, rest)).drop("_raw", "_qk", "_text", "_key", "_found", "_early", "_number")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, "[-+]?\\d+(?:\\.\\d+)?", 0).try_cast("double")


def options(question: Column) -> Column:
    """Options ``A. text`` by line: array of (letter, text); a repeated letter keeps its last text."""
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(question, F.lit(_OPTION), F.lit(1)), F.upper).alias("letter"),
        F.transform(F.regexp_extract_all(question, F.lit(_OPTION), F.lit(2)), collapse_spaces).alias("text"),
    )
    return F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["letter"] == p["letter"])
    )


def choose_option(question: Column, answer: Column) -> Column:
    """Letter of the option closest to a numeric answer, or equal to a text answer; the answer itself without options."""
    opts = options(question)
    value = F.replace(answer, F.lit("%"), F.lit("")).try_cast("double")
    ranked = F.transform(
        opts, lambda o, i: F.struct(F.coalesce(F.abs(first_number(o["text"]) - value), F.lit(float("inf"))).alias("d"), i.alias("i"), o["letter"].alias("letter"))
    )
    same = F.filter(opts, lambda o: match_key(o["text"]) == match_key(answer))
    return (
        F.when(F.size(opts) == 0, answer)
        .when(value.isNotNull(), F.array_min(ranked)["letter"])
        .otherwise(F.coalesce(F.get(same, F.lit(0))["letter"], answer))
    )


def number_key(text: Column) -> Column:
    """Sort key: the first number, minus infinity without one."""
    return F.coalesce(first_number(text), F.lit(float("-inf")))


def json_object(text: Column, schema: str) -> Column:
    """The outermost {...} of free text, parsed leniently; NULL when it is not an object."""
    return F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), schema, {"allowUnquotedControlChars": "true"})


def json_array(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(text, "(?s)\\[.*\\]", 0), schema, {"allowUnquotedControlChars": "true"})


def lenient_int(value: Column) -> Column:
    return F.regexp_extract(value.cast("string"), "\\d+", 0).try_cast("int")


def lenient_bool(value: Column) -> Column:
    return match_key(value.cast("string")).isin(*V.TRUE_WORDS)


def numbers(values: Column) -> Column:
    return F.filter(F.transform(values, first_number), lambda v: v.isNotNull())


def text_list(value: Column) -> Column:
    """List cell: JSON array, or a bare comma list with quotes and brackets removed."""
    text = collapse_spaces(value)
    for curly, plain in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")):
        text = F.replace(text, F.lit(curly), F.lit(plain))
    parsed = F.from_json(text, "array<string>")
    bare = F.split(F.regexp_replace(text, "^[\\[\\]]+|[\\[\\]]+$", ""), ",")
    bare = F.filter(bare, lambda p: F.trim(p) != "")
    bare = F.transform(bare, lambda p: F.regexp_replace(F.trim(p), "^[\"']+|[\"']+$", ""))
    blank = (text == "") | F.lower(text).isin("nan", "none")
    empty = F.array().cast("array<string>")
    return F.when(blank, empty).when(text.rlike("(?s)^\\[.*\\]$") & parsed.isNotNull(), parsed).otherwise(bare)


def evidence_json(evidences: Column) -> Column:
    return F.to_json(F.array_distinct(evidences))


def clean_scholarship(name: Column, drop_countries: bool = False) -> Column:
    text = name
    if drop_countries:
        text = F.regexp_replace(text, "(?i)\\b(VIET\\s*NAM|HAN\\s*QUOC|NHAT\\s*BAN|KOREA|JAPAN)\\b", "")
    return F.upper(collapse_spaces(F.split(text, ",")[0]))


def looks_like_gene(value: Column) -> Column:
    text = F.upper(F.trim(value))
    return text.rlike("^[A-Z0-9-]{2,20}$") & text.rlike("[A-Z]")


def drop_tickers(question: Column, answer: Column) -> Column:
    key = match_key(question)
    asked = has_any(key, ("hang hang khong", "airline"))
    return collapse_spaces(F.when(asked, F.regexp_replace(answer, "\\s*\\([A-Z0-9.:-]+\\)", "")).otherwise(answer))
