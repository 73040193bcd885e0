"""Reading a question: language, file hints, modality, keywords, answer format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .arrays import let
from .text import collapse_spaces, has_all, has_any, has_word, match_key, tokens

_VIETNAMESE = f"(?=[^\\x00-\\x7f])[{V.VIETNAMESE_LETTERS}]"  # plain letters are told apart before the long class
_QUOTES = "[\"“”']([^\"“”']+)[\"“”']"
_PLAIN_QUOTES = "[\"']([^\"']+)[\"']"
_ENDINGS = "|".join(e[1:] for e in V.IMAGE_EXTENSIONS + V.AUDIO_EXTENSIONS + V.TABLE_EXTENSIONS + V.HINT_DOCUMENT_EXTENSIONS)
_FILE = f"(?i)([A-Za-z0-9_\\-\\[\\]./\\\\一-鿿]+\\.(?:{_ENDINGS}))\\b"
_FILE_WITH_SPACES = f"(?i)([A-Za-z0-9_\\-\\[\\]()& ./\\\\一-鿿]+\\.(?:{_ENDINGS}))"
_GLOB = "([A-Za-z0-9_\\-\\[\\]()&./\\\\]+/\\*)"
_GLOB_WITH_SPACES = "([A-Za-z0-9_\\-\\[\\]()& ./\\\\]+/\\*)"


def language(question: Column) -> Column:
    def named(key: Column) -> Column:
        found = F.lit(False)
        for term in V.VIETNAMESE_WORDS:
            found = found | F.contains(key, F.lit(f" {term} "))
        return found

    words = let(F.concat(F.lit(" "), match_key(question), F.lit(" ")), named)
    return (
        F.when(question.rlike("[一-鿿]"), F.lit("zh"))
        .when(F.lower(question).rlike(_VIETNAMESE), F.lit("vi"))
        .when(words, F.lit("vi"))
        .otherwise(F.lit("en"))
    )


def language_by_substring(question: Column) -> Column:
    """Earlier analyser: Vietnamese words count anywhere in the key."""
    return (
        F.when(question.rlike("[一-鿿]"), F.lit("zh"))
        .when(has_any(match_key(question), V.VIETNAMESE_SUBSTRINGS) | F.lower(question).rlike(_VIETNAMESE), F.lit("vi"))
        .otherwise(F.lit("en"))
    )


def quoted_phrases(question: Column, curly: bool = True) -> Column:
    found = F.regexp_extract_all(question, F.lit(_QUOTES if curly else _PLAIN_QUOTES), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda p: p != "")


def _as_paths(found: Column) -> Column:
    return F.transform(found, lambda h: F.replace(collapse_spaces(h), F.lit("\\"), F.lit("/")))


def file_hints(question: Column) -> Column:
    named = _as_paths(F.regexp_extract_all(question, F.lit(_FILE), F.lit(1)))
    quoted = F.filter(quoted_phrases(question), lambda p: p.rlike(f"(?i)\\.(?:{_ENDINGS})$"))
    quoted = F.transform(quoted, lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    return F.array_distinct(F.concat(named, quoted))


def wildcard_patterns(question: Column) -> Column:
    return F.array_distinct(_as_paths(F.regexp_extract_all(question, F.lit(_GLOB), F.lit(1))))


def file_hints_with_spaces(question: Column) -> Column:
    """Earlier analyser: names may hold spaces, and folder globs are hints too."""
    return F.array_distinct(
        F.concat(
            _as_paths(F.regexp_extract_all(question, F.lit(_FILE_WITH_SPACES), F.lit(1))),
            _as_paths(F.regexp_extract_all(question, F.lit(_GLOB_WITH_SPACES), F.lit(1))),
        )
    )


def modality_hint(key: Column, hints: Column, computes: Column, several: Column) -> Column:
    """First match of image, audio, table, several files, document; else auto."""
    named = F.lower(F.array_join(hints, " "))
    return (
        F.when(has_any(named, V.IMAGE_EXTENSIONS) | has_word(key, *V.IMAGE_WORDS), F.lit("image"))
        .when(has_any(named, V.AUDIO_EXTENSIONS) | has_word(key, *V.AUDIO_WORDS), F.lit("audio"))
        .when(has_any(named, V.TABLE_EXTENSIONS) | computes | has_word(key, *V.TABLE_WORDS), F.lit("table"))
        .when(several, F.lit("cross_file"))
        .when(has_any(named, V.HINT_DOCUMENT_EXTENSIONS), F.lit("document"))
        .otherwise(F.lit("auto"))
    )


def modality_hint_by_substring(key: Column, hints: Column, computes: Column, several: Column) -> Column:
    named = F.lower(F.array_join(hints, " "))
    return (
        F.when(has_any(named, V.IMAGE_EXTENSIONS) | has_any(key, V.IMAGE_SUBSTRINGS), F.lit("image"))
        .when(has_any(named, V.AUDIO_EXTENSIONS) | has_any(key, V.AUDIO_SUBSTRINGS), F.lit("audio"))
        .when(has_any(key, V.DOCUMENT_SUBSTRINGS), F.lit("document"))
        .when(has_any(named, V.TABLE_EXTENSIONS) | computes | has_any(key, V.TABLE_SUBSTRINGS), F.lit("table"))
        .when(several, F.lit("cross_file"))
        .otherwise(F.lit("document"))
    )


def keywords(question: Column, *phrases: Column) -> Column:
    """Phrases and hints first, then tokens of three letters or more that are not stopwords; all distinct ones."""
    plain = F.filter(tokens(question), lambda t: (F.length(t) >= 3) & ~t.isin(*V.STOPWORDS))
    return F.array_distinct(F.concat(*phrases, plain))


def decimals(key: Column) -> Column:
    """Number of decimals the question asks for, NULL when it does not say."""
    stated = F.regexp_extract(key, "(?:rounded to|round to|lam tron.{0,10})\\s*(\\d+)\\s*(?:decimal|chu so)", 1)
    out = F.when(stated != "", stated.try_cast("int"))
    for word, n in (("one", 1), ("two", 2), ("three", 3)):
        out = out.when(F.contains(key, F.lit(f"{word} decimal")) | F.contains(key, F.lit(f"{n} decimal")), F.lit(n))
    return out


def is_binary(key: Column) -> Column:
    return F.contains(key, F.lit("yes/no")) | key.rlike("^(did|do|does|is|are|was|were)\\b")


def format_instructions(question: Column, key: Column, answer_type: Column) -> Column:
    """Map with only the instructions that apply."""
    percent = F.contains(key, F.lit("percent"))
    pairs = [
        ("answer_type", F.lit(True), F.when(answer_type == "", F.lit("unknown")).otherwise(F.coalesce(answer_type, F.lit("unknown")))),
        ("binary", is_binary(key), F.lit("true")),
        ("uppercase", has_any(key, ("uppercase", "chu hoa")), F.lit("true")),
        ("percentage", percent, F.lit("true")),
        ("include_percent_sign", percent, F.contains(question, F.lit("%")).cast("string")),
        ("decimals", decimals(key).isNotNull(), decimals(key).cast("string")),
    ]
    entries = F.array(*[F.when(cond, F.struct(F.lit(name).alias("k"), value.alias("v"))) for name, cond, value in pairs])
    return F.map_from_entries(F.array_compact(entries))


def profile(questions: DataFrame, variant: str = "current") -> DataFrame:
    """Routing profile of every question (qid, question, answer_type)."""
    question = F.col("question")
    current = variant == "current"
    base = questions.select("qid", "question", F.coalesce("answer_type", F.lit("")).alias("answer_type"))
    base = base.withColumn("key", match_key(question))
    if current:
        base = (
            base.withColumn("language", language(question))
            .withColumn("quoted_phrases", quoted_phrases(question))
            .withColumn("explicit_file_hints", file_hints(question))
            .withColumn("wildcard_patterns", wildcard_patterns(question))
            .withColumn("requires_computation", has_word(F.col("key"), *V.COMPUTATION_TERMS))
            .withColumn("needs_multiple_sources", has_word(F.col("key"), *V.MULTI_SOURCE_TERMS))
        )
        hint = modality_hint
    else:
        base = (
            base.withColumn("language", language_by_substring(question))
            .withColumn("quoted_phrases", quoted_phrases(question, curly=False))
            .withColumn("explicit_file_hints", file_hints_with_spaces(question))
            .withColumn("wildcard_patterns", F.array().cast("array<string>"))
            .withColumn("requires_computation", has_any(F.col("key"), V.COMPUTATION_SUBSTRINGS))
            .withColumn("needs_multiple_sources", has_any(F.col("key"), V.MULTI_SOURCE_SUBSTRINGS))
        )
        hint = modality_hint_by_substring
    named = F.concat("explicit_file_hints", "wildcard_patterns")
    return (
        base.withColumn("modality_hint", hint(F.col("key"), named, F.col("requires_computation"), F.col("needs_multiple_sources")))
        .withColumn("keywords", keywords(question, F.col("quoted_phrases"), named))
        .withColumn("format_instructions", format_instructions(question, F.col("key"), F.col("answer_type")))
        .withColumn("search_query", F.concat_ws(" ", "question", F.array_join("keywords", " ")))
        .withColumn("analysis_source", F.lit("heuristic"))
    )


def merge_model_analysis(profiles: DataFrame, parsed: DataFrame) -> DataFrame:
    """Overlay a model's analysis: keywords appended, booleans OR-ed, rule-based format entries win."""
    joined = profiles.join(
        parsed.select(
            "qid",
            *[F.col(c).alias(f"_{c}") for c in ("language", "modality_hint", "keywords", "requires_computation", "needs_multiple_sources", "format_instructions")],
        ),
        "qid",
        "left",
    )
    known = F.col("_modality_hint").isin("table", "document", "image", "audio", "cross_file", "auto")
    takes = known & ((F.size("explicit_file_hints") == 0) | (F.col("_modality_hint") != "auto"))
    added = F.coalesce(F.transform("_keywords", collapse_spaces), F.array().cast("array<string>"))
    every = F.filter(F.concat("keywords", added), lambda k: k != "")
    rules_first = F.map_concat(
        F.map_filter(F.coalesce("_format_instructions", F.create_map().cast("map<string,string>")),
                     lambda k, v: ~F.array_contains(F.map_keys("format_instructions"), k)),
        "format_instructions",
    )
    return (
        joined.withColumn("language", F.coalesce(F.left(F.nullif(F.col("_language"), F.lit("")), F.lit(5)), "language"))
        .withColumn("modality_hint", F.when(takes, F.col("_modality_hint")).otherwise(F.col("modality_hint")))
        .withColumn("keywords", F.when(F.col("_keywords").isNull(), F.col("keywords")).otherwise(F.array_distinct(every)))
        .withColumn("requires_computation", F.col("requires_computation") | F.coalesce("_requires_computation", F.lit(False)))
        .withColumn("needs_multiple_sources", F.col("needs_multiple_sources") | F.coalesce("_needs_multiple_sources", F.lit(False)))
        .withColumn("format_instructions", rules_first)
        .withColumn("analysis_source", F.when(F.col("_language").isNull() & F.col("_keywords").isNull(), F.col("analysis_source")).otherwise(F.lit("model+heuristic")))
        .withColumn("search_query", F.concat_ws(" ", "question", F.array_join("keywords", " ")))
        .select(*profiles.columns)
    )


def is_counting_question(key: Column, has_hint: Column) -> Column:
    """Counts or lists over a named folder; the terms are plain substrings."""
    return has_hint & has_any(key, V.COUNTING_TERMS)


def needs_pattern_set(key: Column, hints: Column) -> Column:
    return has_all(key, ("how many", "image")) & F.exists(hints, lambda h: F.contains(h, F.lit("*")))


def solver_route(key: Column, extensions: Column, modalities: Column) -> Column:
    table = F.array_contains(modalities, "table")
    return (
        F.when(F.contains(key, F.lit("sql")) | F.array_contains(extensions, ".sql"), F.lit("sql_calculation"))
        .when(table & has_all(key, V.JOIN_CHAIN_TERMS), F.lit("tabular_calculation"))
        .when(table & has_any(key, V.CALCULATION_TERMS), F.lit("tabular_calculation"))
        .when(F.array_contains(modalities, "image"), F.lit("image_qa"))
        .when(F.array_contains(modalities, "audio"), F.lit("audio_qa"))
        .when(F.array_contains(modalities, "document"), F.lit("document_qa"))
        .otherwise(F.lit("open_qa"))
    )


def question_family(key: Column) -> Column:
    out = None
    for name, terms in V.QUESTION_FAMILIES:
        test = has_any(key, terms)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("document_open"))


def operation(key: Column) -> Column:
    out = None
    for name, terms in V.OPERATION_TERMS:
        test = has_any(key, terms)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def asks_file_extreme(key: Column) -> Column:
    return F.contains(key, F.lit("which file")) & has_any(key, V.FILE_EXTREME_TERMS)


def asks_for_label(key: Column) -> Column:
    return has_any(key, V.LABEL_TERMS)


def is_show_image(key: Column) -> Column:
    return has_any(key, ("cho toi xem anh", "show me")) & has_any(key, ("anh", "image"))


def is_scholarship_solver(key: Column) -> Column:
    return F.contains(key, F.lit("hoc bong")) & has_any(key, ("suat", "so luong"))


def roster_direction(key: Column) -> Column:
    """max or min of a superlative; Vietnamese splits it into a quantity word and "nhat"."""
    return (
        F.when(has_word(key, *V.ROSTER_MAX_TERMS), F.lit("max"))
        .when(has_word(key, *V.ROSTER_MIN_TERMS), F.lit("min"))
        .when(has_word(key, "nhat") & has_word(key, "it"), F.lit("min"))
        .when(has_word(key, "nhat") & has_word(key, "nhieu"), F.lit("max"))
    )


def is_roster_question(key: Column) -> Column:
    groups = (V.ROSTER_GROUP_TERMS, V.ROSTER_SIZE_TERMS, V.ROSTER_EXCLUDE_TERMS)
    out = roster_direction(key).isNotNull()
    for terms in groups:
        out = out & has_word(key, *terms)
    return out
