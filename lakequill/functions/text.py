"""Text keys used for matching: collapsed spaces, accent folding, match keys, tokens.

Every function takes and returns a Column built from built-in expressions, so
text work stays inside generated code.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import MOJIBAKE_PATTERN, NOT_ENOUGH_DATA, TOKEN_PATTERN
from .arrays import let

# All Unicode blanks, spelled out: Java's \s is ASCII only.
BLANK = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# A run of blanks but for one space before a plain character, which is kept as it is; plain characters are told apart before the long class.
_BLANKS = f"(?! [!-~])(?![!-~]){BLANK}(?:(?![!-~]){BLANK})*"

# MATCH_KEY_DROP, with the common letters tested first: a class of many parts costs ten times as much per character.
_KEPT = "0-9_./*\\-\u4e00-\u9fff"
_DROP = f"(?![a-z ])[^{_KEPT}](?:(?![a-z ])[^{_KEPT}])*"

# Letters that fold to more than one letter.
_WIDE_FOLDS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "№": "no", "…": "..."}


def _is_kept(ch: str) -> bool:
    return ch in "_./* -" or "a" <= ch <= "z" or "A" <= ch <= "Z" or "0" <= ch <= "9" or "\u4e00" <= ch <= "\u9fff"


@lru_cache(maxsize=1)
def _fold_alphabets() -> tuple[str, str]:
    """Single-character folds derived from the Unicode decomposition table.

    A character is listed when its compatibility decomposition, stripped of
    combining marks, is one character that a match key keeps.
    """
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch in _WIDE_FOLDS or ch in "đĐ":
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(folded) == 1 and folded != ch and _is_kept(folded):
            source.append(ch)
            target.append(folded)
    return "".join(source), "".join(target)


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks become one space, ends are trimmed, NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def strip_accents(text: Column) -> Column:
    """Fold accented letters; ASCII text (bytes == characters) passes through untouched.

    The text is bound once: inlined, it would be made anew for every test and branch.
    """
    source, target = _fold_alphabets()
    pattern = "(?=[^\\x00-\\x7f])[" + "".join(_WIDE_FOLDS) + "]"

    def wide(folded: Column) -> Column:
        for letters, plain in _WIDE_FOLDS.items():
            folded = F.replace(folded, F.lit(letters), F.lit(plain))
        return folded

    def fold(t: Column) -> Column:
        folded = F.translate(F.regexp_replace(t, "\\p{Mn}+", ""), source, target)
        return F.when(F.length(t) == F.octet_length(t), t).when(t.rlike(pattern), wide(folded)).otherwise(folded)

    return let(text, fold)


def match_key(text: Column) -> Column:
    """Lower-case, accent-free key; a run of other characters becomes one space.

    Spaces are kept as they are, so a dropped run between two spaces leaves
    several spaces behind.  That is intended.
    """
    return F.trim(F.regexp_replace(strip_accents(F.lower(collapse_spaces(text))), _DROP, " "))


def compact_key(text: Column) -> Column:
    """Match key without spaces, for paths that differ in accents and blanks only."""
    return F.replace(match_key(text), F.lit(" "), F.lit(""))


def tokens(text: Column) -> Column:
    """Index tokens of two characters or more; runs of Chinese characters stay whole.

    Equal to tokenising the match key: everything the key drops is a separator here.
    """
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit(TOKEN_PATTERN), F.lit(0))


def words(key: Column) -> Column:
    """Non-empty space-separated parts of a match key."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def has_word(key: Column, *terms: str) -> Column:
    """Whole-word test with an optional plural s on a match key."""
    body = "|".join(_escape(term) for term in terms)
    return key.rlike(f"(?<![a-z0-9])(?:{body})s?(?![a-z0-9])")


def has_any(key: Column, terms) -> Column:
    """Plain substring test for any of the terms."""
    return key.rlike("|".join(_escape(term) for term in terms))


def has_all(key: Column, terms) -> Column:
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(key, F.lit(term))
    return out


def _escape(term: str) -> str:
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}-/" else c for c in term)


def clip(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, ending in three dots."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def preview(text: Column, limit: int = 1000) -> Column:
    return clip(collapse_spaces(text), limit)


def exact_match(left: Column, right: Column) -> Column:
    return match_key(left) == match_key(right)


def is_not_enough(text: Column) -> Column:
    """The answer says that there is not enough data (the key keeps the final dot)."""
    return match_key(text) == F.lit(NOT_ENOUGH_DATA.lower())


def clean_structure(text: Column) -> Column:
    """Drop NULs, unify line ends, squeeze blanks inside lines, keep at most three newlines."""
    t = F.regexp_replace(text, "\\x00", "")
    t = F.regexp_replace(t, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, f"(?:(?!\\n){BLANK})+(?=\\n|$)", "")
    t = F.regexp_replace(t, "\\n{4,}", "\n\n\n")
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def mojibake_score(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (
        F.regexp_count(text, F.lit(MOJIBAKE_PATTERN)) * 2
        + F.regexp_count(text, F.lit("[\\x80-\\x9f]"))
        + F.regexp_count(text, F.lit("\ufffd")) * 3
    )


def looks_like_mojibake(text: Column) -> Column:
    return mojibake_score(text) >= 2


# Where bytes read as Latin-1 are not UTF-8: a lead byte without its followers, a follower without a lead, overlong forms, surrogates.
_NOT_UTF8 = (
    r"[\u00c2-\u00df](?![\u0080-\u00bf])|[\u00e0-\u00ef](?![\u0080-\u00bf]{2})|[\u00f0-\u00f4](?![\u0080-\u00bf]{3})|[\u00c0\u00c1\u00f5-\u00ff]"
    r"|\u00e0[\u0080-\u009f]|\u00ed[\u00a0-\u00bf]|\u00f0[\u0080-\u008f]|\u00f4[\u0090-\u00bf]"
    r"|(?<![\u0080-\u00f4])[\u0080-\u00bf]|[\u00c2-\u00df][\u0080-\u00bf]{2}|[\u00e0-\u00ef][\u0080-\u00bf]{3}|[\u00f0-\u00f4][\u0080-\u00bf]{4}"
)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1, read right; the text itself where it can't be that, or nothing looks wrong.

    The whole text is judged, by searches that need no backtracking over it.
    """
    once_latin = ~text.rlike("[^\u0000-\u00ff]") & ~text.rlike(_NOT_UTF8) & text.rlike("[\u00c2-\u00f4]")
    return F.when(once_latin, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
