"""DuckDB fragments shared by the checking SQL."""

FOLD = "replace(strip_accents(lower({x})), 'đ', 'd')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"trim(regexp_replace({FOLD.format(x=squeeze(x))}, '[^a-z0-9_./* \\-一-鿿]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"regexp_extract_all({FOLD.format(x=x)}, '[一-鿿]{{2,}}|[a-z0-9_./*\\-]{{2,}}')"


def word(k: str, terms) -> str:
    body = "|".join(t.replace(".", "\\.") for t in terms)
    return f"regexp_matches({k}, '(^|[^a-z0-9])(?:{body})s?($|[^a-z0-9])')"


def anyof(k: str, terms) -> str:
    body = "|".join(t.replace(".", "\\.").replace("*", "\\*") for t in terms)
    return f"regexp_matches({k}, '{body}')"


def sentences(x: str) -> str:
    """List of sentence units, blanks collapsed, empties dropped."""
    unified = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    marked = f"regexp_replace(regexp_replace({unified}, '([.!?;])\\s+', '\\1' || chr(9246), 'g'), '\\n+', chr(9246), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(9246)), "
        f"lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"
    )


def windows(length: str, size: int, overlap: int) -> str:
    """Number of windows over a text."""
    step = size - overlap
    return f"CASE WHEN {length} = 0 THEN 0 WHEN {length} <= {size} THEN 1 ELSE 1 + CAST(ceil(({length} - {size}) / {float(step)}) AS INT) END"
