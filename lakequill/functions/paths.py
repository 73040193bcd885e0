"""Paths, names, hashes and globs."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import AUDIO_EXTENSIONS, DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS, TABLE_EXTENSIONS


def slashes(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def source_key(path: Column) -> Column:
    """Path form used when comparing evidence: forward slashes, trimmed, lower case."""
    return F.lower(F.trim(slashes(path)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, "(?<=[^.])\\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), "(?<=[^.])(\\.[^.]+)$", 1))


def modality(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(*TABLE_EXTENSIONS), F.lit("table"))
        .when(ext.isin(*DOCUMENT_EXTENSIONS), F.lit("document"))
        .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(*AUDIO_EXTENSIONS), F.lit("audio"))
        .otherwise(F.lit("unknown"))
    )


def mime_type(path: Column) -> Column:
    """MIME type by extension, from the interpreter's own table; NULL when unknown."""
    known = sorted(set(TABLE_EXTENSIONS + DOCUMENT_EXTENSIONS + IMAGE_EXTENSIONS + AUDIO_EXTENSIONS + (".json", ".xml", ".zip")))
    pairs = [(e, mimetypes.guess_type("x" + e)[0]) for e in known]
    mapping = F.create_map(*[F.lit(v) for pair in pairs if pair[1] for v in pair])
    return F.try_element_at(mapping, extension(path))


def stable_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.encode(value, "UTF-8")), 1, length)


def file_id(relative_path: Column) -> Column:
    return stable_hash(F.lower(slashes(relative_path)))


def cache_name(relative_path: Column) -> Column:
    return F.concat(stable_hash(relative_path), F.lit("_"), F.substring(stem(basename(relative_path)), 1, 80), F.lit(".txt"))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    cut = F.substring(path, len(root) + 1, 1 << 30)
    return F.when(F.startswith(path, F.lit(root)), cut).otherwise(path)


def glob_regex(pattern: Column) -> Column:
    """Shell pattern to a full-match regex; ``*`` also crosses slashes."""
    quoted = F.regexp_replace(pattern, "([\\\\.^$|+(){}])", "\\\\$1")
    quoted = F.regexp_replace(quoted, "\\*", ".*")
    quoted = F.regexp_replace(quoted, "\\?", ".")
    quoted = F.regexp_replace(quoted, "\\[!", "[^")
    return F.concat(F.lit("(?s)^"), quoted, F.lit("$"))


def safe_name(value: Column) -> Column:
    """ASCII-only file name: other runs become an underscore, the extension keeps letters and digits."""
    from .text import strip_accents

    suffix = F.regexp_extract(value, "(?<=[^.])(\\.[^.]+)$", 1)
    body = F.regexp_replace(strip_accents(stem(value)), "[^\\x00-\\x7f]", "")
    body = F.regexp_replace(body, "[^A-Za-z0-9._-]+", "_")
    body = F.regexp_replace(body, "^[._]+|[._]+$", "")
    body = F.when(body == "", F.lit("file")).otherwise(body)
    return F.concat(body, F.regexp_replace(suffix, "[^A-Za-z0-9.]", ""))
