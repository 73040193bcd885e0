"""Files that a question names: by pattern, by name, by a part of the path.

Each rule is an equi-join or an anchored substring join; precedence is an
order number, and the smallest one decides the reason per (question, file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, glob_regex, slashes, stem
from ..functions.questions import quoted_phrases
from ..functions.text import match_key
from ..scale import broadcast_if_small, settle
from .containment import contains_pairs

_LATE = 1 << 30


def file_keys(manifest: DataFrame, path: str = "relative_path") -> DataFrame:
    p = slashes(F.col(path))
    return manifest.select(
        F.col(path).alias("path"),
        match_key(p).alias("path_key"),
        match_key(basename(p)).alias("name_key"),
        match_key(stem(basename(p))).alias("stem_key"),
    )


def glob_matches(patterns: DataFrame, files: DataFrame, *, nid: str, pattern_col: str, path: str, path_key: str, any_folder: bool) -> DataFrame:
    """(path, nid) where the path matches the glob, or also ``*/glob``.

    The longest literal part of the glob anchors the join; a glob without a
    literal may match every path: files are dealt by hash and such globs go to every part.
    """
    literal = F.reduce(
        F.split(F.col(pattern_col), "[*?]|\\[[^\\]]*\\]"), F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a)
    )
    rated = patterns.select(nid, F.col(pattern_col).alias("_glob"), literal.alias("_literal"))
    pairs = contains_pairs(files.select(path, path_key), rated, hid=path, hay_col=path_key, nid=nid, needle_col="_literal")
    open_globs = rated.filter(F.col("_literal") == "")
    if not open_globs.isEmpty():
        parts = 2 * files.sparkSession.sparkContext.defaultParallelism
        dealt = files.select(path, F.pmod(F.xxhash64(path), F.lit(parts)).cast("int").alias("_part"))
        everywhere = open_globs.select(nid, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        pairs = pairs.unionByName(dealt.join(everywhere, "_part").select(path, nid))
    checked = pairs.join(rated.select(nid, "_glob"), nid).join(files.select(path, F.col(path_key).alias("_key")), path)
    hit = F.expr("_key rlike _full")
    if any_folder:
        hit = hit | F.expr("_key rlike _nested")
    return (
        checked.withColumn("_full", glob_regex(F.col("_glob")))
        .withColumn("_nested", glob_regex(F.concat(F.lit("*/"), F.col("_glob"))))
        .filter(hit)
        .select(path, nid)
        .distinct()
    )


def direct_matches(profiles: DataFrame, manifest: DataFrame, *, inline_wildcards: bool = False) -> DataFrame:
    """(qid, path, reason) for profiles (qid, question, hints, patterns).

    ``hints`` are tested in order: equality with path, name or stem, then
    containment (five characters or more), so an early containment beats a
    later equality.  With ``inline_wildcards`` hints themselves may be globs,
    and containment has no minimum length: the earlier product's rule.
    """
    files = file_keys(manifest)
    hints = (
        profiles.select("qid", F.posexplode("hints").alias("pos", "hint"))
        .withColumn("key", match_key(slashes(F.col("hint"))))
        .filter(F.col("key") != "")
        .withColumn("hint_no", F.concat_ws("#", F.col("qid").cast("string"), F.col("pos").cast("string")))
    )
    base, least = 3, (1 if inline_wildcards else 5)
    names = files.select("path", F.explode(F.array_distinct(F.array("path_key", "name_key", "stem_key"))).alias("key"))
    equal = names.join(hints, "key").select(
        "qid", "path", (F.col("pos") * base + 1).alias("ord"), F.lit("explicit_file").alias("reason")
    )
    both = files.select("path", F.concat_ws("\n", "path_key", "name_key").alias("both"))
    inside = contains_pairs(
        both, hints.filter(F.length("key") >= least), hid="path", hay_col="both", nid="hint_no", needle_col="key"
    )
    inside = inside.join(hints.select("hint_no", "qid", "pos"), "hint_no").select(
        "qid", "path", (F.col("pos") * base + 2).alias("ord"), F.lit("explicit_text").alias("reason")
    )
    if inline_wildcards:
        globs = hints.filter(F.contains("key", F.lit("*"))).select("hint_no", "qid", F.col("pos").alias("gpos"), "key")
    else:
        globs = (
            profiles.select("qid", F.posexplode("patterns").alias("gpos", "glob"))
            .withColumn("key", match_key(slashes(F.col("glob"))))
            .filter(F.col("key") != "")
            .withColumn("hint_no", F.concat_ws("#", F.col("qid").cast("string"), F.col("gpos").cast("string")))
        )
    matched = glob_matches(
        globs, files, nid="hint_no", pattern_col="key", path="path", path_key="path_key", any_folder=not inline_wildcards
    )
    order = F.col("gpos") * base if inline_wildcards else F.lit(-1)
    matched = matched.join(globs, "hint_no").select("qid", "path", order.alias("ord"), F.lit("explicit_pattern").alias("reason"))

    asked = profiles.select("qid", match_key(F.col("question")).alias("q"))
    named = files.select(
        "path", F.explode(F.array(F.when(F.length("stem_key") >= 5, F.col("stem_key")), F.col("name_key"))).alias("name")
    ).filter(F.length("name") > 0)
    named = contains_pairs(asked, named.select("name").distinct(), hid="qid", hay_col="q", nid="name", needle_col="name").join(
        named, "name"
    )
    named = named.select("qid", "path", F.lit(_LATE).alias("ord"), F.lit("filename_in_question").alias("reason"))
    every = equal.unionByName(inside).unionByName(matched).unionByName(named)
    return every.groupBy("qid", "path").agg(F.min_by("reason", "ord").alias("reason"))


def path_names(manifest: DataFrame, path: str = "relative_path") -> DataFrame:
    """(path, key, part): the keys of a file's path parts (part true) and of the folders that lead to it, each once."""
    p = slashes(F.col(path))
    parts = F.transform(F.split(p, "/"), match_key)
    steps = F.split(match_key(p), "/")
    above = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/")))
    named = lambda keys, part: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.lit(part).alias("part")))
    names = F.array_distinct(F.concat(named(parts, True), named(above, False)))
    return manifest.select(F.col(path).alias("path"), F.inline_outer(names)).filter("key <> ''")


def quoted_groups(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, path) of all files in a folder, or with a path part, that the question (qid, question) quotes."""
    phrases = questions.select("qid", F.explode_outer(quoted_phrases(F.col("question"))).alias("_p")).select("qid", F.replace(match_key(F.col("_p")), F.lit("\\"), F.lit("/")).alias("key"))
    return broadcast_if_small(phrases.filter("key <> ''").distinct()).join(names, "key").select("qid", "path").distinct()


def named_in_question(questions: DataFrame, manifest: DataFrame, path: str = "relative_path") -> DataFrame:
    """(qid, path): the question holds the path, its name, its stem or any of its parts, or quotes a piece of the path.

    Names are compared once, however many files share them.
    """
    files = file_keys(manifest, path)
    own = files.select("path", F.explode(F.array("path_key", "stem_key")).alias("key"))
    parts = path_names(manifest, path).filter("part").select("path", "key")
    keys = settle(own.unionByName(parts).filter("key <> ''").distinct())
    asked = questions.select("qid", match_key(F.col("question")).alias("_q"))
    said = contains_pairs(asked, keys.select("key").distinct(), hid="qid", hay_col="_q", nid="key", needle_col="key").join(keys, "key").select("qid", "path")
    quoted = questions.select("qid", F.explode_outer(quoted_phrases(F.col("question"))).alias("_p")).select("qid", match_key(F.col("_p")).alias("phrase")).filter("phrase <> ''").distinct()
    held = contains_pairs(files, quoted.select("phrase").distinct(), hid="path", hay_col="path_key", nid="phrase", needle_col="phrase")
    return said.unionByName(held.join(quoted, "phrase").select("qid", "path")).distinct()
