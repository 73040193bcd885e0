"""Hybrid file retrieval: fused chunk scores, pooling per file, direct hits, cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..config import EngineConfig
from ..functions.arrays import rows_of
from ..functions.questions import is_counting_question, needs_pattern_set
from ..functions.text import match_key, tokens
from ..scale import broadcast_if_small, settle
from . import bounded as B
from .direct import direct_matches
from .ranking import dominant_signal, rank_complete, top_k

DIGITS = 9  # scores are rounded before ranking, so that summation order cannot change a rank


def _file_id(chunk_id: Column) -> Column:
    return F.element_at(F.split(chunk_id, "::"), 1)


def modality_bonus(hint: Column, modality: Column, extension: Column, full: float, cross_file: float) -> Column:
    return (
        F.when(hint == modality, F.lit(full))
        .when(hint == "cross_file", F.lit(cross_file))
        .when((hint == "table") & (F.lower(extension) == ".sql"), F.lit(full))
        .otherwise(F.lit(0.0))
    )


def rare_keyword_files(profiles: DataFrame, chunks: DataFrame, *, file_col: str = "file_id", max_files: int = 3, min_len: int = 4) -> DataFrame:
    """(qid, file) for files that hold a question keyword which at most ``max_files`` files hold."""
    wanted = (
        profiles.select("qid", F.explode("keywords").alias("keyword"))
        .select("qid", match_key(F.col("keyword")).alias("term"))
        .filter((F.length("term") >= min_len) & ~F.contains("term", F.lit(" ")))
        .distinct()
    )
    held = rows_of(chunks, [file_col], F.array_distinct(tokens(F.col("text"))), "term")
    terms = wanted.select("term").distinct()
    holders = settle(held.join(broadcast_if_small(terms), "term").distinct())
    rare = holders.groupBy("term").agg(F.count("*").alias("_n")).filter(F.col("_n") <= max_files)
    return holders.join(rare, "term").join(wanted, "term").select("qid", file_col).distinct()


def chunk_index(
    profiles: DataFrame, chunks: DataFrame, vector_weight: float, keyword_weight: float, full: float, cross_file: float, *, fit_includes_query: bool = False
) -> list[B.Index]:
    """Chunks ready for passes with the questions: both signals over their peaks, and the modality bonus of each hint."""
    hints = sorted(r[0] or "" for r in profiles.select("modality_hint").distinct().collect())  # a handful of modalities
    bonus = [modality_bonus(F.lit(h), F.col("modality"), F.col("extension"), full, cross_file) for h in hints] or [F.lit(0.0)]
    hint = (F.array_position(F.array(*[F.lit(h) for h in hints]), F.coalesce("modality_hint", F.lit(""))) - 1).cast("int") if hints else F.lit(0)
    built = B.index(
        chunks, profiles, signals=[B.GRAMS_QUERY if fit_includes_query else B.GRAMS, B.TERMS], shares=[vector_weight, keyword_weight], digits=DIGITS,
        id_col="chunk_id", file_col="relative_path", text_col="text", qid="qid", query_col="search_query", bonus=bonus, hint=hint, stored=True,
    )
    return [ix.fit_peaks() for ix in built]


def retrieval_index(profiles: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig()) -> list[B.Index]:
    return chunk_index(profiles, chunks, config.vector_weight, config.bm25_weight, config.modality_boost, config.modality_boost / 3)


def retrieve(
    profiles: DataFrame, manifest: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig(), indexes: list[B.Index] | None = None
) -> DataFrame:
    """Ranked candidate files per question: (qid, file_id, relative_path, modality, extension, score, reason, rank).

    Chunk scores are pooled by maximum per file, joined with direct hits and
    boosted by rare keywords; then the threshold and the final cut apply.  The
    tasks that score hand on their best files, those that a rare keyword may
    lift, and the best chunk; scores of all questions and chunks exist nowhere.
    """
    if indexes is None:
        indexes = retrieval_index(profiles, chunks, config)
    asked = profiles.select("qid", "key", "modality_hint", "needs_multiple_sources",
                            F.concat("wildcard_patterns", "quoted_phrases", "explicit_file_hints").alias("_hints"))
    small_asked = broadcast_if_small(asked)
    files = manifest.select("file_id", "relative_path", "modality", "extension")
    rare = settle(rare_keyword_files(profiles.filter("needs_multiple_sources"), chunks, file_col="relative_path").withColumn("_rare", F.lit(True)))
    lifted, widest = rare.select("qid", F.col("relative_path").alias("label")), max(config.top_k, config.cross_file_top_k)

    def reducers(ix):
        n, hints = len(ix.names), ix.hints
        return lambda: [B.Top(n, widest, "file", 1, hints), B.Top(n, 1, "id", 0), B.Wanted(1, 2, larger_text=True)]

    scanned = settle(B.union([ix.scan(reducers(ix), lifted).withColumn("reason", dominant_signal(*ix.shares_of())) for ix in indexes]))
    pooled = scanned.filter("kind > 0").groupBy("qid", F.col("file").alias("relative_path")).agg(F.max(F.struct("score", "id", "reason")).alias("_best"))
    pooled = pooled.select("qid", "relative_path", F.col("_best.score").alias("score"), F.col("_best.reason").alias("reason"))
    pooled = pooled.join(files, "relative_path").join(small_asked.select("qid", "modality_hint"), "qid")
    bonus = modality_bonus(F.col("modality_hint"), F.col("modality"), F.col("extension"), config.modality_boost, config.modality_boost / 3)
    pooled = pooled.select("qid", "relative_path", "file_id", "modality", "extension", F.round(F.col("score") + bonus, DIGITS).alias("score"), "reason")

    named = direct_matches(
        profiles.select("qid", "question", F.concat("explicit_file_hints", "quoted_phrases").alias("hints"), F.col("wildcard_patterns").alias("patterns")),
        manifest,
    )
    named = named.join(files, named["path"] == files["relative_path"]).select(
        "qid", "relative_path", "file_id", "modality", "extension", F.lit(V.DIRECT_SCORE).alias("score"), "reason"
    )
    merged = (
        pooled.withColumn("_direct", F.lit(False))
        .unionByName(named.withColumn("_direct", F.lit(True)))
        .groupBy("qid", "file_id")
        .agg(
            F.max_by(F.struct("relative_path", "modality", "extension", "score", "reason"), "score").alias("_b"),
            F.max("_direct").alias("_direct"),
        )
        .select("qid", "file_id", "_b.*", "_direct")
        .join(rare, ["qid", "relative_path"], "left")
        .withColumn("score", F.when(F.col("_rare"), F.col("score") + V.RARE_KEYWORD_BOOST).otherwise(F.col("score")))
        .withColumn("reason", F.when(F.col("_rare"), F.lit("rare_keyword")).otherwise(F.col("reason")))
    )
    best = scanned.filter("kind = 0").groupBy("qid").agg(F.max("score").alias("_semantic"))
    return _cut(settle(merged), best, small_asked, config)


def _cut(merged: DataFrame, best: DataFrame, asked: DataFrame, config: EngineConfig) -> DataFrame:
    """Complete pattern sets for counting questions; otherwise the threshold and top-k."""
    is_named = F.col("reason").isin("explicit_pattern", "explicit_text", "explicit_file")
    counting = asked.filter(is_counting_question(F.col("key"), F.size("_hints") > 0)).select("qid", "modality_hint")
    protected = merged.filter(is_named).join(counting, "qid")
    sets = protected.groupBy("qid").agg(
        F.count("*").alias("_n"), F.max((F.col("modality") == "image") & (F.col("modality_hint") == "image")).alias("_images")
    ).filter(F.col("_n") >= 2)
    whole = protected.join(sets, "qid").filter(~F.col("_images") | (F.col("modality") == "image"))
    directs = merged.groupBy("qid").agg(F.max("_direct").alias("_any_direct"))
    passing = (
        asked.select("qid", "needs_multiple_sources")
        .join(directs, "qid")
        .join(best, "qid", "left")
        .filter(F.col("_any_direct") | (F.coalesce("_semantic", F.lit(0.0)) >= config.min_relevance))
        .join(sets.select("qid"), "qid", "left_anti")
        .withColumn("_k", F.when(F.col("needs_multiple_sources"), config.cross_file_top_k).otherwise(config.top_k))
        .select("qid", "_k")
    )
    order = [F.desc("score"), F.asc("relative_path")]
    widest = max(config.top_k, config.cross_file_top_k)
    ranked = top_k(merged.join(passing, "qid"), ["qid"], order, widest).filter(F.col("rank") <= F.col("_k"))
    columns = ["qid", "file_id", "relative_path", "modality", "extension", "score", "reason", "rank"]
    complete = rank_complete(whole, ["qid"], order)
    return ranked.select(*columns).unionByName(complete.select(*columns))


def top_chunks(indexes: list[B.Index], candidates: DataFrame, chunks: DataFrame, per_file: int = V.CHUNKS_PER_FILE) -> DataFrame:
    """Best chunks of the candidate files (qid, relative_path) of each question: (qid, file_id, chunk_id, combined, rank, text)."""
    pairs = candidates.select("qid", F.col("relative_path").alias("label"))
    found = B.union([ix.scan(lambda: [B.Wanted(per_file, 1)], pairs) for ix in indexes])
    found = found.select("qid", F.col("id").alias("chunk_id"), F.col("score").alias("combined")).withColumn("file_id", _file_id(F.col("chunk_id")))
    best = top_k(found, ["qid", "file_id"], [F.desc("combined"), F.asc("chunk_id")], per_file)
    return best.join(chunks.select("chunk_id", "text"), "chunk_id")


def retrieve_sum_pooled(
    profiles: DataFrame, manifest: DataFrame, chunks: DataFrame, top: int = 8, indexes: list[B.Index] | None = None
) -> DataFrame:
    """Earlier product: chunk scores plus bonus are summed per file, direct hits add 5.

    ``profiles`` use the earlier analyser.  The idf is fitted on chunks plus the query.
    """
    if indexes is None:
        keyword_weight, vector_weight = V.SUMPOOL_WEIGHTS
        indexes = chunk_index(profiles, chunks, vector_weight, keyword_weight, V.SUMPOOL_MODALITY_BONUS, V.SUMPOOL_CROSS_FILE_BONUS, fit_includes_query=True)
    asked = broadcast_if_small(profiles.select("qid", "key", "modality_hint", F.col("explicit_file_hints").alias("_hints")))
    files = manifest.select("file_id", "relative_path", "modality", "extension")
    named = direct_matches(
        profiles.select("qid", "question", F.concat("explicit_file_hints", "quoted_phrases").alias("hints"), F.lit(None).cast("array<string>").alias("patterns")),
        manifest,
        inline_wildcards=True,
    )
    named = settle(named)
    # a path that several files have counts once for each of them, after the tasks' cut: its sums are asked for
    shared = manifest.groupBy("relative_path").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("relative_path").alias("label"))
    hinted = named.select("qid", F.col("path").alias("label")).unionByName(profiles.select("qid").crossJoin(shared))
    scanned = B.union([
        ix.scan(lambda n=len(ix.names), hints=ix.hints: [B.Sums(n, top, hints)], hinted)
        .withColumn("reason", dominant_signal(*ix.shares_of()))
        .withColumn("combined", F.round(ix.shares[0] * ix.shares_of()[0] + ix.shares[1] * ix.shares_of()[1], DIGITS))
        for ix in indexes
    ])
    summed = scanned.groupBy("qid", F.col("file").alias("relative_path")).agg(F.sum("score").alias("score"), F.max(F.struct("combined", "id", "reason")).alias("_best"))
    bonus = modality_bonus(F.col("modality_hint"), F.col("modality"), F.col("extension"), V.SUMPOOL_MODALITY_BONUS, V.SUMPOOL_CROSS_FILE_BONUS)
    summed = summed.join(files, "relative_path").join(asked.select("qid", "modality_hint"), "qid").select(
        "qid", "file_id", "relative_path", "modality", "score", (F.col("_best.combined") + bonus).alias("_top"), F.col("_best.reason").alias("reason"),
    )
    named = named.join(files, named["path"] == files["relative_path"]).select(
        "qid", "file_id", "relative_path", "modality", F.lit(V.SUMPOOL_DIRECT_SCORE).alias("score"), F.lit(V.SUMPOOL_DIRECT_SCORE).alias("_top"), "reason"
    )
    pooled = settle(
        summed.unionByName(named)
        .groupBy("qid", "file_id")
        .agg(
            F.first("relative_path").alias("relative_path"), F.first("modality").alias("modality"),
            F.round(F.sum("score"), DIGITS).alias("score"), F.max_by("reason", "_top").alias("reason"),
            F.max(F.col("reason") == "explicit_pattern").alias("_pattern"),
        )
    )
    order = [F.desc("score"), F.asc("relative_path")]
    sets = asked.filter(needs_pattern_set(F.col("key"), F.col("_hints"))).select("qid", "modality_hint")
    kept = pooled.join(sets, "qid").filter(F.col("_pattern") & ((F.col("modality_hint") != "image") | (F.col("modality") == "image")))
    full = rank_complete(kept, ["qid"], order)
    rest = top_k(pooled.join(kept.select("qid").distinct(), "qid", "left_anti"), ["qid"], order, top)
    columns = ["qid", "file_id", "relative_path", "modality", "score", "reason", "rank"]
    return rest.select(*columns).unionByName(full.select(*columns))
