"""A complete run: questions and a manifest in, submission and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.answers import json_object
from ..functions.questions import merge_model_analysis, profile
from ..operators import answering as O
from ..operators.chunking import lake_chunks
from ..operators.hybrid import retrieval_index, retrieve, top_chunks
from ..providers.base import Providers, ask
from ..scale import settle
from ..sources import sinks
from .cascade import solve

_PROFILE = (
    "language string, modality_hint string, keywords array<string>, requires_computation boolean, "
    "needs_multiple_sources boolean, format_instructions map<string,string>"
)


@dataclass
class Run:
    profiles: DataFrame
    candidates: DataFrame
    blocks: DataFrame
    answers: DataFrame
    submission: DataFrame


def analyse(questions: DataFrame, providers: Providers) -> DataFrame:
    """Profiles of (qid, question, answer_type); a model's analysis is merged in when one is plugged in."""
    found = profile(questions)
    if providers.has_model():
        prompt = F.concat(F.lit("Analyse this question. Reply with JSON: language, modality_hint, keywords, requires_computation, "
                                "needs_multiple_sources, format_instructions.\n"), F.col("question"))
        parsed = ask(questions.select("qid", "question"), prompt, providers.complete, "_reply")
        found = merge_model_analysis(found, parsed.select("qid", json_object(F.col("_reply"), _PROFILE).alias("p")).select("qid", "p.*"))
    return settle(found)


def answer_blocks(profiles: DataFrame, blocks: DataFrame, providers: Providers) -> DataFrame:
    """(qid, answer, evidences, strategy): the model's JSON reply limited to its sources, else the best sentence."""
    fallback = O.extract_sentences(
        blocks.select("qid", F.col("rank").alias("pos"), "relative_path", "text"), profiles.select("qid", "question", "answer_type")
    ).select("qid", "answer", "evidences", "strategy")
    if not providers.has_model():
        return fallback
    # The blocks of one question are bounded by the context budget.
    shown = blocks.select("qid", "rank", "relative_path", O.prompt_block(F.col("relative_path"), F.col("modality"), F.col("text")).alias("b"))
    grouped = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "relative_path"))).alias("_s"))
    context = F.array_join(F.transform("_s", lambda e: e["b"]), "\n\n")
    asked = grouped.join(profiles.select("qid", "question"), "qid")
    prompt = F.concat(F.lit('Answer from the sources only. Reply with JSON {"answer": ..., "evidences": [...]}.\nQuestion: '), F.col("question"), F.lit("\n"), context)
    replied = ask(asked, prompt, providers.complete, "_reply").withColumn("_j", json_object(F.col("_reply"), "answer string, evidences array<string>"))
    allowed = F.transform("_s", lambda e: e["relative_path"])
    model = replied.filter(F.col("_j.answer").isNotNull()).select(
        "qid", F.col("_j.answer").alias("answer"), F.array_intersect(F.coalesce("_j.evidences", F.array().cast("array<string>")), allowed).alias("evidences"), F.lit("model").alias("strategy")
    )
    return model.unionByName(fallback.join(model.select("qid"), "qid", "left_anti"))


def run(
    questions: DataFrame, manifest: DataFrame, config: EngineConfig = EngineConfig(), providers: Providers | None = None, cells: DataFrame | None = None,
) -> Run:
    """Questions (qid, question, answer_type) over a manifest with ``content``.

    ``cells`` are the long rows of the lake's tables (path as in the manifest's
    ``relative_path``).  Dumps, rosters and tables answer before sentences (cascade).
    """
    providers = providers or Providers()
    profiles = analyse(questions, providers)
    chunks = settle(lake_chunks(manifest, config.chunk_chars, config.chunk_overlap))
    indexes = retrieval_index(profiles, chunks, config)
    candidates = settle(retrieve(profiles, manifest, chunks, config, indexes))
    best = top_chunks(indexes, candidates, chunks)
    texts = _candidate_text(candidates, best, manifest)
    flagged = candidates.join(profiles.select("qid", "needs_multiple_sources"), "qid")
    blocks = settle(_blocks(flagged, texts, config))
    answers = settle(solve(profiles, candidates, manifest, cells, answer_blocks(profiles, blocks, providers)))
    every = profiles.select("qid").join(answers, "qid", "left").select(
        "qid", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("evidences", F.array().cast("array<string>")).alias("evidences"),
        F.coalesce("strategy", F.lit("no_candidates")).alias("strategy"),
    )
    final = O.finalize(every, profiles.select("qid", "question", "answer_type"), manifest)
    return Run(profiles, candidates, blocks, final, O.submission(final))


def _candidate_text(candidates: DataFrame, best: DataFrame, manifest: DataFrame) -> DataFrame:
    """Best available text: the candidate's top chunks, else the stored text, else the preview."""
    ordered = best.groupBy("qid", "file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))  # at most four
    joined = candidates.select("qid", "file_id", "relative_path").join(ordered, ["qid", "file_id"], "left").join(
        manifest.select("file_id", "content", "text_preview"), "file_id"
    )
    from_chunks = F.array_join(F.transform("_c", lambda e: e["text"]), "\n\n")
    return joined.select("qid", "relative_path", F.coalesce(from_chunks, F.nullif("content", F.lit("")), "text_preview").alias("content"))


def _blocks(candidates: DataFrame, texts: DataFrame, config: EngineConfig) -> DataFrame:
    paired = candidates.withColumn("relative_path", F.to_json(F.struct("qid", "relative_path")))
    keyed = texts.select(F.to_json(F.struct("qid", "relative_path")).alias("relative_path"), "content")
    blocks = O.context_blocks(paired, keyed, config)
    return blocks.withColumn("relative_path", F.get_json_object("relative_path", "$.relative_path"))


def write(result: Run, folder: str) -> None:
    """The run's files: submission, debug predictions, profiles and retrieval log."""
    sinks.write_csv(result.submission, f"{folder}/submission")
    sinks.write_csv(result.answers, f"{folder}/predictions_debug")
    sinks.write_json(result.profiles, f"{folder}/profiles")
    rows = result.candidates.withColumn("score", F.round("score", 4))
    # At most the candidate limit of one question per group.
    nested = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "relative_path", "score", "reason"))).alias("retrieved"))
    sinks.write_json(nested, f"{folder}/retrieval_debug")


def error_analysis(questions: DataFrame, result: Run, manifest: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Enriched error rows and a markdown report, for questions with ground truth."""
    from ..operators.tables import value_counts

    enriched = settle(O.enrich_errors(O.error_rows(questions, result.submission), manifest, expected))
    tables = {name: value_counts(enriched, name) for name in ("analysis_bucket", "primary_modality", "question_family")}
    return enriched, sinks.error_report(O.error_summary(enriched), tables)
