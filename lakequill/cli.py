"""Command line: ``python -m lakequill.cli run|bench|audit ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ChunkBenchConfig, EngineConfig
from .operators import answering as O
from .operators.recall import recall_report, recall_summary
from .operators.tableqa import long_cells
from .plans import answering, chunk_bench
from .session import ship_package
from .providers.base import HashingEmbedder
from .scale import settle
from .sources import lake, sinks, tabular


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakequill")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="answer questions over a data lake")
    bench = sub.add_parser("bench", help="compare chunking methods")
    audit = sub.add_parser("audit", help="check how well the lake was parsed")
    for each in (run, bench, audit):
        each.add_argument("--data-lake", required=True)
        each.add_argument("--output", required=True)
        each.add_argument("--rebuild-index", action="store_true")
    for each in (run, bench):
        each.add_argument("--questions", required=True, help="CSV or XLSX with a Question column")
    defaults = EngineConfig()
    run.add_argument("--top-k", type=int, default=defaults.top_k)
    run.add_argument("--min-relevance", type=float, default=defaults.min_relevance)
    run.add_argument("--limit", type=int, default=None, help="answer only the first questions")
    bench.add_argument("--vector-store", default=None, help="folder of stored chunk vectors; only new texts are encoded")
    bench.add_argument("--methods", nargs="+", default=["naive_fixed", "naive_semantic", "pic"])
    return p


def _questions(spark: SparkSession, path: str):
    cells = tabular.table_cells(spark.read.format("binaryFile").load(path))
    return tabular.question_table(cells)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lakequill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    manifest = lake.load_or_build_manifest(spark, args.data_lake, f"{args.output}/manifest", args.rebuild_index)
    if args.command == "audit":
        rows = O.audit(manifest)
        sinks.write_csv(rows, f"{args.output}/parse_audit")
        print(sinks.markdown_table(O.audit_by_modality(rows)))
        return
    questions = _questions(spark, args.questions)
    if args.command == "bench":
        asked = questions.select(F.col("id").alias("qid"), "question")
        from .operators.metrics import source_matches

        wanted = questions.select(F.col("id").alias("qid"), F.explode("expected_sources").alias("source"))
        pairs = source_matches(manifest.select(F.col("relative_path").alias("file")), wanted, "file", "source")
        lost = wanted.join(pairs, "source", "left_anti").select("qid")
        expected = wanted.join(pairs, "source").select("qid", "file").distinct().join(lost, "qid", "left_anti")
        docs = manifest.select(F.col("relative_path").alias("file"), F.col("content").alias("text"))
        table = chunk_bench.compare(docs, asked, expected, tuple(args.methods), ChunkBenchConfig(), HashingEmbedder(), None, store=(args.vector_store, "hashing") if args.vector_store else None)
        sinks.write_json(table, f"{args.output}/summary")
        return
    asked = questions.select(F.col("id").alias("qid"), "question", "answer_type")
    if args.limit is not None:
        asked = asked.limit(args.limit)
    files = lake.scan(spark, args.data_lake).filter(F.lower("path").rlike("\\.(csv|xlsx)$"))
    cells = tabular.table_cells(files.withColumn("path", lake.below(F.col("path"), lake.qualified(spark, args.data_lake))))
    config = replace(EngineConfig(), top_k=args.top_k, min_relevance=args.min_relevance)
    result = answering.run(asked, manifest, config, cells=long_cells(cells))
    broken = O.submission_violations(result.submission, manifest)
    if not broken.isEmpty():
        print(sinks.markdown_table(broken))
    answering.write(result, args.output)
    expected = questions.join(asked.select(F.col("qid").alias("id")), "id", "left_semi").select(F.col("id").alias("qid"), F.explode("expected_sources").alias("source"))
    if not expected.isEmpty():
        report = settle(recall_report(asked, result.candidates, expected, manifest.select(F.col("relative_path").alias("path"))))
        sinks.write_csv(report, f"{args.output}/recall")
        print(sinks.markdown_table(recall_summary(report)))


if __name__ == "__main__":
    main()
