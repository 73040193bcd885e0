"""New files become manifest rows and chunks as they arrive; answers are appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import lake_chunks
from ..sources.lake import Reader, build_manifest

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Files of a folder as a stream; the source remembers which files it has read."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).load(root)


def ingest(spark: SparkSession, root: str, store: str, checkpoint: str, readers: dict[str, Reader] | None = None) -> StreamingQuery:
    """Append arriving files to the stored manifest and chunks, then stop (restart to go on).

    A batch that is replayed after a crash overwrites its own folder, so no
    file is stored twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{store}/manifest/batch={number}"
        build_manifest(spark, root, readers, files=batch).write.mode("overwrite").parquet(path)
        lake_chunks(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{store}/chunks/batch={number}")

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of questions; every finished batch is on disk, so a crash loses at most the current one."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
