"""The line checks over a stream: stateless, so every micro-batch gives what a batch over its rows gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks

PAIRS = "doc_id long, pos long, h long, original string, translated string"


def read_pairs(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """Pairs written as Parquet, a few files a batch: the bounded queue."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def route(pairs: DataFrame, good: str, bad: str, checkpoint: str, on_validated: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write lines that pass to ``good`` and quarantined ones to ``bad``, one writer each.

    A batch is written under its number and replaced if it runs again, so a restart neither loses nor repeats rows.
    ``on_validated`` gets the lines of a batch that passed, once they are written, and the batch's number (X2).
    """

    def write(batch: DataFrame, number: int) -> None:
        held = checks.quarantine(batch)
        held.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        keys = held.selectExpr("chunk_index AS doc_id", "chunk_line AS pos")
        batch.join(keys, ["doc_id", "pos"], "left_anti").write.mode("overwrite").parquet(f"{good}/batch={number}")
        if on_validated:
            on_validated(batch.sparkSession.read.parquet(f"{good}/batch={number}"), number)

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, good: str, bad: str) -> DataFrame:
    """(batch, validated, rejected) of what a run has acknowledged."""
    sides = [spark.read.parquet(p).groupBy("batch").agg(F.count("*").alias(n)) for p, n in ((good, "validated"), (bad, "rejected"))]
    return sides[0].join(sides[1], "batch", "full").select("batch", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("validated", "rejected")])


def drain(query: StreamingQuery) -> bool:
    """Wait until all input that was there is done (T4); whether nothing is left."""
    query.awaitTermination()
    return not query.isActive and query.exception() is None


def fragment_errors(pairs: DataFrame) -> DataFrame:
    """``fragment_count_errors`` of a stream."""
    return checks.fragment_count_errors(pairs)
