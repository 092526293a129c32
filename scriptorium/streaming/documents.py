"""The parser over a stream of documents.

Each document is one event and is parsed whole, so no state is kept between documents: a micro-batch is parsed by the
batch plan, and its references are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.citations import PATTERNS
from scriptorium.operators.parse import parse_text


def read_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of (doc_id, text) from Parquet files."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", max_files).parquet(path)


def parse_stream(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the references of each batch to Parquet under `out`, in a folder a batch, so that a repeated batch replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        parse_text(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def count_citations(docs: DataFrame, kind: str = "bracket", time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Citations of a kind per document, or per window of event time with a watermark for late documents."""
    n = F.size(F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[kind]), 0)).cast("long")
    if time is None:
        return docs.select("doc_id", n.alias("citations"))
    return docs.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.sum(n).alias("citations"))
