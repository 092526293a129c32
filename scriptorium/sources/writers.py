"""Writers of the engine's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import markup
from scriptorium.operators.parse import csl_json


def write_csl(refs: DataFrame, path: str) -> None:
    """One CSL-JSON object a line."""
    refs.select(csl_json(refs).alias("value")).write.text(path)


def write_series(series: DataFrame, path: str) -> None:
    """A chart's data as CSV with a header."""
    series.write.option("header", True).csv(path)


def write_entries(entries: DataFrame, path: str, column: str = "text") -> None:
    entries.select(column).write.text(path)


def write_bibliographies(entries: DataFrame, path: str, by: str = "style") -> None:
    """Entries (by, entry_no, runs) as text below path/plain and path/annotated, a folder for each value of `by`; blank lines between entries.

    Annotated entries have their italic runs in <i> tags. Entries of one part of the table follow each other by number.
    """
    ordered = entries.sortWithinPartitions(by, "entry_no")
    for name, text in (("plain", markup.plain(F.col("runs"))), ("annotated", markup.annotated(F.col("runs")))):
        ordered.select(by, F.concat(text, F.lit("\n")).alias("value")).write.partitionBy(by).text(f"{path}/{name}")


def write_expected(records: DataFrame, path: str, by: str = "style") -> None:
    """What a parser is expected to find, as one CSL-JSON object a line, a folder for each value of `by`."""
    absent = {c: F.lit(None).cast("string") for c in ("isbn", "arxiv", "chapter") if c not in records.columns}
    rows = records.withColumns(absent) if absent else records
    rows.withColumn("id", F.col("id").cast("string")).select(by, csl_json(rows).alias("value")).write.partitionBy(by).text(path)
