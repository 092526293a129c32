"""Readers of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import dates

CSL_ITEM = """id string, type string, title string, author array<struct<family:string,given:string,literal:string>>,
editor array<struct<family:string,given:string,literal:string>>, `container-title` string, volume string, issue string, page string,
issued struct<`date-parts`:array<array<bigint>>>, accessed struct<`date-parts`:array<array<bigint>>>, DOI string, URL string, ISBN string,
ISSN string, publisher string, `publisher-place` string, edition string, genre string, archive string, archive_location string, chapter string"""
PAGES = "doc_id long, page int, line_no int, y double, text string, items array<struct<str:string,x:double,width:double,height:double,italic:boolean>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def page_lines(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Page lines with geometry from JSON lines or Parquet."""
    return spark.read.schema(PAGES).json(path) if kind == "json" else spark.read.parquet(path)


def csl_items(spark: SparkSession, path: str) -> DataFrame:
    """CSL-JSON arrays with their ordinal in the file."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    items = F.from_json("value", f"array<struct<{_as_struct(CSL_ITEM)}>>")
    return whole.select("path", F.posexplode(items).alias("ordinal", "item")).select("path", "ordinal", "item.*")


def _as_struct(ddl: str) -> str:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[at:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            at = i + 1
    return ", ".join(out)


def records(items: DataFrame) -> DataFrame:
    """CSL items under the engine's record names; issued and accessed are dates as far as they are known (`functions.dates`)."""
    c = F.col
    issued = dates.of_parts(c("issued")["date-parts"])
    return items.select(
        *(x for x in ("path", "ordinal") if x in items.columns), "id", "type", "title", "author", F.lit(False).alias("author_etal"), "editor", c("container-title").alias("container"), "volume", "issue", "page",
        dates.year_of(issued).alias("year"), issued.alias("issued"), dates.of_parts(c("accessed")["date-parts"]).alias("accessed"), c("DOI").alias("doi"), c("URL").alias("url"), c("ISBN").alias("isbn"), "publisher", c("publisher-place").alias("place"), "genre", "edition",
    )


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry_no, text): paragraphs of text files, separated by blank lines."""
    whole = documents(spark, path)
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return whole.select("path", F.posexplode(paragraphs).alias("entry_no", "text"))
