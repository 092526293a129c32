"""A catalogue of manifests: scanned, ordered, searched, rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "title string, description string, created string, tags array<string>, _corrupt_record string"


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """(slug, title, description, created, tags) of manifests that parse and have a title and a description.

    The slug is the name of the folder that holds the manifest.
    """
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern).withColumn("_path", F.input_file_name())
    good = rows.filter("_corrupt_record is null and title <> '' and description <> ''")
    return good.select(F.regexp_extract("_path", r"([^/]+)/[^/]+\z", 1).alias("slug"), "title", "description", "created", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def newest_first(entries: DataFrame) -> DataFrame:
    """Newest first, undated last, then by slug."""
    return entries.orderBy(F.coalesce("created", F.lit("")).desc(), "slug")


def tag_list(entries: DataFrame, tags: str = "tags") -> DataFrame:
    return entries.select(F.explode(tags).alias("tag")).distinct().orderBy("tag")


def search(entries: DataFrame, query: str = "", wanted: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose title, description and tags hold the query (case ignored) and that have all wanted tags."""
    text = F.lower(F.concat_ws(" ", "title", "description", F.array_join("tags", " ")))
    return entries.filter(F.contains(text, F.lit(query.strip().lower())) & F.forall(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda t: F.array_contains("tags", t)))


def lookup(entries: DataFrame, slug: str | None) -> DataFrame:
    """The entry of that slug; without one, the first of the catalogue; for an unknown one, no row."""
    if slug:
        return entries.filter(F.col("slug") == slug)
    return newest_first(entries).limit(1)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cards(entries: DataFrame) -> DataFrame:
    """(slug, html, data): a list entry with escaped text, and its JSON safe to stand in a script element."""
    tag_items = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<li>"), escape_html(t), F.lit("</li>"))), "")
    card = F.concat(F.lit('<a href="'), escape_html(F.col("slug")), F.lit('/"><h2>'), escape_html(F.col("title")), F.lit("</h2><p>"), escape_html(F.col("description")), F.lit("</p><ul>"), tag_items, F.lit("</ul></a>"))
    data = F.replace(F.to_json(F.struct("slug", "title", "description", "created", "tags")), F.lit("</"), F.lit("<\\/"))
    return entries.select("slug", card.alias("html"), data.alias("data"))
