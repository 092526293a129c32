"""In-text citations: found, counted by page and kind, accumulated, and checked against the reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.cite import mentions

_YEAR = r"(?:19|20)\d{2}[a-z]?"
_NAME = r"[A-ZÀ-ɏ][\w'’À-ɏ-]+"
#: kind -> expression of one citation
PATTERNS = {
    "bracket": r"\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]",
    "paren_number": r"\(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\)",
    "superscript": "[⁰¹²³⁴-⁹]+(?:[,–⁻][⁰¹²³⁴-⁹]+)*",
    "author_year": rf"\((?:[^()]*?\b{_NAME}[^()]*?,?\s+{_YEAR})+[^()]*\)",
    "narrative": rf"{_NAME}(?:\s+et al\.|\s+(?:and|&)\s+{_NAME})?\s+\({_YEAR}(?:\s*[,–-]\s*(?:{_YEAR}|[a-z]{{1,2}}))*\)",
}
NUMERIC = ("bracket", "paren_number", "superscript")


def before_references(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines before the reference section, if the document has one."""
    from scriptorium.operators.parse import HEADING

    start = F.max(F.when(F.col("line").rlike(HEADING), F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("_start", start).filter(F.col("_start").isNull() | (F.col("line_no") < F.col("_start"))).drop("_start")


def citations(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(keys, kind, citation): one row per citation found."""
    def of(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), 0), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("citation")))

    found = F.flatten(F.array(*map(of, kinds)))
    return pages.select(*keys, F.explode(found).alias("c")).select(*keys, "c.*")


def per_page(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    return found.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def detect_kind(counts: DataFrame, key: str = "doc_id", forced: str | None = None) -> DataFrame:
    """(key, kind): the most frequent kind of a document; ties go to the first in alphabetical order."""
    if forced:
        return counts.select(key).distinct().withColumn("kind", F.lit(forced))
    sums = counts.groupBy(key, "kind").agg(F.sum("n").alias("n"))
    return sums.groupBy(key).agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), "kind")).alias("kind"))


def cumulative(counts: DataFrame, key: str = "doc_id", page: str = "page", n: str = "n") -> DataFrame:
    """Add the running total over a document's pages."""
    order = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("running", F.sum(n).over(order))


def cited_numbers(citation: Column) -> Column:
    """The numbers that a numeric citation names, with ranges filled in."""
    plain = F.translate(citation, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
    parts = F.split(F.regexp_replace(plain, r"[\[\]()\s]", ""), ",")
    ends = F.transform(parts, lambda p: F.split(p, "[–-]"))
    return F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.get(e, F.lit(0)).cast("int"), F.greatest(F.get(e, F.lit(0)).cast("int"), F.element_at(e, -1).cast("int"))))))


def cited_names(citation: Column) -> Column:
    """array<struct<family, year>> of an author-year citation: the first name and the year of every reference it means."""
    pair = lambda m: F.struct(F.get(m["names"], F.lit(0))["family"].alias("family"), m["year"].cast("string").alias("year"))
    return F.filter(F.transform(mentions(citation), pair), lambda x: x["year"].isNotNull())


def cross_check(cited: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """(on, times, status): `ok`, `not listed` or `not cited`, by a full join of what is cited and what is listed."""
    c = cited.groupBy(*on).agg(F.count(F.lit(1)).alias("times"))
    r = listed.select(*on).distinct().withColumn("_listed", F.lit(True))
    out = c.join(r, on, "full_outer")
    status = F.when(F.col("_listed").isNull(), "not listed").when(F.col("times").isNull(), "not cited").otherwise("ok")
    return out.select(*on, F.coalesce("times", F.lit(0)).alias("times"), status.alias("status"))


def density(pages: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, citations, per_1000_words)"""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    totals = pages.groupBy(key).agg(F.sum(words).alias("words"))
    counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("citations"))
    out = totals.join(counted, key, "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    return out.withColumn("per_1000_words", F.round(1000.0 * F.col("citations") / F.nullif(F.col("words"), F.lit(0)), 4))


def year_histogram(found: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(year, n) of citations: the year in an author-year citation, the listed reference's year for a numeric one."""
    direct = found.filter(~F.col("kind").isin(*NUMERIC)).select(F.explode(cited_names(F.col("citation"))).alias("c")).select(F.col("c.year").cast("int").alias("year"))
    numbered = found.filter(F.col("kind").isin(*NUMERIC)).select(key, F.explode(cited_numbers(F.col("citation"))).alias("number"))
    looked_up = numbered.join(refs.select(key, F.col("number"), F.col("year")), [key, "number"]).select("year")
    return direct.union(looked_up).filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
