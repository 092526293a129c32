"""Reference records made from the keys and dates of `orders`, so that what the parser finds is known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("Abbott", "Brandt", "Castillo", "Dalgaard", "Eriksen", "Fontaine", "Grover", "Hoffmann", "Ibarra", "Janssen", "Kowalska", "Lundgren")
GIVEN = ("Ada", "Bruno", "Clara", "David", "Elena", "Frank", "Greta", "Hugo", "Irene", "Jonas", "Karin", "Louis")
TOPICS = ("Erosion", "Migration", "Sediments", "Turbines", "Glaciers", "Alloys", "Enzymes")
PLACES = ("Deltas", "Harbours", "Valleys", "Plateaus", "Forests")
JOURNALS = ("Coastal Records", "Applied Measures", "Northern Letters", "Urban Methods")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one part: a quarter of a minute's work for the longest queries.
PART_ROWS = 16_384


def part_count(df: DataFrame) -> int:
    """A number of parts that follows the rows of df, which are counted in the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key into parts whose number follows its rows, whatever files hold them and however many executors have come up yet.

    Windows and groups by key need no other exchange.
    """
    return df.repartition(part_count(df), key)


def pick(words: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), at.cast("int"))


def sql_pick(words: tuple[str, ...], at: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[1 + ({at})]"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (of 20 references), ordinal, id and the columns of a record, one per order."""
    k, doc = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 20).cast("long")
    person = lambda j: F.struct(pick(FAMILIES, (k + 5 * j) % 12).alias("family"), pick(GIVEN, (k + 7 * j) % 12).alias("given"), F.lit(None).cast("string").alias("literal"))
    authors = F.slice(F.array(person(0), person(1), person(2)), F.lit(1), (k % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    orders = spread(table(spark, sf_dir, "orders").select(doc.alias("doc_id"), "o_orderkey", "o_orderdate"), "doc_id")
    return orders.select(
        "doc_id", (k % 20).cast("int").alias("ordinal"), k.cast("long").alias("id"), F.lit("article-journal").alias("type"), authors.alias("author"), F.lit(False).alias("author_etal"),
        F.concat(F.lit("Study "), k.cast("string"), F.lit(" Into "), pick(TOPICS, k % 7), F.lit(" Across "), pick(PLACES, k % 5)).alias("title"), pick(JOURNALS, k % 4).alias("container"),
        (k % 90 + 1).cast("string").alias("volume"), (k % 11 + 1).cast("string").alias("issue"), F.concat_ws("-", (k % 100 + 100).cast("string"), (k % 100 + 300).cast("string")).alias("page"),
        F.year("o_orderdate").alias("year"), F.concat(F.lit("10.1000/ref."), k.cast("string")).alias("doi"), none.alias("url"), none.alias("publisher"), none.alias("place"), F.array().cast("array<struct<family:string,given:string,literal:string>>").alias("editor"), none.alias("genre"), none.alias("edition"),
    )


#: The same, for the oracle: scalar columns under the names the queries return.
RECORDS_SQL = f"""
SELECT o_orderkey // 20 AS doc_id, CAST(o_orderkey % 20 AS INTEGER) AS ordinal, o_orderkey AS id, o_orderkey AS k,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey % 90 + 1 AS VARCHAR) AS volume, CAST(o_orderkey % 11 + 1 AS VARCHAR) AS issue,
  CAST(o_orderkey % 100 + 100 AS VARCHAR) || '-' || CAST(o_orderkey % 100 + 300 AS VARCHAR) AS page,
  'Study ' || CAST(o_orderkey AS VARCHAR) || ' Into ' || {sql_pick(TOPICS, "o_orderkey % 7")} || ' Across ' || {sql_pick(PLACES, "o_orderkey % 5")} AS title,
  {sql_pick(JOURNALS, "o_orderkey % 4")} AS container, {sql_pick(FAMILIES, "o_orderkey % 12")} AS first_family, CAST(o_orderkey % 3 + 1 AS INTEGER) AS n_authors,
  '10.1000/ref.' || CAST(o_orderkey AS VARCHAR) AS doi
FROM orders
"""
