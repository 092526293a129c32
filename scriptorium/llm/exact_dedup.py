"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Copies meet in three steps, and each groups by the whole normalised text beside its digest, so that equal digests alone
never merge two texts: (1) inside a task, by the partial aggregation; (2) among the rows of one salt, so that a text
with a third of all rows is spread over `salts` groups; (3) among the winners of the salts, at most `salts` rows a text
and task. Rows learn their winner by a join on the digest, which adaptive execution splits where one digest is hot: (3)
has counted the contents of a digest, so a digest with one content needs no second look, and the rows of a digest with
several are joined by their whole content.

Defined results: null text counts as empty, so all of them form one group. A null id never wins over another id. Where
one id is repeated with equal texts, one of the repeated rows is kept. An empty table gives no rows. Other columns are
ignored by `exact_groups` and returned unchanged by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, spare_names

#: A run of white space that is not one space already.
RUN = r"(?: *[\t-\r]| {2})[ \t-\r]*"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "norm"
    )
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # How many contents a digest has: where it is one, all rows of the digest have been compared and are equal.
    thin = merged.select("digest", F.xxhash64("norm").alias("content"), F.octet_length("norm").alias("len"), "keep_id", "group_size")
    found = materialize(thin.withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("digest"))), "winners", cleanup=False)
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    ids = rows.select("doc_id", "digest").withColumn("nth", nth).join(found.filter("contents = 1"), "digest")
    out = ("doc_id", "keep_id", "group_size", "nth", "digest")
    found_ids = ids.select(*out)
    if not found.filter("contents > 1").isEmpty():  # unlike texts of one digest: their rows are compared by content once more
        clashing = merged.join(found.filter("contents > 1").select("digest").distinct(), "digest", "left_semi")
        again = rows.join(clashing, ["digest", "norm"]).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "digest", "norm").orderBy(F.lit(1))))
        found_ids = found_ids.union(again.select(*out))
    return found_ids.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = 32) -> DataFrame:
    """docs without later copies of a text; columns unchanged."""
    key, sha = spare_names(docs, "_key", "_sha")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = exact_groups(docs, salts=salts).filter("kept").select(named.alias(key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(key, named).withColumn(sha, F.sha2(normalized(F.col("text")), 256))
    # The semi join is dealt by id and digest, and so serves the removal of repeated rows too.
    return keyed.join(kept, [key, sha], "left_semi").dropDuplicates([key, sha]).drop(key, sha)
