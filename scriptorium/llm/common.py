"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/scriptorium/{spark.sparkContext.applicationId}"


#: Whether the files of a query's shuffles go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, codec: str = "zstd", cleanup: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost no recomputation.

    The shuffles behind df have done their work then, and with `cleanup` their files go. What is written stays until the application's
    folder (`shared_dir`) is removed: a result that is read later may still need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, str(cleanup).lower())
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """names, each made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_order(df: DataFrame) -> Column:
    """Where a row stands among the rows of df: by the files that Spark wrote, else by partitions."""
    try:
        df.select("_metadata.file_name")
    except AnalysisException:  # not read from files
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(_metadata.file_name, '{pattern}', 1) as long)"), F.lit(0))
    return F.shiftleft(number("part-([0-9]+)") * 1000 + number("-c([0-9]+)[.]"), 36).bitwiseOR(F.col("_metadata.row_index"))


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, buckets: int = 1, bucket: Column | None = None) -> DataFrame:
    """Add `name`: a gapless 0-based rank inside each group of `keys`.

    A group is spread over `buckets` hash buckets of its order columns; rows are ranked inside a bucket and a bucket
    starts where those before it end. So no task ever holds a whole group, and the rank depends on the values alone.
    `keys` must not be null. A `bucket` that rises with the order makes the rank follow the order itself.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        df.withColumn("_inner", inner)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_inner"))
        .drop("_bucket", "_inner", "_start")
    )


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    return max(1, math.ceil(rows / per_bucket))


class DigestCache(dict):
    """word -> fixed-width packed digest, emptied when it holds `limit` words."""

    def __init__(self, make: Callable[[bytes], bytes], limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
