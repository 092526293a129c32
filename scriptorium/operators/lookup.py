"""Items looked up by key, at any size of the index and however often one key is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an index that is sent to all tasks whole.
SMALL = 100_000
#: A key is hot from this share of all rows on; there are fewer hot keys than this.
SHARE = 1000


def by_key(cited: DataFrame, items: DataFrame, cited_key: str = "ref", item_key: str = "id", small: int = SMALL) -> DataFrame:
    """cited with the columns of the item that its key names; rows without one have nulls.

    items: one row a key. An index of at most `small` rows (counted first) is broadcast. Else hot keys, each with more than a thousandth
    of the rows of cited, are looked up in a broadcast of their own items, which is fewer than a thousand rows, and all other
    keys by a shuffle, where none of them is more than that share. Null keys find nothing.
    """
    if items.limit(small + 1).count() <= small:
        return _joined(cited, F.broadcast(items), cited_key, item_key)
    counts = cited.groupBy(cited_key).agg(F.count(F.lit(1)).alias("_n"))
    total = cited.count()
    hot = counts.filter((F.col("_n") * SHARE > total) & F.col(cited_key).isNotNull()).select(F.col(cited_key).alias("_hot"))
    own = items.join(F.broadcast(hot), F.col(item_key) == F.col("_hot"), "left_semi")  # fewer than SHARE keys
    is_hot = cited.join(F.broadcast(hot), F.col(cited_key) == F.col("_hot"), "left")
    often = is_hot.filter("_hot is not null").drop("_hot")
    seldom = is_hot.filter("_hot is null").drop("_hot")
    # null keys go beside the join: they would meet in one task
    none = F.col(cited_key).isNull()
    return (
        _joined(often, F.broadcast(own), cited_key, item_key)
        .unionByName(_joined(seldom.filter(~none), items, cited_key, item_key))
        .unionByName(seldom.filter(none), allowMissingColumns=True)
    )


def _joined(cited: DataFrame, items: DataFrame, cited_key: str, item_key: str) -> DataFrame:
    on: Column = F.col(f"c.{cited_key}") == F.col(f"i.{item_key}")
    return cited.alias("c").join(items.alias("i"), on, "left").drop(F.col(f"i.{item_key}"))
