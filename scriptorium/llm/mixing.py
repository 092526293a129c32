"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows are cut into blocks. While the same sources are active, block j of a source with weight w (normalised
over the active ones) is released at slot floor((j - 1) / w) and due at slot ceil(j / w); the released block with the
earliest deadline goes next. On one processor that schedule meets every deadline, so after any number of blocks a source
is less than one block away from its share. When a source runs out, the weights of the others are normalised anew and
their windows start again from there, so no row is left out.

Blocks are single rows, whatever the input. With whole weights a phase repeats its first sum(weights) slots, so one period
a phase is worked out, from one count per weighted class, and a row finds its period and slot by arithmetic. There are at
most as many phases as classes. Sources without a weight of their own form one class, "*".

Defined results: a null source belongs to "*". Ties of deadlines go to the class named first in the weights. A class of
weight 0 comes after all others. Within a source, rows come in an order of their id's hash; repeated rows take positions
of their own. An empty table gives no rows. Other columns are ignored by `mix_positions`, kept by `mixed`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import buckets_for, materialize, salted_rank, shuffle_partitions, spare_names

#: Production shares; "*" stands for all other sources together.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, "src3": 2, "src4": 2, "*": 8}


def pfair_order(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(class, block, release, deadline, phase) in scheduled order; release and deadline count from the phase's start."""
    left = {k: n for k, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out, phase = [], 0
    while left:
        active = {k: Fraction(weights.get(k, 0)) for k in left}
        total = sum(active.values())
        share = {k: w / total if total else Fraction(1, len(active)) for k, w in active.items()}
        now, nth = 0, dict.fromkeys(left, 1)
        while True:
            windows = [(math.ceil(nth[k] / w), i, k, (nth[k] - 1) // w) for i, (k, w) in enumerate(share.items()) if w]
            due, _, k, release = min(x for x in windows if x[3] <= now)
            out.append((k, done[k], release, due, phase))
            done[k], nth[k], now = done[k] + 1, nth[k] + 1, now + 1
            left[k] -= 1
            if not left[k]:
                del left[k]
                phase += 1
                break
    return out


def pfair_phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[tuple[dict[str, tuple[int, int, list[tuple[int, int, int]]]], int, int]]:
    """A phase at a time: ({class: (its first block, its blocks, [(slot, release, deadline)] of one period)}, period, slots).

    The same schedule as pfair_order, of which it takes one period a phase.
    """
    left = {k: n for k, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    while left:
        active = {k: weights.get(k, 0) for k in left if weights.get(k, 0)} or dict.fromkeys(left, 1)
        shared = math.gcd(*active.values())
        active = {k: w // shared for k, w in active.items()}
        period = sum(active.values())
        slots: dict[str, list] = {k: [] for k in active}
        # a class has had its weight at the end of a period, so twice as many blocks can't run out in the first
        for slot, (k, _, release, due, _) in enumerate(pfair_order({k: 2 * w for k, w in active.items()}, active)[:period]):
            slots[k].append((slot, int(release), int(due)))
        length = min((left[k] - 1) // w * period + slots[k][(left[k] - 1) % w][0] + 1 for k, w in active.items())
        taken = {k: length // period * w + sum(x[0] < length % period for x in slots[k]) for k, w in active.items()}
        yield {k: (done[k], taken[k], slots[k]) for k in active if taken[k]}, period, length
        for k, n in taken.items():
            done[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}


def mix_positions(docs: DataFrame, weights: Mapping[str, int] | None = None, blocks: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, mix_class, block, release, deadline, phase, position.

    A block is one row, or so many that there are about `blocks` blocks.
    """
    weights = dict(WEIGHTS if weights is None else weights)
    spark = docs.sparkSession
    source = F.col(source_col)
    named = [k for k in weights if k != "*"]
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.when(source.isin(named), source).otherwise("*").alias("mix_class"))
    counts = {r["mix_class"]: r["n"] for r in rows.groupBy("mix_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a weight
    total = sum(counts.values())
    size = max(1, math.ceil(total / blocks)) if blocks else 1
    start, plan, left = 0, [], dict(counts)
    for phase, (classes, period, length) in enumerate(pfair_phases({k: math.ceil(counts[k] / size) for k in [*named, "*"] if k in counts}, weights)):
        for k, (first, n, slots) in classes.items():
            plan.append((k, phase, first, first + n, start, period, slots))
        # only the block that ends a phase can be short: it is the last of its class
        taken = {k: min(left[k], n * size) for k, (_, n, _) in classes.items()}
        left = {k: n - taken.get(k, 0) for k, n in left.items()}
        start += sum(taken.values())
    plan_df = spark.createDataFrame(
        plan, "plan_class string, phase int, from_block long, to_block long, start long, period long, slots array<struct<slot:long,release:long,deadline:long>>"
    )
    ranked = salted_rank(rows, ["mix_class"], ["doc_id", "source"], "nth", buckets_for(total)).withColumn("block", F.expr(f"nth div {size}"))
    placed = ranked.join(F.broadcast(plan_df), F.expr("mix_class = plan_class and block >= from_block and block < to_block"))
    placed = placed.withColumn("_at", F.get("slots", F.expr("cast((block - from_block) % size(slots) as int)")))
    placed = placed.withColumn("_before", F.expr("(block - from_block) div size(slots) * period"))
    return placed.select(
        "doc_id", "source", "mix_class", "block",
        (F.col("_before") + F.col("_at.release")).alias("release"), (F.col("_before") + F.col("_at.deadline")).alias("deadline"), "phase",
        (F.col("start") + (F.col("_before") + F.col("_at.slot")) * size + F.col("nth") % size).alias("position"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, blocks: int | None = None) -> DataFrame:
    """All rows of docs, columns unchanged, dealt and sorted so that the rows read in file order are the mix."""
    key, at = spare_names(docs, "_key", "_at")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # one position an id: ids are unique where this follows deduplication, else rows of one id stand together
    places = mix_positions(docs, weights, blocks).groupBy(named.alias(key)).agg(F.min("position").alias(at))
    places = materialize(places, "places")
    # dealt by key at any size, so that the plan of a small table is that of a large one
    placed = docs.withColumn(key, named).join(places.hint("merge"), key).select(*docs.columns, key, at)
    rows, parts = places.count(), shuffle_partitions(docs.sparkSession)
    part = F.expr(f"cast({at} * {parts} div {max(1, rows)} as int)")
    return placed.repartitionById(parts, part).sortWithinPartitions(at, F.xxhash64("text")).drop(key, at)
