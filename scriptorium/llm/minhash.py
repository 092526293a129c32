"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once. The hash's upper part names one of `BINS` bins, the rest is the value the bin
takes the minimum of. Empty bins are filled by optimal densification: bin i asks bins h(i, 1), h(i, 2), ... of a 2-universal
family until one is not empty, and takes its value, so two texts that share the donor agree in the copy too. The
low `LOW` bits of every bin are kept. Two unequal values agree in them with probability 2^-LOW, which the likeness
corrects: (m - c) / (1 - c) for a share m of agreeing bins and c = 2^-LOW, not below 0.

Defined results: a text of fewer than five words has one shingle, all its words; a text without words (null and empty
ones too) has one shingle of its own, so such texts are alike to each other and to nothing else. Texts that differ in
white space only have equal fingerprints.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import DigestCache, materialize, ship, shuffle_partitions

BINS, LOW, SHINGLE = 256, 8, 5
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Donors asked in one round; rounds go on until every bin has met a filled one.
_ATTEMPTS = 64

_words = DigestCache(lambda word: xxhash.xxh64_intdigest(word, 3).to_bytes(8, "little"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _donors(round_: int) -> np.ndarray:
    """Of every bin, the donors it asks in a round, in their order."""
    asked = np.arange(round_ * _ATTEMPTS + 1, (round_ + 1) * _ATTEMPTS + 1, dtype=np.uint64)
    start = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(_ATTEMPTS)
    return ((_mix(start + asked * _MULTIPLY) >> np.uint64(11)) % np.uint64(BINS)).astype(np.int64)


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.array([_MULTIPLY], np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), "<u8")
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = _mix(out * _MULTIPLY + h[i : i + n] + np.uint64(1))
    return out


def signature(text: str) -> np.ndarray:
    """BINS bytes: the low bits of each bin."""
    h = shingle_hashes(text)
    bins = (h >> np.uint64(64 - 8)).astype(np.int64)
    best = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, bins, h & np.uint64((1 << 56) - 1))
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    empty, round_ = np.flatnonzero(~filled), 0
    while len(empty):
        donors = _donors(round_)[empty]
        usable = filled[donors]
        met = usable.any(1)
        best[empty[met]] = best[donors[met, usable[met].argmax(1)]]
        empty, round_ = empty[~met], round_ + 1
    return (best & np.uint64((1 << LOW) - 1)).astype(np.uint8)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    chance = 2.0**-LOW
    return max(0.0, (float((one == other).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many characters (or all) of the following text's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _first_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = None
    for b in batches:
        if b.num_rows:
            x = int(b.column("at").to_numpy().min())
            least = x if least is None else min(x, least)
    if least is not None:
        yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64())], ["at"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (part, tail, at): every row that is no tail, with the row after it."""
    held = None  # (part, doc_id, text, signature)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(before, text: str, sig: np.ndarray) -> tuple:
        _, doc_id, own, mine = before
        new = edited(own, text)
        there = signature(new)
        pack = lambda s: base64.b64encode(s.tobytes()).decode()
        return doc_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), pack(mine), pack(there), likeness(mine, there), likeness(mine, sig)

    for b in batches:
        out = []
        for part, tail, doc_id, text in zip(b.column("part").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py() or ""
            sig = signature(text)
            if held and held[0] == part:
                out.append(row(held, text, sig))
            held = None if tail else (part, doc_id, text, sig)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(names), types, strict=True)], names)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger doc_id (after the last, the first). Rows are dealt to ranges of
    ids; the first row of each range is sent to the range before it as well, so no row is missing its follower and no
    order of the whole table is needed. Rows of one id stand in an order of their texts' hashes. A null id counts as the
    smallest; an id is expected to be repeated a few times at most.
    """
    spark = docs.sparkSession
    ship(spark)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    parts = shuffle_partitions(spark)
    # Range bounds: the least id of each of `parts` partitions, from the ids alone.
    ids = docs.select(at.alias("at"))
    firsts = ids.repartitionByRange(parts, "at").mapInArrow(_first_ids, "at long").limit(parts).collect()
    bounds = np.array(sorted({r["at"] for r in firsts}), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right") - 1).astype("int32")

    n = max(1, len(bounds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.alias("at"))
    rows = rows.withColumn("part", part_of("at")).withColumn("h", F.xxhash64("text"))
    # Which row comes first in a range: from the ids and hashes of the few rows that have its least id.
    starts = spark.createDataFrame([(int(x),) for x in bounds], "at long")  # one row a partition
    opens = rows.select("part", "at", "h").join(F.broadcast(starts), "at").groupBy("part", "at").agg(F.min("h").alias("h"))
    opens = materialize(opens, "openings")
    # One row a range: bounded by the number of partitions.
    tails = rows.join(F.broadcast(opens), ["part", "at", "h"], "left_semi").dropDuplicates(["part"])
    tails = tails.withColumn("part", F.pmod(F.col("part") - 1, F.lit(n)).cast("int"))
    every = rows.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    dealt = every.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", "at", "h")
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
