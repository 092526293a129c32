"""Best-fit packing by minimum bin slack.

Documents are tokenised and cut where they are longer than a sequence: the first piece takes the remainder, so all
others fill a sequence each. What is left to pack is a histogram of at most `capacity` lengths. The bin plan comes from
that histogram: the longest length opens a bin, a bitset subset-sum over the available lengths finds the fullest
combination for the rest, and the combination is removed as often as its lengths last. Applying a pattern uses up one of
its lengths below the multiplicity it was used with, so there are at most sum(capacity / length) < 8 * capacity patterns
whatever the input. Pieces find their place by their rank among pieces of equal length.

Defined results: a null text is an empty one, which has one token (the end mark). Documents with equal ids are told apart
by checksum and length; equal rows take places of their own. An empty table gives no rows. Other columns are ignored.

Pieces of equal length are ranked by a hash of their values. With `in_order` they are ranked by the order in which the
documents are stored, and sequences are numbered by the document of their first piece.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import DigestCache, buckets_for, materialize, row_order, salted_rank, ship

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """(encode a text to packed ids, cache of words with a leading space, strings of added tokens)

    A vocabulary that also lies there as ranks encodes single words by those: equal ids without the cost of offsets.
    """
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

        def packed(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        def word(text: str) -> bytes:
            return packed(" " + text)

        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            lines = (line.split() for line in ranks.read_bytes().splitlines())
            by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(t): int(r) for t, r in lines}, special_tokens={})

            def word(text: str) -> bytes:
                return array("I", by_rank.encode_ordinary(" " + text)).tobytes()

        _loaded[path] = packed, DigestCache(word, 400_000), added
    return _loaded[path]


def encode(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers.

    A space before a non-space always opens a new word of the tokenizer, so a text without runs of white space around
    spaces or strings of added tokens is the sequence of its space-led words, and frequent words are looked up rather than encoded again.
    """
    packed, words, added = _encoder(path)
    first, *rest = text.split(" ")
    if any(t in text for t in added) or not all(rest) or any(w[0].isspace() for w in rest):
        return packed(text)
    return packed(first) + b"".join(map(words.__getitem__, rest))


def _pieces(path: str, capacity: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "at")}
            for doc_id, text, place in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("at").to_pylist(), strict=True):
                ids = encode(text.as_py() or "", path) + mark
                n = len(ids) // 4
                at, length, piece = 0, n % capacity or capacity, 0
                while at < n:
                    for k, v in zip(rows, (doc_id, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), place), strict=True):
                        rows[k].append(v)
                    at, length, piece = at + length, capacity, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return run


def fullest(counts: dict[int, int], room: int) -> Counter:
    """Of available lengths, a combination whose sum is the largest that fits into `room`."""
    reach, steps = 1, []
    keep = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & keep
            left, take = left - take, take * 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return chosen


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """[(times, {length: number in one bin})] that uses the whole histogram."""
    counts, plan = dict(histogram), []
    while counts:
        largest = max(counts)
        pattern = Counter({largest: 1})
        rest = counts | {largest: counts[largest] - 1}
        pattern += fullest({k: v for k, v in rest.items() if v}, capacity - largest)
        times = min(counts[k] // m for k, m in pattern.items())
        plan.append((times, pattern))
        for k, m in pattern.items():
            counts[k] -= times * m
            if not counts[k]:
                del counts[k]
    return plan


def _placer(plan: list[tuple[int, Counter]]):
    """Per length, where the ranks taken by each pattern begin, and what is needed to place one of them."""
    taken: Counter = Counter()
    steps, sequence = [], 0
    for times, pattern in plan:
        offset = 0
        for length, m in sorted(pattern.items(), reverse=True):
            steps.append((length, taken[length], sequence, m, offset))
            taken[length] += times * m
            offset += length * m
        sequence += times
    steps = np.array(sorted(steps), np.int64).reshape(-1, 5)
    lengths = steps[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.empty(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(lengths, [x, x + 1])
                mine = length == x
                row[mine] = lo + np.searchsorted(steps[lo:hi, 1], rank[mine], "right") - 1
            _, begin, first, m, offset = steps[row].T if len(row) else np.empty((5, 0), np.int64)
            nth = rank - begin
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "at")), pa.array(first + nth // np.maximum(m, 1)), pa.array(offset + nth % np.maximum(m, 1) * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "at", "sequence_id", "offset"],
            )

    return run


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, at long"
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _numbered_in_order(placed: DataFrame, bucket: Column) -> DataFrame:
    """Sequences numbered anew: one whose first piece is of an earlier document comes earlier."""
    placed = materialize(placed, "placed")
    heads = placed.filter("offset = 0").select("sequence_id", "at", "piece")  # one a sequence
    numbers = salted_rank(heads, [], ["at", "piece", "sequence_id"], "number", bucket=bucket).select("sequence_id", "number")
    return placed.join(numbers, "sequence_id").drop("sequence_id").withColumnRenamed("number", "sequence_id")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 1024, end: int = 2, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    at = row_order(docs) if in_order else F.lit(0).cast("long")
    pieces = docs.select(F.col("doc_id").cast("long"), "text", at.alias("at")).mapInArrow(_pieces(str(tokenizer_path), capacity, end), SCHEMA)
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    bucket, order = F.shiftright("at", 14), ["doc_id", "piece", "ids_crc32"]  # 16,384 documents
    if in_order:
        ranked = salted_rank(pieces, ["length"], ["at", *order], "rank", bucket=bucket)
    else:
        ranked = salted_rank(pieces, ["length"], order, "rank", buckets_for(sum(histogram.values())))
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at", F.col("rank").cast("long").alias("rank")).mapInArrow(
        _placer(bin_plan(histogram, capacity)), SCHEMA + ", sequence_id long, offset long"
    )
    return (_numbered_in_order(placed, bucket) if in_order else placed).select(*COLUMNS)
