"""Substring deduplication by matching repeated blocks between content-defined anchors.

This stands in for a greedy relative Lempel-Ziv parsing: a document's factors are runs of blocks that stand elsewhere too, but no
places in a reference are kept, and no longest factor is looked for.

1. Anchors. In each window of `WINDOW` words the smallest hash of `GRAM` consecutive words is an anchor, so equal windows
   have equal anchors wherever they stand. About 2 / (WINDOW - GRAM + 2) of all positions are anchors.
2. Index. From each anchor a block reaches to the first later anchor that lets it hold every window that starts before
   the next anchor (its ends depend on its words alone). Blocks are counted by hash; of a repeated block, the first
   occurrence is its reference.
3. Factors. A document's consecutive repeated blocks are its factors: each lies in the reference, so every window in
   it is repeated.
4. Boundaries. Windows outside factors whose anchor is repeated may be repeated too: at a factor's ends, or in passages
   shorter than a block. Their hashes are compared with each other's and with those of the reference's windows.

Hashes that decide have 128 bits. Nothing is sampled: a repeated window has a repeated anchor, and so is found in 3 or 4.
Counts are pre-aggregated by task and joined back by equi-joins that adaptive execution can split, so a passage that a
third of all documents share costs one row a document and place.

Defined results: null and empty texts have no words, nothing removed, and the hash of the empty string. Documents below
`WINDOW` words lose nothing. Repeated rows (equal id and text) remove each other's windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import DigestCache, materialize, ship

WINDOW, GRAM = 35, 12
_REACH = WINDOW - GRAM  # 23: the last gram of a window starts so far after the window
_CHUNK = 150_000  # words looked at together
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)

_words = DigestCache(lambda word: xxhash.xxh3_128_digest(word)[:16])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * _CHUNK), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over a[i : i + width] for each i."""
    out, have = a, 1
    while have * 2 <= width:
        out, have = f(out[:-have], out[have:]), have * 2
    rest = width - have
    return f(out[:-rest], out[rest:]) if rest else out


class Parsed:
    """Some documents' words, one after another, with anchors and hashes of stretches."""

    def __init__(self, texts: list[list[bytes]]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.ends[-1]) if len(texts) else 0
        self.n = n
        pairs = np.frombuffer(b"".join([b"".join(map(_words.__getitem__, t)) for t in texts]), "<u8").reshape(-1, 2)
        self.sums = []
        for side, base in enumerate(_BASES):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(pairs[:, side] * _power(base, n), dtype=np.uint64)]))
        end_of = np.repeat(self.ends, self.sizes)
        at = np.arange(n)
        self.window_ok = at + WINDOW <= end_of
        none = np.uint64(np.iinfo(np.uint64).max)
        grams = np.full(n + _REACH, none, np.uint64)
        ok = np.flatnonzero(at + GRAM <= end_of)
        g = self.stretch(ok, ok + GRAM, 0)
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams[ok] = (g ^ (g >> np.uint64(32))) | np.uint64(1)
        self.grams = grams[:n]
        if n < WINDOW:
            self.least = np.zeros(n, np.uint64)
            self.anchors = np.empty(0, np.int64)
        else:
            self.least = _sliding(grams, _REACH + 1, np.minimum)
            reach = np.concatenate([np.zeros(_REACH, np.uint64), np.where(self.window_ok, self.least, np.uint64(0))])
            self.anchors = np.flatnonzero(_sliding(reach, _REACH + 1, np.maximum) == self.grams)
        self.anchor_doc = np.searchsorted(self.ends, self.anchors, "right")
        per_doc = np.bincount(self.anchor_doc, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
        self.first_anchor = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)

    def stretch(self, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        """Hashes of words a to b."""
        sums = self.sums[side]
        return (sums[b] - sums[a]) * _power(_INVERSES[side], self.n + 1)[a]

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor, the hash of its block (0 if none) and where the next anchor is."""
        p, doc = self.anchors, self.anchor_doc
        if len(p) < 2:
            return np.zeros(len(p), np.uint64), p
        following = np.append(p[1:], p[-1])
        last = np.searchsorted(p, following + _REACH)
        inside = np.minimum(last, len(p) - 1)
        ok = (last < len(p)) & (doc[inside] == doc) & (np.append(doc[1:], -1) == doc)
        out = np.zeros(len(p), np.uint64)
        a, b = p[ok], p[inside[ok]] + GRAM
        out[ok] = (self.stretch(a, b, 0) ^ (self.stretch(a, b, 1) << np.uint64(1))) + (following - p)[ok].astype(np.uint64) * np.uint64(_BASES[1]) | np.uint64(1)
        return out, following


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Parsed, list[list[bytes]]]]:
    """(first row, row after the last, parsed, words) over a batch, some documents at a time."""
    texts, size, first = [], 0, 0
    column = batch.column("text")
    for i in range(len(column)):
        words = (column[i].as_py() or "").encode("utf-8", "surrogatepass").split()
        texts.append(words)
        size += len(words)
        if size >= _CHUNK or i + 1 == len(column):
            yield first, i + 1, Parsed(texts), texts
            texts, size, first = [], 0, i + 1


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, parsed, texts in _chunks(batch):
            hashes, _ = parsed.blocks()
            whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b], batch.column("h")[a:b], pa.array(parsed.sizes), pa.array(whole, pa.string()),
                    _lists(parsed.first_anchor, _signed(parsed.grams[parsed.anchors]), pa.int64()), _lists(parsed.first_anchor, _signed(hashes), pa.int64()),
                ],
                ["doc_id", "h", "n_words", "whole_sha256", "grams", "blocks"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with repeated anchors (marks): the starts covered by factors, and the hashes of windows to compare."""
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        for a, b, parsed, _ in _chunks(batch):
            _, following = parsed.blocks()
            rows = [(parsed.first_anchor[i] + m["k"], m["solid"], m["reference"]) for i, ms in enumerate(marks[a:b]) for m in ms]
            at, solid, reference = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))
            known = np.unique(parsed.grams[parsed.anchors[at]])
            found = known[np.minimum(np.searchsorted(known, parsed.least[: parsed.n]), len(known) - 1)] == parsed.least[: parsed.n] if len(known) else np.zeros(parsed.n, bool)

            def covered(which: np.ndarray, parsed=parsed, following=following, at=at) -> np.ndarray:
                steps = np.zeros(parsed.n + 2, np.int64)
                np.add.at(steps, parsed.anchors[at[which]], 1)
                np.add.at(steps, following[at[which]] + 1, -1)
                return np.cumsum(steps)[: parsed.n] > 0

            inside = covered(solid.astype(bool)) & parsed.window_ok
            still_open = found & parsed.window_ok & ~inside
            wanted = np.flatnonzero(still_open | covered(reference.astype(bool)) & parsed.window_ok)
            edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
            begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
            # factors end with their document: its last window starts before its end
            doc_w, doc_f = np.searchsorted(parsed.ends, wanted, "right"), np.searchsorted(parsed.ends, begins, "right")
            count = lambda d, k=b - a: np.concatenate([[0], np.cumsum(np.bincount(d, minlength=k))])
            keep = (np.bincount(doc_w, minlength=b - a) + np.bincount(doc_f, minlength=b - a)) > 0
            table = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b], batch.column("h")[a:b], batch.column("text")[a:b],
                    _lists(count(doc_f), begins - parsed.starts[doc_f], pa.int32()), _lists(count(doc_f), stops - parsed.starts[doc_f], pa.int32()),
                    _lists(count(doc_w), wanted - parsed.starts[doc_w], pa.int32()), _lists(count(doc_w), still_open[wanted], pa.bool_()),
                    _lists(count(doc_w), _signed(parsed.stretch(wanted, wanted + WINDOW, 0)), pa.int64()),
                    _lists(count(doc_w), _signed(parsed.stretch(wanted, wanted + WINDOW, 1)), pa.int64()),
                ],
                ["doc_id", "h", "text", "factor_from", "factor_to", "at", "open", "h1", "h2"],
            )
            yield table.filter(pa.array(keep))


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, h, text, a, b, more in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "factor_from", "factor_to", "more")), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, a.values.to_numpy(), 1)
                np.add.at(steps, b.values.to_numpy() + WINDOW, -1)
                if more.is_valid:
                    np.add.at(steps, more.values.to_numpy(), 1)
                    np.add.at(steps, more.values.to_numpy() + WINDOW, -1)
                keep = np.cumsum(steps)[:-1] == 0
                left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                row = (doc_id.as_py(), h.as_py(), len(words) - int(keep.sum()), hashlib.sha256(left).hexdigest())
                out.append((*row, left.decode("utf-8", "replace")) if with_text else row)
            names = ["doc_id", "h", "removed", "sha", *["kept_text"] * with_text]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(names), types, strict=False)], names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text (null: all words stay)."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    parsed = materialize(
        named.mapInArrow(_anchor_rows, "doc_id long, h long, n_words long, whole_sha256 string, grams array<long>, blocks array<long>"), "anchors"
    )
    anchors = parsed.select("doc_id", "h", F.posexplode(F.arrays_zip("grams", "blocks")).alias("k", "a")).select(
        "doc_id", "h", "k", F.col("a.grams").alias("g"), F.col("a.blocks").alias("b")
    )
    # both written out: joins of plain tables, which adaptive execution splits where one passage is hot
    repeated = materialize(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "repeated")
    shared = materialize(anchors.join(repeated, "g"), "shared")
    index = shared.filter("b <> 0").groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "k")).alias("first")).filter("n > 1").drop("n")
    index = materialize(index, "index")
    marked = shared.join(index, ["g", "b"], "left").select(
        "doc_id", "h", F.struct("k", F.col("first").isNotNull().alias("solid"), F.coalesce(F.col("first") == F.struct("doc_id", "h", "k"), F.lit(False)).alias("reference")).alias("mark")
    )
    marks = marked.groupBy("doc_id", "h").agg(F.collect_set("mark").alias("marks"))  # of one document: no more than its words
    spans = "factor_from array<int>, factor_to array<int>"
    windows = materialize(
        named.join(marks, ["doc_id", "h"]).mapInArrow(_window_rows, f"doc_id long, h long, text string, {spans}, at array<int>, open array<boolean>, h1 array<long>, h2 array<long>"),
        "windows",
    )
    each = windows.select("doc_id", "h", F.explode(F.arrays_zip("at", "open", "h1", "h2")).alias("w")).select("doc_id", "h", "w.*")
    again = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    more = each.filter("open").join(again, ["h1", "h2"]).groupBy("doc_id", "h").agg(F.collect_set("at").alias("more"))
    touched = windows.select("doc_id", "h", "text", "factor_from", "factor_to").join(more, ["doc_id", "h"], "left")
    touched = touched.filter(F.col("more").isNotNull() | (F.size("factor_from") > 0)).dropDuplicates(["doc_id", "h"])
    result = touched.mapInArrow(_kept(with_text), "doc_id long, h long, removed long, sha string" + ", kept_text string" * with_text)
    return parsed.select("doc_id", "h", "n_words", "whole_sha256").join(result, ["doc_id", "h"], "left").select(
        F.expr(f"nullif(doc_id, {-(1 << 63) + 1} - 1)").alias("doc_id"), "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("sha", "whole_sha256").alias("kept_sha256"), *["kept_text"] * with_text,
    )
