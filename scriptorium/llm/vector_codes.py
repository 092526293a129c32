"""Product codes of vectors: a codebook for each part position, searched through ball trees.

Every component x becomes the integer floor(1024 x); a vector is cut into `PARTS` consecutive parts; each part position has
a codebook of at most `ENTRIES` integer entries, refined over `ROUNDS` rounds of assignment and averaging.

The nearest entry is found by metric branch and bound in a ball tree over the entries of a part position. A ball has an
integer centre and a radius rounded up; a part looks at a ball if the distance to its centre, rounded down, less the radius is not
above the best distance so far, rounded up. Balls that could only tie are looked at too. Roots serve that bound alone: entries
are compared by exact integer squared distances, ties to the lower index. Parts go through the tree in chunks, one step
of a chunk per ball.

One pass over the vectors is made per round; it yields sums and counts per partition and entry, which Spark adds up. The
codebooks (PARTS x ENTRIES rows) are all that the driver holds.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped, as are vectors of another length
than that of the least kept (vec_id, vector). A null vec_id is kept, and comes after all others. A codebook starts from the least distinct vec_ids, of
a repeated one the least vector; with fewer than ENTRIES ids it has as many entries. A length that is no multiple of PARTS is cut as evenly as
can be. Scaled components are held within +-2^30 / sqrt(part length), so that squared distances are exact in 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from scriptorium.llm.common import materialize, ship

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF, CHUNK = 8, 4096
#: Labels that are broadcast: each has more than this share of the rows.
HOT_SHARE = 1000


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q from all rows of c (both long)."""
    width = q.shape[1]
    high = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * width * high * high < 1 << 53:  # every sum below is an integer that a double holds
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    for j in range(width):
        gap = q[:, j, None] - c[None, :, j]
        out += gap * gap
    return out


def above(d2: np.ndarray) -> np.ndarray:
    """A double not below the root of d2."""
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), np.inf), np.inf)


def below(d2: np.ndarray) -> np.ndarray:
    """A double not above the root of d2."""
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), -np.inf), -np.inf)


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    members: np.ndarray  # ascending places of entries; all of them below this ball
    halves: tuple[Ball, ...]

    def leaves(self) -> list[Ball]:
        return [x for half in self.halves for x in half.leaves()] if self.halves else [self]


def grow(entries: np.ndarray, members: np.ndarray | None = None) -> Ball:
    """A ball tree: a ball is halved between the member farthest from its centre and the one farthest from that."""
    members = np.arange(len(entries)) if members is None else members
    mine = entries[members]
    centre = mine.sum(0) // len(mine)
    far = squared(centre[None], mine)[0]
    halves = ()
    if len(members) > LEAF and far.max():
        one = int(far.argmax())
        from_one = squared(mine[one : one + 1], mine)[0]
        from_two = squared(mine[from_one.argmax()][None], mine)[0]
        left = from_one <= from_two
        if not left.all():
            halves = (grow(entries, members[left]), grow(entries, members[~left]))
    return Ball(centre, float(above(far).max()), members, halves)


class Codebook:
    """The entries of one part position and the tree over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = grow(entries)
        self.leaves = self.root.leaves()

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of q, the nearest entry's place and its exact squared distance."""
        n = len(q)
        best, place = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries))
        first = squared(q, np.stack([x.centre for x in self.leaves])).argmin(1)  # a good leaf to begin with

        def compare(ball: Ball, who: np.ndarray) -> None:
            if not len(who):
                return
            d = squared(q[who], self.entries[ball.members])
            at = d.argmin(1)
            d, at = d[np.arange(len(who)), at], ball.members[at]
            won = (d < best[who]) | ((d == best[who]) & (at < place[who]))
            best[who[won]], place[who[won]] = d[won], at[won]

        for i, leaf in enumerate(self.leaves):
            compare(leaf, np.flatnonzero(first == i))
        number = {id(x): i for i, x in enumerate(self.leaves)}

        def visit(ball: Ball, who: np.ndarray) -> None:
            if len(who):
                least = np.nextafter(below(squared(q[who], ball.centre[None])[:, 0]) - ball.radius, -np.inf)
                who = who[least <= above(best[who])]
            if not ball.halves:
                compare(ball, who[first[who] != number[id(ball)]])
            elif len(who):
                for half in ball.halves:
                    visit(half, who)

        visit(self.root, np.arange(n))
        return place, best


def cuts(length: int) -> list[int]:
    return [length * i // PARTS for i in range(PARTS + 1)]


def _bound(length: int) -> int:
    return int(2**30 / math.sqrt(max(1, -(-length // PARTS))))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding) without a missing component, as integers."""
    for batch in batches:
        rows = batch.filter(batch.column("embedding").is_valid())
        lists = rows.column("embedding")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is NaN
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        ends = np.cumsum(sizes)
        fine = bad[ends] == bad[ends - sizes]
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(x * SCALE)
        limit = np.repeat([_bound(int(n)) for n in sizes], sizes) if len(set(sizes.tolist())) > 1 else _bound(int(sizes[0]) if len(sizes) else 1)
        v = np.where(np.isfinite(x), np.clip(v, -limit, limit), 0).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(v))
        yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), made], ["vec_id", "label", "v"]).filter(pa.array(fine))


def _parts(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, length)


def _assign(v: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    at = cuts(v.shape[1])
    for p, book in enumerate(books):
        mine = v[:, at[p] : at[p + 1]]
        found = [book.nearest(mine[i : i + CHUNK]) for i in range(0, len(mine), CHUNK)]
        yield p, mine, *(np.concatenate(x) for x in zip(*found, strict=True))


def _sums(books, length: int) -> Callable:
    """(part, entry, n, sums) of a partition: at most PARTS x ENTRIES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at = [Codebook(x) for x in books.value], cuts(length)
        n = [np.zeros(len(t.entries), np.int64) for t in trees]
        total = [np.zeros(t.entries.shape, np.int64) for t in trees]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, mine, place, _ in _assign(_parts(batch, length), trees):
                n[p] += np.bincount(place, minlength=len(n[p]))
                order = np.argsort(place, kind="stable")
                used, starts = np.unique(place[order], return_index=True)
                if at[p + 1] > at[p]:
                    total[p][used] += np.add.reduceat(mine[order], starts)
        rows = [(p, int(e), int(n[p][e]), total[p][e].tolist()) for p in range(PARTS) for e in np.flatnonzero(n[p])]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, types, strict=True)], ["part", "entry", "n", "sums"])

    return run


def _codes(books, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(x) for x in books.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, _, place, d in _assign(_parts(batch, length), trees):
                code[:, p] = place
                error += d
            hexed = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hexed, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _started(kept: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The length of vectors and the codebooks before the first round."""
    least = kept.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "v")).alias("f")).first().f
    if least is None:
        return 0, []
    length = len(least.v)
    kept = kept.filter(F.size("v") == length)
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES)
    chosen = kept.alias("k").join(F.broadcast(ids.alias("i")), F.col("k.vec_id").eqNullSafe(F.col("i.vec_id")))  # ENTRIES ids
    rows = chosen.groupBy("k.vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    v = np.array([r.v for r in rows], np.int64).reshape(len(rows), length)
    at = cuts(length)
    return length, [v[:, at[p] : at[p + 1]] for p in range(PARTS)]


def _moved(books: list[np.ndarray], rows: list[Row]) -> list[np.ndarray]:
    out = [b.copy() for b in books]
    for r in rows:
        if books[r.part].shape[1]:
            out[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def train(kept: DataFrame, length: int, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after `rounds` rounds over kept(vec_id, label, v)."""
    sc = kept.sparkSession.sparkContext
    width = max(b.shape[1] for b in books)
    for _ in range(rounds):
        shared = sc.broadcast(books)  # PARTS x ENTRIES rows of integers
        per_task = kept.mapInArrow(_sums(shared, length), "part int, entry int, n long, sums array<long>")
        added = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width)))
        rows = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums")).collect()  # PARTS x ENTRIES rows
        rows = [Row(part=r.part, entry=r.entry, n=r.n, sums=r.sums[: books[r.part].shape[1]]) for r in rows]
        books = _moved(books, rows)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of vectors(vec_id, embedding, label): vec_id, label, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    label = rows.schema["label"]
    schema = StructType([StructField("vec_id", LongType()), StructField("label", label.dataType), StructField("v", ArrayType(IntegerType()))])
    kept = materialize(rows.mapInArrow(_whole, schema), "vectors")
    length, books = _started(kept)
    kept = kept.filter(F.size("v") == length)
    if books:
        books = train(kept, length, books, rounds)
    shared = spark.sparkContext.broadcast(books)
    schema = StructType([*schema.fields[:2], *StructType.fromDDL("code string, error long").fields])
    coded = materialize(kept.mapInArrow(_codes(shared, length), schema), "codes")
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    share = coded.count() / HOT_SHARE
    totals = totals.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    # labels with more than a thousandth of the rows each: fewer than a thousand, so they are broadcast; no other label is hot
    hot, rest = totals.filter(F.col("_n") > share), totals.filter(F.col("_n") <= share)
    named = coded.join(F.broadcast(hot), same)
    if not rest.isEmpty():
        others = coded.join(F.broadcast(hot), same, "left_anti")
        named = named.unionByName(others.join(rest, same))
    return named.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
