"""Near-duplicates by MinHash bands, screened by odd sketches and confirmed on whole shingle sets.

A document's set holds its distinct shingles of `shingle` words (three); two documents are linked if the Jaccard similarity of their
sets is at least `percent` (85) hundredths.

1. Signatures. `BANDS` x `ROWS` MinHash samples give one key a band. All samples are also folded into an odd sketch: each sample,
   with its number, flips one of `BITS` bits. The exclusive or of two sketches has a set bit for an odd number of flips by samples
   that differ, so its population count tells how many differ; `odd_limit` is the count that a pair at the threshold exceeds with a
   probability of at most 1e-9. Documents with equal word sequences form a class, which goes on as one.
2. Stars. Under each band key all classes are paired with the least of them. Pairs within the sketch limit and near enough in size
   are confirmed on their sets: most of a group of near copies is connected here, by as many pairs as it has members.
3. The rest. Under each key, classes that are in different components so far are compared by their sketches, and where the limit allows
   a link, spanning links are noted. Groups that hold several components are dealt, with their texts, to tasks that link
   across components by whole sets: the largest component of a group in blocks against the blocks of the others, and those among
   themselves. A group of n others in blocks of b words costs about n / b copies of its texts.

A pair with a Jaccard of 0.85 shares no band with a probability of (1 - 0.85^5)^32 = 7e-9, one of 0.8 with 3e-6, a more similar one with less. Pairs that are
not linked are never confirmed: every link has been counted on the sets.

Defined results: a text without words (null and empty ones too) has no shingles, and is linked with nothing; one of fewer than three words
has one shingle, all its words. A null doc_id takes part but is a component's id only if all its ids are null. Repeated rows are
linked like any other equal texts. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import DigestCache, materialize, ship, shuffle_partitions
from scriptorium.llm.components import connected_components
from scriptorium.llm.words import mixed

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, BITS = 32, 5, 512
SAMPLES, LONGS = BANDS * ROWS, BITS // 64
#: Documents behind one part of a table that is written: there are few parts where there are few documents.
ROWS_A_TASK = 20_000
#: Words of texts in one block, and classes of one key compared in one task.
BLOCK_WORDS, BLOCK_CLASSES = 1 << 18, 8192
_FACTORS, _SHIFTS = np.random.default_rng(13).integers(0, 1 << 64, (2, SAMPLES), np.uint64) | np.uint64(1)
_words = DigestCache(lambda word: xxhash.xxh3_64_digest(word, 13), 100_000)
_LONG_WORD = 64


@functools.cache
def odd_limit(samples: int = SAMPLES, bits: int = BITS, percent: int = PERCENT, miss: float = 1e-9) -> int:
    """The least population count that two sketches of sets with that similarity exceed with a probability of at most `miss`."""
    differ, share = np.zeros(samples + 1), 1 - percent / 100
    differ[0] = 1
    for _ in range(samples):  # how many samples differ
        differ[1:] = differ[1:] * (1 - share) + differ[:-1] * share
        differ[0] *= 1 - share
    odd, total, at = np.zeros(bits + 2), np.zeros(bits + 2), np.arange(bits + 2)
    odd[0] = 1
    for d in range(samples + 1):
        total += differ[d] * odd
        for _ in range(2):  # two samples that differ flip two bits, each set or not yet
            odd = np.roll(odd * np.maximum(0, bits - at) / bits, 1) + np.roll(odd * np.minimum(at, bits) / bits, -1)
    above = 1 - np.cumsum(total)
    return int(np.flatnonzero(above <= miss)[0])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def shingles(words: list[bytes], size: int = SHINGLE) -> set:
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def _hash(word: bytes) -> bytes:
    return _words[word] if len(word) <= _LONG_WORD else xxhash.xxh3_64_digest(word, 13)


def samples(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The MinHash samples of a document's shingles."""
    h = np.frombuffer(b"".join(map(_hash, words)), "<u8")
    n = max(1, len(h) - size + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, n, 512):
        least = np.minimum(least, (_FACTORS[:, None] * x[None, at : at + 512] + _SHIFTS[:, None]).min(1))
    return least


def signature(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One key per band, and the odd sketch as LONGS numbers."""
    least = samples(words, size)
    keys = mixed((mixed(least).reshape(BANDS, ROWS) * _FACTORS[:ROWS]).sum(1, dtype=np.uint64) + _SHIFTS[:BANDS])
    place = mixed(least ^ _SHIFTS) % np.uint64(BITS)
    flips = np.bincount(place.astype(np.int64), minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(flips.astype(np.uint8)).view("<i8")


def _signed(size: int) -> Callable:
    """Of rows (text, other columns): the others, and of each text digest, n, bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, bands, sketches = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sizes.append(len(shingles(words, size)))
                one, two = signature(words, size) if words else (None, None)
                bands.append(one)
                sketches.append(two)
            own = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            _, *others = batch.columns
            yield pa.RecordBatch.from_arrays([*others, *own], [*batch.schema.names[1:], "digest", "n", "bands", "sketch"])

    return run


def _written(df: DataFrame, label: str, tasks: int) -> DataFrame:
    return materialize(df.coalesce(tasks), label, "snappy")


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _apart(a: Column, b: Column) -> Column:
    """The population count of the exclusive or of two sketches."""
    return functools.reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONGS)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, cid, digest), the words of those whose text has that digest."""
    for batch in batches:
        joined = [b" ".join(words_of(t.as_py())) for t in batch.column("text")]
        fits = [hashlib.blake2b(j, digest_size=16).digest() == d for j, d in zip(joined, batch.column("digest").to_pylist(), strict=True)]
        rows = pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(joined, pa.binary())], ["cid", "words"])
        yield rows.filter(pa.array(fits, pa.bool_()))


def _texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, tasks: int) -> DataFrame:
    """(cid, words) of the classes in wanted(cid): the words of one document each, joined by spaces."""
    own = classes.join(wanted, "cid", "left_semi").select("cid", "digest", F.col("least").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    none = F.lit(-(1 << 63))
    both = rows.withColumn("_id", F.coalesce("doc_id", none)).join(own.withColumn("_id", F.coalesce("doc_id", none)).drop("doc_id"), "_id")
    found = both.select("text", "cid", "digest").mapInArrow(_texts, "cid long, words binary")
    return _written(found.groupBy("cid").agg(F.first("words").alias("words")), "texts", tasks)


def _confirmed(size: int, percent: int) -> Callable:
    """Of rows (u, v, u_words, v_words) the linked pairs; rows of one v follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other = None, set()
        for batch in batches:
            keep = []
            for v, one, two in zip(batch.column("v").to_pylist(), batch.column("u_words"), batch.column("v_words"), strict=True):
                if v != held:
                    held, other = v, shingles(two.as_py().split(b" "), size)
                mine = shingles(one.as_py().split(b" "), size)
                common = len(mine & other)
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _screened(block: int, limit: int, percent: int) -> Callable:
    """Of rows (key, cid, root, n, sketch) sorted by key: kind 0: links (a, b) that span what sketches may link across roots;
    kind 1: members of keys with more than `block` rows, with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, size, passing = None, [], 0, False

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        def close() -> pa.RecordBatch:
            cid, root, n, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            links = across(cid, root, n, sketch, limit, percent, None)
            return out(0, *np.array(links, np.int64).reshape(-1, 2).T)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, cid, root, n = (batch.column(c).to_numpy() for c in ("key", "cid", "root", "n"))
            sketch = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if key[a] != held_key:
                    if size > 1 and not passing:
                        yield close()
                    held_key, held, size, passing = key[a], [], 0, False
                held.append((cid[a:b], root[a:b], n[a:b], sketch[a:b]))
                size += b - a
                if passing or size > block:
                    passing, mine, held = True, np.concatenate([h[0] for h in held]), []
                    yield out(1, np.full(len(mine), held_key), mine)
        if size > 1 and not passing:
            yield close()

    return run


def across(cid: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, limit: int, percent: int, linked: Callable | None) -> list[tuple[int, int]]:
    """Links between members of different roots that connect what all links would connect.

    A pair may be linked if sizes and sketches allow it; `linked(at, others)`, if given, tells which of those it really links.
    """
    root, out = root.copy(), []
    if (root == root[0]).all():
        return out
    for at in range(len(cid)):
        other = np.flatnonzero((root != root[at]) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at])))
        if not len(other):
            continue
        other = other[np.bitwise_count(sketch[other] ^ sketch[at]).sum(1, dtype=np.int64) <= limit]
        if len(other) and linked:
            other = other[linked(at, other)]
        roots, first = np.unique(root[other], return_index=True)
        out += [(int(cid[at]), int(cid[x])) for x in other[first]]
        if len(roots):
            root[np.isin(root, roots)] = root[at]
    return out


def _blocks_linked(limit: int, size: int, percent: int) -> Callable:
    """Rows (key, cid, root, n, sketch, words) sorted by key to links (u, v) by whole sets across roots."""

    def close(held: list) -> pa.RecordBatch:
        cid, root, n, sketch, words = zip(*held, strict=True)
        number: dict = {}
        ids = [np.array([number.setdefault(s, len(number)) for s in shingles(w.split(b" "), size)], np.int64) for w in words]
        sizes = np.array([len(x) for x in ids])
        flat, ends = np.concatenate(ids), np.cumsum(sizes)
        marked = np.zeros(len(number), bool)

        def linked(at: int, other: np.ndarray) -> np.ndarray:
            marked[ids[at]] = True
            long = sizes[other]
            places = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(ends[other] - long, long)
            common = np.add.reduceat(marked[flat[places]], np.cumsum(long) - long, dtype=np.int64)  # no set is empty
            marked[ids[at]] = False
            return 100 * common >= percent * (sizes[at] + long - common)

        links = across(np.array(cid), np.array(root), np.array(n), np.array(sketch, np.int64).view(np.uint64), limit, percent, linked)
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "cid", "root", "n", "sketch", "words")]
            for key, *row in zip(*cols, strict=True):
                if key != held_key:
                    if held:
                        yield close(held)
                    held_key, held = key, []
                held.append(row)
        if held:
            yield close(held)

    return run


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with their component over links(u, v) as root."""
    return classes.join(connected_components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid")).drop("component")


def _noted(rows: DataFrame, block: int, limit: int, percent: int, tasks: int) -> DataFrame:
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "cid")
    return _written(dealt.mapInArrow(_screened(block, limit, percent), "kind byte, a long, b long"), "noted", tasks)


def _may_link(keys: DataFrame, rooted: DataFrame, block: int, limit: int, percent: int, tasks: int) -> DataFrame:
    """(u, v): links across roots that span, under each key, what sketches may link."""
    rows = keys.join(rooted.select("cid", "root"), "cid")
    mixed_keys = rows.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    rows = _written(rows.join(mixed_keys, "key", "left_semi"), "rest", tasks)
    features = rooted.select("cid", "n", "sketch")
    first = _noted(rows.join(features, "cid").select("key", "cid", "root", "n", "sketch"), block, limit, percent, tasks)
    found = first.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cid"))
    if not large.isEmpty():
        sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 4 / block).cast("int").alias("blocks"))
        dealt = large.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
        pairs = dealt.select("key", "cid", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        pairs = pairs.select(key.alias("key"), "cid").join(rooted.select("cid", "root", "n", "sketch"), "cid").select("key", "cid", "root", "n", "sketch")
        found = found.union(_noted(pairs, 1 << 62, limit, percent, tasks).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.distinct()


def _dealt(members: DataFrame, block_words: int) -> DataFrame:
    """members(grp, root, n, cid, ...) with a key: the pairs of blocks they are in, but for pairs within a group's largest component."""
    by_root = members.groupBy("grp", "root").agg(F.sum("n").alias("w"))
    largest = by_root.groupBy("grp").agg(F.max_by("root", F.struct("w", "root")).alias("main"), F.max("w").alias("main_w"), F.sum("w").alias("all_w"))
    blocks = lambda w: F.ceil(w / block_words).cast("int")
    sides = largest.select("grp", "main", blocks(F.col("main_w")).alias("a"), blocks(F.col("all_w") - F.col("main_w")).alias("b"))
    rows = members.join(sides, "grp").withColumn("in_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid"), F.when(F.col("in_main"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    # pairs (main block, other block) are numbered from 0, pairs of other blocks go below 0
    mine, a, b = F.col("mine"), F.col("a"), F.col("b")
    with_main = F.when(F.col("in_main"), F.transform(F.sequence(F.lit(0), b - 1), lambda x: mine * b + x)).otherwise(F.transform(F.sequence(F.lit(0), a - 1), lambda x: x * b + mine))
    others = F.transform(F.sequence(F.lit(0), b - 1), lambda x: -1 - (F.least(x, mine) * b + F.greatest(x, mine)))
    pairs = F.when(F.col("in_main"), with_main).otherwise(F.concat(with_main, others))
    return rows.withColumn("pair", F.explode(pairs)).withColumn("key", F.xxhash64("grp", "pair")).drop("a", "b", "main", "in_main", "mine", "pair")


def rooted_classes(docs: DataFrame, own: dict[str, Column], size: int = SHINGLE, percent: int = PERCENT, block_words: int = BLOCK_WORDS, block_classes: int = BLOCK_CLASSES) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with doc_id, the columns `own`, n and digest, and the classes: digest, least (doc_id) and root, which linked classes share."""
    spark = docs.sparkSession
    ship(spark)
    limit = odd_limit(percent=percent)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in own.items()))
    others = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    signed = rows.mapInArrow(_signed(size), others + "digest binary, n long, bands array<long>, sketch array<long>")
    signed = materialize(signed, "signatures", "snappy")
    tasks = signed.count() // ROWS_A_TASK + 1
    same = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), *same)
    classes = _written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes", tasks)
    keys = classes.select("cid", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("cid").alias("v"), F.max("cid").alias("_last")).filter("v < _last").select("key", "v")
    shared = _written(keys.join(hubs, "key"), "shared", tasks)  # classes that share a key with another
    features = classes.select("cid", "n", "sketch")
    side = lambda name: features.select(F.col("cid").alias(name), F.struct("n", "sketch").alias(f"{name}_"))
    stars = shared.filter("cid <> v").select(F.col("cid").alias("u"), "v").distinct().join(side("u"), "u").join(side("v"), "v")
    stars = stars.filter(_near_size(F.col("u_.n"), F.col("v_.n"), percent) & (_apart(F.col("u_.sketch"), F.col("v_.sketch")) <= limit)).select("u", "v")
    stars = _written(stars, "stars", tasks)
    texts = _texts_of(docs, classes, stars.select(F.col("u").alias("cid")).union(stars.select("v")).distinct(), tasks)
    named = lambda name: texts.select(F.col("cid").alias(name), F.col("words").alias(f"{name}_words"))
    both = stars.join(named("u"), "u").join(named("v"), "v").select("u", "v", "u_words", "v_words")
    links = _written(both.mapInArrow(_confirmed(size, percent), "u long, v long"), "links", tasks)
    rooted = _written(_rooted(classes.select("cid", "n", "sketch"), links), "rooted", tasks)
    rest = _written(_may_link(shared.select("key", "cid"), rooted, block_classes, limit, percent, tasks), "may", tasks)
    if not rest.isEmpty():
        ends = rooted.select("cid", "root")
        to_roots = rest.join(ends.select(F.col("cid").alias("u"), F.col("root").alias("ru")), "u").join(ends.select(F.col("cid").alias("v"), F.col("root").alias("rv")), "v")
        groups = connected_components(to_roots.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        members = rooted.join(groups.select(F.col("node").alias("root"), F.col("component").alias("grp")), "root")
        members = _written(members.select("grp", "root", "cid", "n", "sketch"), "members", tasks)
        texts = _texts_of(docs, classes, members.select("cid"), tasks)
        dealt = _dealt(members, block_words).join(texts, "cid").select("key", "cid", "root", "n", "sketch", "words")
        dealt = dealt.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
        more = _written(dealt.mapInArrow(_blocks_linked(limit, size, percent), "u long, v long"), "links", tasks)
        links = rooted.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")).union(more)
        rooted = _rooted(classes.select("cid"), links)
    return signed, _written(classes.select("cid", "digest", "least").join(rooted.select("cid", "root"), "cid").drop("cid"), "components", tasks)


def near_components(docs: DataFrame, block_words: int = BLOCK_WORDS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id is that id)."""
    signed, classes = rooted_classes(docs, {}, block_words=block_words, block_classes=block_classes)
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(ids, "root").select("digest", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
