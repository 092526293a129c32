"""SimHash near-duplicates, with candidates filtered by the pigeonring principle.

A fingerprint's 64 bits form a ring of m = 5 segments. If two fingerprints differ in at most t = 4 bits, some segment
starts a chain in which, for every length l, the first l segments together differ in at most floor(l * t / m) bits.
So the first segment of that chain is equal (floor(0.8) = 0) and the first two differ in at most one bit (floor(1.6)).
Both ends find each other under a key made of the first segment and the second without one bit position: 64 keys a
fingerprint, each of about 25 bits. Longer chains are then tested on the candidates (3 segments: 2 bits, 4: 3 bits)
before the full Hamming distance.

Only distinct fingerprints are compared; copies follow their fingerprint. A key's group yields a spanning forest of its
links, never all pairs, so a cluster of k near copies costs k - 1 rows. A group above `block` fingerprints isn't linked in
one task: its rows are passed on, dealt to blocks, and every pair of blocks is linked by a task of its own.

Defined results: null or empty text has fingerprint zero and is linked like any other. A null id takes part but is never
a component id unless all ids of the component are null. A component of null ids alone keeps one row. Repeated rows give repeated result rows. Other columns are
ignored by `near_groups` and kept by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import odd_sketch
from scriptorium.llm.common import materialize, ship, shuffle_partitions, spare_names
from scriptorium.llm.components import connected_components

BITS, DISTANCE, SEED = 64, 4, 42
#: (lowest bit, width) around the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUDGETS = tuple((i + 1) * DISTANCE // len(SEGMENTS) for i in range(len(SEGMENTS)))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of one text's word shingles as rows of eight bytes; no rows for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty((0, 8), np.uint8)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text's word shingles."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):  # very long texts in pieces
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, texts = batch.columns
        values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values)], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """An array of the 64 keys: segment i as it is, segment i + 1 without bit b."""
    out = []
    for i, (low, width) in enumerate(SEGMENTS):
        low2, width2 = SEGMENTS[(i + 1) % len(SEGMENTS)]
        first = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned(fp, low2).bitwiseAND(F.lit((1 << width2) - 1))
        for b in range(width2):
            rest = second.bitwiseAND(F.lit(((1 << width2) - 1) ^ (1 << b)))
            out.append(F.shiftleft(F.lit(i * 16 + b).cast("long"), 32).bitwiseOR(F.shiftleft(first, 16)).bitwiseOR(rest))
    return F.array(*out)


def _viable(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of `many` share a chain within the budgets with `one`; then the full distance."""
    diff = one ^ many
    parts = [np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS]
    chain = np.zeros(len(many), bool)
    for start in range(len(SEGMENTS)):
        ok, total = np.ones(len(many), bool), np.zeros(len(many), np.uint8)
        for length, budget in enumerate(BUDGETS):
            total = total + parts[(start + length) % len(SEGMENTS)]
            ok &= total <= budget
        chain |= ok
    return chain & (np.bitwise_count(diff) <= DISTANCE)


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the distance connects, n - 1 at most: a breadth-first walk over unvisited members."""
    rest, out = fps, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _viable(at, rest)
            if near.any():
                out += [(int(at), int(x)) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def _linker(block: int):
    """Of rows sorted by key: kind 0 rows are links (u, v); kind 1 rows are members (key, fp) of groups above `block`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, passing = None, [], False

        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["kind", "a", "b"])

        def close(fps: np.ndarray) -> list[tuple[int, int]]:
            return spanning_links(np.unique(fps))

        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            # most keys have one member and need no look, but for those that may go on in another batch
            wanted = np.diff(cuts) > 1
            wanted[[0, -1]] = True
            links = []
            for i in np.flatnonzero(wanted).tolist():
                a, b = cuts[i], cuts[i + 1]
                if key[a] != held_key:
                    if held_key is not None and not passing and sum(map(len, held)) > 1:
                        links += close(np.concatenate(held))
                    held_key, held, passing = key[a], [], False
                held.append(fp[a:b])
                if passing or sum(map(len, held)) > block:
                    passing, mine, held = True, np.concatenate(held), []
                    yield out(1, np.full(len(mine), held_key), mine.view(np.int64))
            if links:
                pairs = np.array(links, np.uint64).view(np.int64)
                yield out(0, pairs[:, 0], pairs[:, 1])
        if held_key is not None and not passing and sum(map(len, held)) > 1 and (links := close(np.concatenate(held))):
            pairs = np.array(links, np.uint64).view(np.int64)
            yield out(0, pairs[:, 0], pairs[:, 1])

    return run


def _linked(rows: DataFrame, block: int) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(block), "kind byte, a long, b long")


def links(fps: DataFrame, block: int = 8192) -> DataFrame:
    """(u, v): for distinct fingerprints fps(fp), links that connect exactly what distances of at most 4 bits connect."""
    ship(fps.sparkSession)
    first = materialize(_linked(fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp"), block), "links", "snappy")
    found = first.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not large.isEmpty():
        # blocks of half the size: a task gets the fingerprints of two blocks of one key
        sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 4 / block).cast("int").alias("blocks"))
        dealt = large.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        pairs = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        second = materialize(_linked(pairs.select(key.alias("key"), "fp"), 1 << 62), "links")
        found = found.union(second.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found


def _named(distinct: DataFrame, block: int, more: DataFrame | None = None) -> DataFrame:
    """distinct, which has one row a fingerprint, with the fingerprint's component; `more` are further links."""
    found = links(distinct.select("fp"), block)
    parts = connected_components(found if more is None else found.union(more)).withColumnRenamed("node", "fp")
    return distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_groups(docs: DataFrame, block: int = 8192) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    rows = materialize(fingerprints(docs), "fingerprints", "snappy")
    named = _named(materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", "snappy"), block)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_links(docs: DataFrame, rows: DataFrame, jaccard: float, shingle: int, **blocks: int) -> DataFrame:
    """(u, v): links between the fingerprints of docs(doc_id, text) that connect what a Jaccard of word shingles of at least `jaccard`, in
    hundredths, connects: the classes of `odd_sketch`. rows(sha, fp) has the fingerprint of each text's SHA-256.
    """
    signed, classes = odd_sketch.rooted_classes(docs, {"sha": sha_of("text")}, shingle, round(100 * jaccard), **blocks)
    texts = signed.filter("n > 0").select("sha", "digest").distinct().join(classes.select("digest", "root"), "digest")
    members = materialize(texts.join(rows.select("sha", "fp").distinct(), "sha").select("root", "fp").distinct(), "roots", "snappy")
    hubs = members.groupBy("root").agg(F.min("fp").alias("v"), F.max("fp").alias("_last")).filter("v < _last").select("root", "v")
    return materialize(members.join(hubs, "root").filter("fp <> v").select(F.col("fp").alias("u"), "v"), "like", "snappy")


def sha_of(text: str) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def drop_near_copies(docs: DataFrame, block: int = 8192, jaccard: float | None = None, shingle: int = 5, **blocks: int) -> DataFrame:
    """docs with one row of each group of near copies: the least id, nulls last, then the least hash of the text.

    With `jaccard`, texts whose sets of `shingle`-word shingles are at least that similar are near copies too; `blocks` are the sizes of
    blocks that `odd_sketch.rooted_classes` takes.
    Columns unchanged. Of rows equal in id and text one stays.
    """
    ship(docs.sparkSession)
    key, sha = spare_names(docs, "_key", "_sha")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), sha_of("text").alias("sha"), "text")
    rows = materialize(named.mapInArrow(_fingerprints, "id long, sha string, fp long"), "fingerprints", "snappy")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("first")
    # the least row of a fingerprint, then of a component: the join sees one row a fingerprint
    least = materialize(rows.groupBy("fp").agg(first), "least", "snappy")
    more = None if jaccard is None else shingle_links(docs, rows, jaccard, shingle, **blocks)
    kept = _named(least, block, more).groupBy("component").agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.coalesce(F.col("first.id").cast("string"), F.lit("null")).alias(key), F.col("first.sha").alias(sha)), "kept")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).withColumn(sha, sha_of("text"))
    return keyed.join(kept.hint("merge"), [key, sha], "left_semi").dropDuplicates([key, sha]).drop(key, sha)
