"""Line deduplication by an exact set-similarity join.

A line is the set of its words; two lines match if the Jaccard similarity of their sets is at least 0.8. A line is removed
if an earlier line (by doc_id, then line number) matches it, whether or not that one is removed itself.

1. Rarity. Words are counted over all lines into `SLOTS` counters by hash, a table of fixed size whatever the corpus. Any
   fixed order of words gives exact results; ordering by counter (in steps of a logarithm), then hash, puts rare words first.
2. Classes. Lines with equal sets form a class, stood for by its first line; later lines of a class are removed. Sets are
   told apart by their size and two sums over two independent 64-bit hashes of each whole word. The words to index travel with the line into that aggregation, so lines are never joined back.
3. Prefixes. Of a class with n words, only the first n - ceil(0.8 n) + 1 words in that order are indexed: matching lines
   share one of them. Words whose counter is 1 occur in no other line and are left out. An index word is one long: 48 bits
   of hash, 16 bits of place.
4. Candidates. Under each word, pairs pass the length filter (n_x >= 0.8 n_y), the positional filter (what is left after
   the shared word can still reach the required overlap) and a parity filter: each word flips one of 128 bits, and two
   sets' bits can't differ in more places than the sets do. A class needs one match only, so a word yields the `TRY`
   nearest candidates for it; classes whose candidates all fail though there were more are joined again without that limit.
   Words with more than `BLOCK` classes are split by the class's next word (matching lines share a second one in a prefix
   that is one word longer); a pair of words still above that is dealt to pairs of blocks.
5. Verification compares the words of the lines themselves: first each class with its likeliest candidate, then those
   that failed with all the others. The second join of 4 reads only rows whose words may be among those of its classes,
   by a table of `SLOTS` bits.

Defined results: a line without words is never removed. Null and empty texts have no words in their one line. Rows equal
in doc_id and text count once and get equal results. Unlike texts of one doc_id are documents of their own, in an order of
their texts' hashes; a null doc_id comes before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, ship, shuffle_partitions
from scriptorium.llm.words import Tokens, mixed, token_chunks

SLOTS, TRY, BLOCK = 1 << 22, 2, 4096
_PIECE = 1 << 12  # counters in one row
_HELD = 1 << 21  # words counted together
_ROWS = 1 << 17  # index rows looked at together
_PLACE = (1 << 16) - 1
_NULL_ID = -(1 << 63)
_BLANK = " \t\n\r\x0b\x0c"


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): nulls replaced; h tells unlike texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, counters): non-empty stretches of the table of counters."""
    total, held, size = np.zeros(SLOTS, np.int64), [], 0
    for batch in batches:
        for tokens in token_chunks(batch.column("text")):
            held.append(_slots(tokens.hash))
            size += len(held[-1])
            if size >= _HELD:
                total += np.bincount(np.concatenate(held), minlength=SLOTS)
                held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=SLOTS)
    yield from _pieces(range(SLOTS // _PIECE), total.reshape(-1, _PIECE))


def _pieces(numbers, counters) -> Iterator[pa.RecordBatch]:
    rows = [(i, np.minimum(c, 2**32 - 1).astype("<u4").tobytes()) for i, c in zip(numbers, counters, strict=True) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["piece", "counters"])


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by piece, their sums."""
    piece, total = None, None
    for batch in batches:
        for i, c in zip(batch.column("piece").to_pylist(), batch.column("counters"), strict=True):
            if i != piece:
                if piece is not None:
                    yield from _pieces([piece], [total])
                piece, total = i, np.zeros(_PIECE, np.int64)
            total += np.frombuffer(c.as_buffer(), "<u4")
    if piece is not None:
        yield from _pieces([piece], [total])


def rarity_steps(named: DataFrame) -> np.ndarray:
    """SLOTS bytes over all lines: 0 for slots met at most once, else the counter's logarithm in steps."""
    counted = named.select("text").mapInArrow(_count_slots, "piece int, counters binary")
    dealt = counted.repartition(shuffle_partitions(named.sparkSession), "piece").sortWithinPartitions("piece")
    table = dealt.mapInArrow(_add_pieces, "piece int, counters binary").toArrow()  # SLOTS counters at most
    out = np.zeros((SLOTS // _PIECE, _PIECE), np.uint8)
    for i, c in zip(table["piece"].to_pylist(), table["counters"], strict=True):
        n = np.frombuffer(c.as_buffer(), "<u4")
        out[i] = np.where(n > 1, np.minimum(255, 1 + 12 * np.log2(np.maximum(n, 2) / 2)), 0)
    return out.reshape(-1)


_LINE = "doc_id long, h long, line int, n int, c1 long, c2 long, s1 long, s2 long, words array<long>"


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


class Lines:
    """The word sets of a chunk's lines, words by rarity: hashes, steps, lines, and where each line begins and ends."""

    def __init__(self, tokens: Tokens, steps: np.ndarray):
        h, line = tokens.hash, tokens.line
        step = steps[_slots(h)]
        if tokens.lines < 1 << 20:
            key = (line.astype(np.uint64) << np.uint64(44)) | (step.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
            order = np.argsort(key)
            key, h = key[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = key[1:] != key[:-1]
            clash = bool((~new[1:] & (h[1:] != h[:-1])).any())
        if tokens.lines >= 1 << 20 or clash:  # the key doesn't tell all words apart
            order = np.lexsort((tokens.hash, step, line))
            h = tokens.hash[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (line[order][1:] != line[order][:-1])
        order = order[new]
        self.hash, self.hash2, self.step, self.line = tokens.hash[order], tokens.hash2[order], step[order], line[order]
        self.size = np.bincount(self.line, minlength=tokens.lines)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each line."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return (total[self.ends] - total[self.starts]).view(np.int64)

    def flips(self, bits: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
        return (total[self.ends] ^ total[self.starts]).view(np.int64)


def _line_rows(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = steps.value
        for batch in batches:
            doc_ids, hs = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            for tokens in token_chunks(batch.column("text")):
                x = Lines(tokens, table)
                other = mixed(x.hash)
                bit = np.uint64(1) << (other >> np.uint64(58))
                low = (other & np.uint64(1)).astype(bool)
                at = np.arange(len(x.hash)) - x.starts[x.line]
                # one word more than the prefix, for words that are split by the next
                where = np.flatnonzero((at <= prefix_size(x.size)[x.line]) & (x.step > 0))
                per_line = np.concatenate([[0], np.cumsum(np.bincount(x.line[where], minlength=len(x.size)))])
                packed = (x.hash[where] & ~np.uint64(_PLACE)) | np.minimum(at[where], _PLACE).astype(np.uint64)
                doc = np.repeat(np.arange(tokens.first, tokens.last), tokens.lines_of)
                rows = pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[doc]), pa.array(hs[doc]), pa.array(tokens.number, pa.int32()), pa.array(x.size, pa.int32()),
                        pa.array(x.sums(mixed(x.hash * np.uint64(0x9E3779B97F4A7C15)))), pa.array(x.sums(mixed(x.hash2))),
                        pa.array(x.flips(np.where(low, bit, np.uint64(0)))), pa.array(x.flips(np.where(low, np.uint64(0), bit))),
                        pa.ListArray.from_arrays(pa.array(per_line, pa.int32()), pa.array(packed.view(np.int64))),
                    ],
                    ["doc_id", "h", "line", "n", "c1", "c2", "s1", "s2", "words"],
                )
                yield rows.filter(pa.array(x.size > 0))

    return run


_SIDE = ("doc_id", "h", "line")
#: An index row: hash and place of the word, then its class: first line, size and line number in one long, parity bits.
_INDEX = ("w", "doc_id", "h", "nl", "s1", "s2")
_FOUND = "kind byte, w long, doc_id long, h long, nl long, s1 long, s2 long, x_doc_id long, x_h long, x_line int, gap int"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_LOW = (1 << 32) - 1


def _passes(c: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters for pairs of rows, and how far apart their parity bits are for what they may be, in thousandths."""
    nx, ny = c["n"][x], c["n"][y]
    need = (4 * (nx + ny) + 8) // 9  # ceil of 0.8 / 1.8 of both sizes
    hit = (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (np.minimum(nx - c["at"][x], ny - c["at"][y]) >= need)
    i = np.flatnonzero(hit)
    apart = np.bitwise_count(c["s1"][x[i]] ^ c["s1"][y[i]]).astype(np.int64) + np.bitwise_count(c["s2"][x[i]] ^ c["s2"][y[i]])
    may = (nx + ny - 2 * need)[i]
    hit[i] = apart <= may
    return hit, (1000 * apart // (may + 1))[apart <= may]


def _candidates(block: int, attempts: int):
    """Of rows sorted by word: kind 0: candidates (y's line, x's line); kind 1: members of words above `block`; kind 2:
    classes that had more candidates than `attempts`. Where rows have `open`, only y that are open count."""

    def emit(kind: int, c: dict, y: np.ndarray, x: np.ndarray | None = None, gap: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(y), pa.int64())
        few = {k: none if kind != 1 and k in ("w", "s1", "s2") else pa.array(c[k][y].view(np.int64)) for k in _INDEX}
        other = [none, none] if x is None else [pa.array(c[k][x]) for k in ("doc_id", "h")]
        line = pa.nulls(len(y), pa.int32()) if x is None else pa.array((c["nl"][x] & _LOW).astype(np.int32))
        gap = pa.nulls(len(y), pa.int32()) if gap is None else pa.array(gap, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(y), kind, np.int8)), *few.values(), *other, line, gap], _NAMES)

    def pairs(c: dict) -> Iterator[pa.RecordBatch]:
        if not len(c["w"]):
            return
        order = np.lexsort((c["nl"] & _LOW, c["h"], c["doc_id"], c["w"] >> 16))
        c = {k: v[order] for k, v in c.items()}
        key = c["w"] >> 16
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        c |= {"at": c["w"] & _PLACE, "n": c["nl"] >> 32}
        tries = np.zeros(len(key), np.int64)
        active, back = np.flatnonzero((rank >= 1) & c["open"] if "open" in c else rank >= 1), 1
        while len(active):
            hit, gap = _passes(c, active - back, active)
            over = hit & (tries[active] >= attempts)
            if over.any():
                yield emit(2, c, active[over])
            new = hit & ~over
            if new.any():
                yield emit(0, c, active[new], active[new] - back, gap[new[hit]])
                tries[active[new]] += 1
            back += 1
            active = active[~over]
            active = active[rank[active] >= back]

    def split(c: dict, cut: int) -> Iterator[pa.RecordBatch]:
        """The first `cut` rows: words above `block` are passed on, the others paired."""
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c["w"][:cut] >> 16)) + 1])
        sizes = np.diff(np.append(starts, cut))
        large = np.repeat(sizes > block, sizes) if cut else np.zeros(0, bool)
        if large.any():
            yield emit(1, c, np.flatnonzero(large))
        yield from pairs({k: v[:cut][~large] for k, v in c.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, passing = 0, None

        def joined() -> dict:
            return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            c |= {k: c[k].view(np.uint64) for k in ("s1", "s2")}
            if passing is not None:
                more = c["w"] >> 16 != passing
                same = int(more.argmax()) if more.any() else len(more)
                if same:
                    yield emit(1, c, np.arange(same))
                    c = {k: v[same:] for k, v in c.items()}
                if not len(c["w"]):
                    continue
                passing = None
            held.append(c)
            size += len(c["w"])
            if size < _ROWS:
                continue
            c = joined()
            apart = np.flatnonzero(c["w"] >> 16 != c["w"][-1] >> 16)
            cut = int(apart[-1]) + 1 if len(apart) else 0  # the last word's group may go on
            yield from split(c, cut)
            c = {k: v[cut:] for k, v in c.items()}
            held, size = [c], len(c["w"])
            if size > block:
                yield emit(1, c, np.arange(size))
                passing, held, size = c["w"][-1] >> 16, [], 0
        if held:
            c = joined()
            yield from split(c, len(c["w"]))

    return run


def _joined(rows: DataFrame, block: int, attempts: int) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(parts, F.shiftright("w", 16)).sortWithinPartitions("w")  # one long: sorted by its digits
    return materialize(dealt.mapInArrow(_candidates(block, attempts), _FOUND), "candidates")


def _at() -> Column:
    return F.col("w").bitwiseAND(F.lit(_PLACE))


def _opened(rows: DataFrame, only: DataFrame) -> DataFrame:
    return rows.join(only.select(*_SIDE, F.lit(True).alias("open")), [*_SIDE], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def _words_in(table):
    """Classes with those of their words whose bit in a table of SLOTS bits is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value, bitorder="little").astype(bool)
        for batch in batches:
            words = batch.column("words")
            w, ends = words.flatten().to_numpy(), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
            keep = bits[(w >> 16) & (SLOTS - 1)]
            kept = np.concatenate([[0], np.cumsum(keep)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], kept[ends]]), pa.int32()), pa.array(w[keep]))
            cols = [lists if k == "words" else batch.column(k) for k in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(pa.array(np.diff(np.concatenate([[0], kept[ends]])) > 0))

    return run


def _candidate_pairs(classes: DataFrame, block: int, attempts: int, only: DataFrame | None = None) -> DataFrame:
    """(kind, y, x, gap) for classes; with `only`, candidates of those classes y alone."""
    spark = classes.sparkSession
    classes = classes.filter("n > 3")  # smaller sets match equal ones only
    if only is not None:
        mine = classes.join(only, [*_SIDE], "left_semi").select(F.explode("words").alias("w"))
        slots = mine.select(F.shiftright("w", 16).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()  # at most SLOTS
        bits = np.zeros(SLOTS, np.uint8)
        bits[slots] = 1
        table = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))  # SLOTS bits
        classes = _opened(classes.mapInArrow(_words_in(table), classes.schema), only)
    more = [] if only is None else ["open"]
    nl = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("line").cast("long")).alias("nl")
    own = ("doc_id", "h", nl, "s1", "s2", *more)
    prefix = F.expr("n - (4 * n + 4) div 5")  # the last place of a prefix
    each = classes.select(*own, prefix.alias("prefix"), F.explode("words").alias("w"))
    found = _joined(each.filter(_at() <= F.col("prefix")).select(*_INDEX, *more), block, attempts)
    large = found.filter("kind = 1").select("w", *_INDEX[1:], F.col("nl").bitwiseAND(F.lit(_LOW)).cast("int").alias("line"))
    out = [found.filter("kind <> 1")]
    if not large.isEmpty():
        # a member meets those that share its next word too; it overlaps by one more than the place of that word tells
        by_next = classes.join(large.select(*_SIDE, F.shiftright("w", 16).alias("first"), _at().alias("first_at")), [*_SIDE])
        by_next = by_next.select(*own, "first", "first_at", F.explode("words").alias("w"))
        by_next = by_next.filter((_at() > F.col("first_at")) | (_at() == _PLACE) & (F.shiftright("w", 16) != F.col("first")))
        pair = F.shiftleft(F.xxhash64("first", F.shiftright("w", 16)), 16).bitwiseOR(_at() - 1)
        second = _joined(by_next.withColumn("w", pair).select(*_INDEX, *more), block, attempts)
        out.append(second.filter("kind <> 1"))
        still = second.filter("kind = 1").select(*_INDEX, F.col("nl").bitwiseAND(F.lit(_LOW)).cast("int").alias("line"))
        if not still.isEmpty():
            still = (_opened(still, only) if more else still).withColumn("key", F.shiftright("w", 16))
            sizes = still.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / block).cast("int").alias("blocks"))
            dealt = still.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64(*_SIDE), "blocks").cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            pair = F.shiftleft(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")), 16).bitwiseOR(_at())
            out.append(_joined(dealt.withColumn("w", pair).select(*_INDEX, *more), 1 << 62, attempts))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select("kind", "doc_id", "h", F.col("nl").bitwiseAND(F.lit(_LOW)).cast("int").alias("line"), *(f"x_{c}" for c in _SIDE), "gap")


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, number, texts = [], [], []
        for i, (text, lines) in enumerate(zip(batch.column("text"), batch.column("lines").to_pylist(), strict=True)):
            split = text.as_py().split("\n")
            doc += [i] * len(lines)
            number += lines
            texts += [split[k] for k in lines]
        doc = pa.array(doc, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(doc), batch.column("h").take(doc), pa.array(number, pa.int32()), pa.array(texts, pa.string())], [*_SIDE, "text"])


def _line_texts(named: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, h, line, text) of all lines that candidates name."""
    ends = candidates.select(*_SIDE).union(candidates.select(*(f"x_{c}" for c in _SIDE)))
    wanted = ends.groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines"))  # lines of one document
    texts = named.join(wanted, ["doc_id", "h"]).mapInArrow(_texts_of, "doc_id long, h long, line int, text string")
    return materialize(texts.dropDuplicates([*_SIDE]), "lines")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for own, other in zip(batch.column("text"), batch.column("x_text"), strict=True):
            a, b = set(own.as_py().encode("utf-8", "surrogatepass").split()), set(other.as_py().encode("utf-8", "surrogatepass").split())
            common = len(a & b)
            keep.append(5 * common >= 4 * (len(a) + len(b) - common))
        yield batch.select([*_SIDE]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those y of pairs whose line matches the line of one of their x."""
    other = texts.select(*(F.col(c).alias(f"x_{c}") for c in _SIDE), F.col("text").alias("x_text"))
    both = pairs.join(other, [f"x_{c}" for c in _SIDE]).join(texts, [*_SIDE])
    return both.select(*_SIDE, "text", "x_text").mapInArrow(_alike, "doc_id long, h long, line int").distinct()


def _matched(named: DataFrame, classes: DataFrame, block: int, attempts: int) -> DataFrame:
    """Classes (by their first line) that an earlier class matches."""
    found = _candidate_pairs(classes, block, attempts)
    x = [f"x_{c}" for c in _SIDE]
    tried = found.filter("kind = 0")
    texts = _line_texts(named, tried)
    likeliest = F.min(F.struct("gap", *x)).alias("best")
    best = materialize(tried.groupBy(*_SIDE).agg(likeliest).select(*_SIDE, "best.*"), "likeliest", "snappy")
    matched = materialize(_verified(best, texts), "matched", "snappy")
    # the others of those that failed
    others = tried.select(*_SIDE, *x).join(matched, [*_SIDE], "left_anti").distinct().join(best, [*_SIDE, *x], "left_anti")
    matched = matched.union(materialize(_verified(others, texts), "matched", "snappy"))
    rest = materialize(found.filter("kind = 2").select(*_SIDE).distinct().join(matched, [*_SIDE], "left_anti"), "rest", "snappy")
    if not rest.isEmpty():
        # every candidate of the few classes that had more than were tried
        every = _candidate_pairs(classes, block, 1 << 62, rest).select(*_SIDE, *x).distinct()
        every = materialize(every, "every", "snappy")
        matched = matched.union(materialize(_verified(every, _line_texts(named, every)), "matched", "snappy"))
    return matched


def line_classes(docs: DataFrame) -> DataFrame:
    """One row a class of equal word sets: its first line, its size and sketches, and the words to index."""
    named = _named(docs)
    steps = docs.sparkSession.sparkContext.broadcast(rarity_steps(named))  # SLOTS bytes
    lines = named.mapInArrow(_line_rows(steps), _LINE)
    first = lines.groupBy("c1", "c2", F.col("n").alias("_n")).agg(F.min(F.struct(*_SIDE, "n", "s1", "s2", "words")).alias("f"))
    return materialize(first.select("f.*"), "classes")


def kept_lines(docs: DataFrame, block: int = BLOCK, attempts: int = TRY) -> DataFrame:
    """(doc_id, h, line) of all lines with words that no earlier line matches; h is the XXH64 of the document's text."""
    ship(docs.sparkSession)
    classes = line_classes(docs)
    return classes.select(*_SIDE).join(_matched(_named(docs), classes, block, attempts), [*_SIDE], "left_anti")


def _rebuilt(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, stay in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("stay").to_pylist(), strict=True):
                lines, stay = text.as_py().split("\n"), set(stay or ())
                left = [x for i, x in enumerate(lines) if i in stay or not x.strip(_BLANK)]
                kept = "\n".join(left)
                row = (doc_id, len(lines), len(lines) - len(left), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, kept) if with_text else row)
            names = ["doc_id", "n_lines", "n_removed", "kept_sha256", *["kept_text"] * with_text]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(names), types, strict=False)], names)

    return run


def dedup_lines(docs: DataFrame, with_text: bool = False, block: int = BLOCK, attempts: int = TRY) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept_sha256 (the kept lines joined by \\n); with_text adds kept_text."""
    stay = kept_lines(docs, block, attempts).groupBy("doc_id", "h").agg(F.collect_list("line").alias("stay"))  # lines of one document
    stay = materialize(stay, "stay")
    out = _named(docs).join(stay, ["doc_id", "h"], "left").mapInArrow(
        _rebuilt(with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    )
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NULL_ID + 1} - 1)"))
