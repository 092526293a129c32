"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

1. Words are runs of letters, counted in the tasks that read the texts and then over all documents; with less than `LEAST_LETTERS`
   letters or `LEAST_COUNT` occurrences they are left out.
2. The words, in ranges of their order, are built into tries of at most `LETTERS` letters each: per node two words of 64
   bits that tell which letters follow, and where its children begin. Tries go to the tasks by broadcasts of at most `BROADCAST` bytes,
   one broadcast after another.
3. A word's automaton of distance one is walked through every trie depth-first: with no edit used, or with one. A run of equal letters
   is shortened at its first letter and lengthened at its end, so every near word is accepted once. Blocks of words go together.
4. Each word and broadcast gives one row: how many near words, and the most frequent of them. Rows are reduced by word.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string in the deletion rule. Rows are counted as they
are, repeated ones too. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, ship, shuffle_partitions

LEAST_LETTERS, LEAST_COUNT, DELETE_EVERY, RATIO = 6, 5, 199, 5
LETTERS, BROADCAST, BLOCK = 1 << 20, 1 << 26, 4096
_HELD = 1 << 24  # bytes of words counted together
#: Letters a to z and those of U+00C0 to U+00FF, in UTF-8, where text is lower-cased.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_FIRST_HIGH = 26  # place of U+00C0 among the letters


def _counted(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(_RUN.findall(text.as_py().lower())).items():  # lower() of bytes: A-Z only
                    h = zlib.crc32(word, start)
                    if not h % every:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) - word.count(0xC3) >= least:
                        if word not in counts:
                            held += len(word) + 100
                        counts[word] += n
                if held >= _HELD:
                    yield out()
                    counts, held = Counter(), 0
        yield out()

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = DELETE_EVERY) -> DataFrame:
    """(word, n) over all documents."""
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(least_letters, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _places(word: bytes | np.ndarray) -> np.ndarray:
    """Letters in latin-1 as places in the alphabet."""
    b = np.frombuffer(word, np.uint8) if isinstance(word, bytes) else word
    return np.where(b < 0x80, b - ord("a"), b - (0xC0 - _FIRST_HIGH)).astype(np.uint8)


@dataclass
class Packed:
    """Words one after another: places of their letters, where each begins, how long it is."""

    places: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Packed:
        sizes = np.array([len(w) for w in words], np.int64)
        return cls(_places(b"".join(words)), np.cumsum(sizes) - sizes, sizes)


@dataclass
class Trie:
    low: np.ndarray  # per node: which of the letters 0 to 63 follow
    high: np.ndarray
    first: np.ndarray  # per node: its first child; children stand together, in order of their letters
    letter: np.ndarray  # per node: the letter that leads to it
    ends: np.ndarray  # per node: the word that ends there, or -1
    words: list[bytes]
    n: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], n: np.ndarray) -> Trie:
        """words: distinct and in order."""
        p = Packed.of(words)
        nodes = 1 + int(p.sizes.sum())
        low, high, first = np.zeros(nodes, np.uint64), np.zeros(nodes, np.uint64), np.zeros(nodes, np.int32)
        letter, ends, at, made = np.zeros(nodes, np.uint8), np.full(nodes, -1, np.int32), np.zeros(len(words), np.int64), 1
        alive = np.arange(len(words))
        for depth in range(int(p.sizes.max(initial=0))):
            alive = alive[p.sizes[alive] > depth]
            parent, mine = at[alive], p.places[p.starts[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (mine[1:] != mine[:-1])
            at[alive] = made + np.cumsum(new) - 1
            parent, mine, child = parent[new], mine[new], np.arange(made, made + int(new.sum()))
            bit = np.uint64(1) << (mine & 63).astype(np.uint64)
            np.bitwise_or.at(low, parent[mine < 64], bit[mine < 64])
            np.bitwise_or.at(high, parent[mine >= 64], bit[mine >= 64])
            first[parent[::-1]] = child[::-1]  # the first of a parent's children is written last
            letter[child] = mine
            made += len(child)
            done = alive[p.sizes[alive] == depth + 1]
            ends[at[done]] = done
        return cls(low[:made], high[:made], first[:made], letter[:made], ends[:made], words, n)

    def child(self, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The child that a letter leads to, 0 where there is none."""
        bit = np.uint64(1) << (place & 63).astype(np.uint64)
        up = place >= 64
        low, high = self.low[node], self.high[node]
        side = np.where(up, high, low)
        before = np.bitwise_count(side & (bit - np.uint64(1))) + np.where(up, np.bitwise_count(low), 0)
        return np.where(side & bit, self.first[node] + before, 0)

    def near(self, p: Packed) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of p, word of this trie) that are exactly one edit apart, each once."""
        found_x, found_y = [], []
        every = np.arange(len(p.sizes))
        stack = [(0, every, np.zeros(len(every), np.int64), np.zeros(len(every), np.int64))]  # edits, word, node, place in the word

        def follow(x, node, at):
            child = self.child(node, p.places[p.starts[x] + at])
            live = child > 0
            return x[live], child[live].astype(np.int64), at[live] + 1

        while stack:
            edits, x, node, at = stack.pop()
            more = at < p.sizes[x]
            if edits:
                here = self.ends[node[~more]]
                found_x.append(x[~more][here >= 0])
                found_y.append(here[here >= 0])
                if more.any():
                    stack.append((1, *follow(x[more], node[more], at[more])))
                continue
            if not len(x):
                continue
            stack.append((0, *follow(x[more], node[more], at[more])))
            mine = np.full(len(x), 255, np.uint8)
            mine[more] = p.places[p.starts[x[more]] + at[more]]
            kids = (np.bitwise_count(self.low[node]) + np.bitwise_count(self.high[node])).astype(np.int64)
            of = np.repeat(np.arange(len(x)), kids)
            child = np.arange(len(of)) - np.repeat(np.cumsum(kids) - kids, kids) + self.first[node[of]]
            other = self.letter[child] != mine[of]
            of, child = of[other], child[other]
            changed = more[of]
            before = np.full(len(x), 254, np.uint8)
            before[at > 0] = p.places[p.starts[x[at > 0]] + at[at > 0] - 1]
            drop = more & (before != mine)
            parts = [(x[of], child, at[of]), (x[of[changed]], child[changed], at[of[changed]] + 1), (x[drop], node[drop], at[drop] + 1)]
            stack.append((1, *(np.concatenate(c) for c in zip(*parts, strict=True))))
        return np.concatenate(found_x or [np.zeros(0, np.int64)]), np.concatenate(found_y or [np.zeros(0, np.int64)])


_ARRAYS = ("low", "high", "first", "letter", "ends", "n")
_SHARD = "first_word string, letters long, words binary, sizes binary, " + ", ".join(f"{k}_ binary" for k in _ARRAYS)
_TYPES = dict(zip(_ARRAYS, ("<u8", "<u8", "<i4", "<u1", "<i4", "<i8"), strict=True))


def _built(letters: int):
    """Of rows (word, n) in order, tries of at most `letters` letters (or one longer word), as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, held = [], [], 0

        def out() -> pa.RecordBatch:
            trie = Trie.of(words, np.array(n, np.int64))
            row = [words[0].decode("latin-1"), held, b"".join(words), np.array([len(w) for w in words], "<i4").tobytes(), *(getattr(trie, k).astype(_TYPES[k]).tobytes() for k in _ARRAYS)]
            types = [pa.string(), pa.int64(), *[pa.binary()] * (2 + len(_ARRAYS))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                word = word.encode("latin-1")
                if words and held + len(word) > letters:
                    yield out()
                    words, n, held = [], [], 0
                words.append(word)
                n.append(count)
                held += len(word)
        if words:
            yield out()

    return run


def shards(vocab: DataFrame, letters: int = LETTERS) -> DataFrame:
    """Tries over ranges of vocab(word, n), one a row."""
    total = vocab.agg(F.sum(F.length("word"))).first()[0] or 0
    ranges = max(1, math.ceil(2 * total / letters))
    return vocab.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(_built(letters), _SHARD)


def _opened(row) -> Trie:
    sizes = np.frombuffer(row["sizes"], "<i4")
    ends = np.cumsum(sizes).tolist()
    words = [bytes(row["words"][e - s : e]) for e, s in zip(ends, sizes.tolist(), strict=True)]
    arrays = {k: np.frombuffer(row[f"{k}_"], t) for k, t in _TYPES.items()}
    return Trie(arrays["low"], arrays["high"], arrays["first"], arrays["letter"], arrays["ends"], words, arrays["n"])


def _searched(shared):
    """(word, n_near, near_n, near): of each word that has near words in the shared tries, their count and the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [_opened(row) for row in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                words = part.column("word").to_pylist()
                packed = Packed.of([w.encode("latin-1") for w in words])
                count, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [b""] * len(words)
                for trie in tries:
                    x, y = trie.near(packed)
                    count += np.bincount(x, minlength=len(words))
                    order = np.lexsort((y, -trie.n[y], x))  # words of a trie are numbered in their order
                    x, y = x[order], y[order]
                    lead = np.ones(len(x), bool)
                    lead[1:] = x[1:] != x[:-1]
                    for i, j in zip(x[lead].tolist(), y[lead].tolist(), strict=True):
                        if trie.n[j] > best_n[i] or (trie.n[j] == best_n[i] and trie.words[j] < best[i]):
                            best_n[i], best[i] = trie.n[j], trie.words[j]
                some = np.flatnonzero(count)
                cols = [pa.array([words[i] for i in some]), pa.array(count[some]), pa.array(best_n[some]), pa.array([best[i].decode("latin-1") for i in some])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

    return run


def near_words(vocab: DataFrame, letters: int = LETTERS, limit: int = BROADCAST) -> DataFrame:
    """(word, n_near, near_n, near): near words of vocab(word, n) within vocab, their count and the most frequent (ties: the least)."""
    spark = vocab.sparkSession
    ship(spark)
    tries = materialize(shards(vocab, letters), "tries")
    words = materialize(vocab.select("word").repartition(shuffle_partitions(spark)), "words")
    found = []

    def search(group: list) -> None:
        shared = spark.sparkContext.broadcast([r.asDict() for r in group])
        found.append(materialize(words.mapInArrow(_searched(shared), "word string, n_near long, near_n long, near string"), "near"))
        shared.destroy()

    group, held = [], 0
    for row in tries.toLocalIterator():  # one part of a bounded size after another, never all of them
        size = sum(len(v) for v in row if isinstance(v, bytes | bytearray))
        if group and held + size > limit:
            search(group)
            group, held = [], 0
        group.append(row)
        held += size
    search(group)
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms(word, form) that starts at a word ends. Chains are halved round by round."""
    to = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = to.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        to = materialize(step, "roots")
        if to.filter("moved").isEmpty():
            return to.drop("moved")
        to = to.drop("moved")


def group_variants(docs: DataFrame, letters: int = LETTERS, limit: int = BROADCAST, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    The form is the near word of largest n (ties: the least in code-point order) if that n is at least `ratio` times the word's, so
    chains of forms end; the root is the end of the chain.
    """
    ship(docs.sparkSession)
    vocab = materialize(vocabulary(docs), "vocabulary")
    own = vocab.join(near_words(vocab, letters, limit), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    named = own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    named = materialize(named, "forms")
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
