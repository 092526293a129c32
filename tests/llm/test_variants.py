"""Spelling variants against all pairs of words, with awkward documents, small tries and small broadcasts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, root string"


def edit(rng, w):
    at, c = rng.randrange(len(w)), rng.choice("abcéÿ×")
    return rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w + c])


def apart(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    form, out = {}, {}
    for w, k in n.items():
        near = sorted((-n[v], v) for v in n if apart(w, v))
        out[w] = [k, len(near), None, None]
        if near and -near[0][0] >= 5 * k:
            form[w] = near[0][1]
            out[w][2:] = [near[0][1], -near[0][0]]
    for w, row in out.items():
        end = w
        while end in form:
            end = form[end]
        row.append(end)
    return {w: tuple(r) for w, r in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10))) for _ in range(50)] + ["aaaaaaa", "aaaaaaaa", "abababab", "aàÿ÷×öab", "Ünïcödé"]
    near = [edit(rng, w) for w in base for _ in range(4)]
    near += [edit(rng, w) for w in near]
    out = [(i, " ".join([*rng.choices(base, k=90), *rng.choices(near, k=70)]).replace("abc", "aBC")) for i in range(60)]
    out += [(None, None), (None, "aaaaaaa-aaaaaaa " * 4), (3, ""), (4, " \t"), (5, ("word" * 2000 + " ") * 9), (6, ("word" * 1999 + "wrd ") * 6), (7, "—aaaaaaa‘bcdébcd’ 日本語aaaaaaa"), out[4], out[4]]
    out += [(100 + i, "kettle " * (5 if i == 0 else 0) + "kettles " * (3 * (i < 12)) + "nettles " * 20) for i in range(20)]  # a chain of forms
    return out


@pytest.mark.parametrize(("letters", "limit"), [(1 << 20, 1 << 26), (300, 60_000)])
def test_variants(spark, rows, letters, limit):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(4)
    found = variants.group_variants(docs, letters, limit)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()}
    expected = brute(rows)
    assert got == expected
    assert sum(r[2] is not None for r in expected.values()) > 20 and any(w != r[4] != r[2] and r[2] for w, r in expected.items())


def test_no_words(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.group_variants(spark.createDataFrame([(1, "few words only", "x", 1, "y")], SCHEMA)).count() == 0


def test_trie_accepts_each_near_word_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 7))).encode("latin-1") for _ in range(400)})
    trie = variants.Trie.of(words, np.arange(len(words)))
    x, y = trie.near(variants.Packed.of(words))
    pairs = Counter(zip(x.tolist(), y.tolist(), strict=True))
    assert set(pairs.values()) == {1}
    assert set(pairs) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if apart(a, b)}
