"""Vector codes against all distances, with awkward rows and planted ties."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v string, part int, code long"


def made(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, 2) for i, v, k in rows], SCHEMA).repartition(3)


def brute(rows):
    """Counter of (vec_id, code, error, label_error) and the digest, by plain integers."""
    kept = []
    for i, v, k in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        bound = vector_codes._bound(len(v))
        kept.append((i, [max(-bound, min(bound, math.floor(1024 * x))) for x in v], k))
    if not kept:
        return Counter(), ""
    first = min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(first[1])]
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    d = len(first[1])
    at = [d * p // 4 for p in range(5)]
    ids = sorted(least, key=lambda i: (i is None, i or 0))[:256]
    books = [[least[i][at[p] : at[p + 1]] for i in ids] for p in range(4)]

    def nearest(p, v):
        q = v[at[p] : at[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(4):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[p, nearest(p, v)[1]].append(v[at[p] : at[p + 1]])
        for (p, j), members in groups.items():
            books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, label = [], Counter()
    for i, v, k in kept:
        found = [nearest(p, v) for p in range(4)]
        error = sum(e for e, _ in found)
        label[k] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, k))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, label[k]) for i, c, e, k in out), sha


def check(spark, rows):
    out = vector_codes.compress(made(spark, rows)).collect()
    expected, sha = brute(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in out) == expected
    assert {r.codebooks_sha256 for r in out} == ({sha} if out else set())


def test_many_vectors(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(30)]
    rows = [(7 * i, [x + rng.gauss(0, 0.05) for x in centres[i % 30]], None if i % 3 == 0 else i % 11) for i in range(700)]
    rows += [(1, None, 1), (2, [0.1] * 11 + [None], 1), (3, [float("nan")] * 12, 2), (4, [float("inf")] + [0.0] * 11, 2), (5, [0.5] * 8, 3)]
    rows += [(None, [0.2] * 12, 50), (14, [0.3] * 12, 51), rows[2], rows[2]]  # a null and a repeated id, repeated rows
    check(spark, rows)


@pytest.mark.parametrize("values", [[-1.0, 0.0, 1.0], [1e300, -1e300, 3e5, -2e5, 0.25]])
def test_ties_repeats_and_large_values(spark, values):
    rng = random.Random(5)
    check(spark, [(i, [rng.choice(values) for _ in range(9)], i % 2) for i in range(330)])


def test_few_rows(spark):
    check(spark, [])
    check(spark, [(None, [0.1, 0.2, 0.3, 0.4], None)])
    check(spark, [(3, [], 1), (4, [], None)])
    check(spark, [(1, [0.1, 0.9], 1), (1, [0.1, 0.2], 1), (2, [-0.001, 0.4], None)])


def test_tree_finds_the_nearest():
    rng = np.random.default_rng(2)
    for spread in (3, 200, 1 << 27):
        entries = rng.integers(-spread, spread + 1, (256, 5))
        book = vector_codes.Codebook(entries)
        q = rng.integers(-spread, spread + 1, (500, 5))
        place, best = book.nearest(q)
        every = vector_codes.squared(q, entries)
        assert (place == every.argmin(1)).all() and (best == every.min(1)).all()
        assert len(book.leaves) > 16
