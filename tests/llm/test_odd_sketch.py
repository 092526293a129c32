"""Near-duplicates against all pairs of sets; recall over planted edits; the sketch's limit against random pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import odd_sketch

from .conftest import make, words

WS = "[\x20\x09-\x0d]+"


def sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(WS, low) if x]
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    s = [sets(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(s):
        for j in range(i):
            if a and s[j] and 100 * len(a & s[j]) >= 85 * len(a | s[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    out = Counter()
    for i, (doc_id, _, _) in enumerate(rows):
        least = min((x for x in ids[find(i)] if x is not None), default=None)
        out[doc_id, len(s[i]), least, doc_id == least] += 1
    return out


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def grouped():
    """Groups with edits of every strength, so that chains, failing hubs and pairs just below the threshold arise."""
    rng = random.Random(6)
    rows = []
    for size in (2, 3, 30, 60):
        base = words(rng, 120, 5000)
        rows += [(rng.randrange(10**6), edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.04, 0.06])), "s") for _ in range(size)]
    chain = words(rng, 100, 5000).split()
    for i in range(25):
        chain[rng.randrange(100)] = f"c{i}"
        rows.append((2_000_000 - i, " ".join(chain).upper() if i % 5 == 0 else "\n".join(chain), "s"))
    return rows


def found(table, **blocks):
    out = odd_sketch.near_components(table, **blocks)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect())


@pytest.mark.parametrize("blocks", [{}, {"block_words": 600, "block_classes": 7}])
def test_groups(spark, grouped, blocks):
    assert found(make(spark, grouped).repartition(4), **blocks) == brute(grouped)


def test_awkward_rows(spark, docs, rows, empty):
    assert found(empty) == Counter()
    more = [(None, rows[5][1], "s"), (None, None, None), (None, "", "s"), (None, "x y z", "s"), (None, "X  y Z", "s"), (77, "x y", "s"), (77, "x y", "s"), (77, "y x", "s"), (78, "y x", "s")]
    assert found(make(spark, rows + more).repartition(5)) == brute(rows + more)


@pytest.mark.parametrize(("size", "percent", "share"), [(3, 85, 0.025), (5, 80, 0.021)])
def test_recall_over_planted_edits(spark, size, percent, share):
    """Pairs whose Jaccard is from the threshold to 0.05 above it, where bands and sketches have the least to spare."""
    rng = random.Random(9)
    rows, pairs = [], 0
    while pairs < 400:
        text = words(rng, 90, 50_000)
        other = edited(rng, text, share)
        a, b = (odd_sketch.shingles(odd_sketch.words_of(t), size) for t in (text, other))
        if percent <= 100 * len(a & b) / len(a | b) <= percent + 5:
            rows += [(2 * pairs, text, "s"), (2 * pairs + 1, other, "s")]
            pairs += 1
    signed, classes = odd_sketch.rooted_classes(make(spark, rows), {}, size, percent)
    roots = {r.doc_id: r.root for r in signed.join(classes, "digest").select("doc_id", "root").collect()}
    assert len(set(roots.values())) == pairs and all(roots[2 * i] == roots[2 * i + 1] for i in range(pairs))


def test_sketch_limit():
    rng = random.Random(10)
    limit = odd_sketch.odd_limit()
    at, far = [], []
    for _ in range(300):
        base = [f"w{rng.randrange(10**7)}".encode() for _ in range(1000)]
        near = base[:919] + [f"x{rng.randrange(10**7)}".encode() for _ in range(81)]  # Jaccard 0.85
        a, b = (odd_sketch.signature(x)[1].view(np.uint64) for x in (base, near))
        c = odd_sketch.signature(base[::-1])[1].view(np.uint64)
        at.append(int(np.bitwise_count(a ^ b).sum()))
        far.append(int(np.bitwise_count(a ^ c).sum()))
    assert max(at) <= limit < min(far) and 40 < np.mean(at) < 50
