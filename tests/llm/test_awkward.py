"""Null and repeated ids, unlike texts of one id, repeated rows, empties and clashing columns through every operator and stage."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import exact_dedup, html_text, minhash, mixing, packing, quality, sharding, simhash, substring_dedup

from .conftest import make, words
from .test_operators import WS, repeats, text_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(12)
    a, b, c, d, e = (words(rng, 90, 5000) for _ in range(5))
    return [
        (None, a, "s"), (None, b, None), (None, None, "s"), (None, "", None), (None, a, "s"), (1, c, "s"), (1, d, "t"), (1, c + " end", "s"), (2, e, "s"), (2, e, "s"),
        (3, None, None), (4, "", "s"), (5, d, "s"), (6, " ".join(c.split()[:50] + a.split()[:50]), "s"), (-7, words(rng, 5000, 3000), "hot"),
    ]


@pytest.fixture(scope="module")
def table(spark, awkward):
    return make(spark, awkward).repartition(3).cache()


def norm(t):
    return re.sub(WS, " ", text_of(t))


def test_shards(table, awkward):
    out = sharding.shard_by_bytes(table).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len(text_of(t).encode()) + 1, zlib.crc32(text_of(t).encode())) for i, t, _ in awkward)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_simhash(table, awkward):
    out = simhash.near_groups(table).collect()
    fps = [simhash.fingerprint(t) for _, t, _ in awkward]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{f:016x}") for (i, _, _), f in zip(awkward, fps, strict=True))
    group = {}
    for f in fps:
        reach, grown = {f}, True
        while grown:
            more = {g for g in fps if any((g ^ x).bit_count() <= 4 for x in reach)}
            grown, reach = more != reach, more
        ids = [i for (i, _, _), g in zip(awkward, fps, strict=True) if g in reach and i is not None]
        group[f"{f:016x}"] = min(ids, default=None)
    assert all(r.component_id == group[r.fingerprint] for r in out)


def test_packing(table, awkward):
    out = packing.pack(table).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, _, _ in awkward)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == list(np.cumsum([0, *(n for _, n in sorted(x))])[:-1]) for x in bins.values())


def test_substrings(table, awkward):
    out = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table).collect())
    assert out == Counter((i, len(d), sum(c), hashlib.sha256(" ".join(w for w, x in zip(d, c, strict=True) if not x).encode()).hexdigest()) for (i, _, _), (d, c) in zip(awkward, repeats(awkward), strict=True))


def test_exact(table, awkward):
    out = exact_dedup.exact_groups(table).collect()
    groups = defaultdict(list)
    for i, t, _ in awkward:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    assert Counter((r.text_sha256, r.doc_id) for r in out) == Counter((k, i) for k, g in groups.items() for i in g)
    for k, g in groups.items():
        mine = [r for r in out if r.text_sha256 == k]
        least = min((i for i in g if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in mine} == {(least, len(g))} and [r.doc_id for r in mine if r.kept] == [least]


def test_fingerprints(table, awkward):
    out = minhash.fingerprint_documents(table).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((i, len(text_of(t))) for i, t, _ in awkward)
    assert {minhash.base64.b64encode(minhash.signature(text_of(t)).tobytes()).decode() for _, t, _ in awkward} == {r.fingerprint for r in out}


def test_mixing(table, awkward):
    out = mixing.mix_positions(table, {"s": 2, "*": 1}).collect()
    assert sorted(r.position for r in out) == list(range(len(awkward))) and Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in awkward)


def test_quality(spark, table, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (5, 0, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scores(table, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in awkward) and all(r.held_out for r in out if r.doc_id is None) and all(0 <= r.score <= 1 for r in out)


def test_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    rows = [(None, None, "<p>a plain sentence that stands alone on its page.</p>"), (1, None, None), (1, "u", "<p"), (1, "u", "<p")]
    out = html_text.extract(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars long, text string")).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in out) == Counter([(None, None, 47), (1, None, 0), (1, "u", 0), (1, "u", 0)])


def test_stages(spark, table, awkward):
    rows = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    everything = Counter(awkward)
    kept = stages["quality classifier"](spark, table, SF)
    assert kept.columns == table.columns and not rows(kept) - everything
    exact = stages["exact dedup"](spark, table, SF)
    assert exact.columns == table.columns and not rows(exact) - everything
    assert Counter(norm(r.text) for r in exact.collect()) == Counter({norm(t) for _, t, _ in awkward})
    near = stages["simhash near-dedup"](spark, table, SF)
    groups = {r.component_id for r in simhash.near_groups(table).collect()}
    assert near.columns == table.columns and not rows(near) - everything and len(groups) <= near.count() < len(awkward)
    mixed = stages["mixing"](spark, table, SF)
    assert mixed.columns == table.columns and rows(mixed) == everything
    assert Counter(r.doc_id for r in stages["best-fit packing"](spark, table, SF).collect() if r.piece == 0) == Counter(i for i, _, _ in awkward)
    empty = table.filter("false")
    for stage in stages.values():
        assert stage(spark, empty, SF).count() == 0
