"""The pipeline stage by stage, and its result against the stages' own definitions."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from scriptorium.llm import quality, simhash
from scriptorium.llm.mixing import mix_positions

from .conftest import make, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.scores(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r.predicted}
    assert set(seen["quality classifier"]) == good
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", whole[i] or "") for i in good}
    first = {}
    for i in sorted(good):
        first.setdefault(norm[i], i)
    assert set(seen["exact dedup"]) == set(first.values())
    fps = {i: simhash.fingerprint(t) for i, t in seen["exact dedup"].items()}
    for i in seen["exact dedup"]:
        near = [j for j in seen["simhash near-dedup"] if (fps[i] ^ fps[j]).bit_count() <= 4]
        if i in seen["simhash near-dedup"]:
            assert near == [i]
    assert seen["mixing"] == seen["simhash near-dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(seen["mixing"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_packing_follows_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixing, packing = (stage for _, stage in corpus_pipeline.STAGES[-2:])
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    got = {}
    for name, df in (("mixed", mixing(spark, docs, SF)), ("as they were", docs)):
        df.write.parquet(str(tmp_path / name))
        got[name] = packing(spark, spark.read.parquet(str(tmp_path / name)), SF).select(*columns).collect()
    assert set(got["mixed"]) != set(got["as they were"])  # without the mixing stage the rows differ
    assert {r[:5] for r in got["mixed"]} == {r[:5] for r in got["as they were"]}
    place = {r.doc_id: r.position for r in mix_positions(docs).collect()}
    heads = sorted((r for r in got["mixed"] if r.offset == 0), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in heads] == list(range(len(heads)))
    assert [place[r.doc_id] for r in heads] == sorted(place[r.doc_id] for r in heads)
    filled = {}
    for r in got["mixed"]:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 1024


def test_near_stage_keeps_one_row_a_group(spark):
    rng = random.Random(5)
    a, b, c, d, e = (words(rng, 120, 5000) for _ in range(5))
    rows = [(None, a, "s"), (None, b, "s"), (None, None, "s"), (1, c, "s"), (1, d, "s"), (1, a + " end", "s"), (0, d + " end", "s"), (3, e, "s"), (3, e, "s")]
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(a + " end")).bit_count() <= 4 >= (simhash.fingerprint(d) ^ simhash.fingerprint(d + " end")).bit_count()
    kept = corpus_pipeline.near_stage(spark, make(spark, rows), SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, b), (None, None), (1, c), (1, a + " end"), (0, d + " end"), (3, e)])


@pytest.mark.parametrize("blocks", [{}, {"block_words": 1500, "block_classes": 4}])
def test_near_stage_reaches_jaccard_of_shingles(spark, blocks):
    rng = random.Random(6)
    texts = []
    for edits in (0, 1, 2, 3, 4, 5, 6, 8, 12) * 4:
        base = words(rng, 300, 5000).split()
        copy = list(base)
        for at in rng.sample(range(300), edits):
            copy[at] = f"new{at}"
        texts += [" ".join(base), " ".join(copy)]
    hub = words(rng, 300, 5000).split()
    texts += [" ".join([*hub[:at], "other", *hub[at + 1 :]]) for at in range(0, 300, 20)]
    grams = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    parent = list(range(len(texts)))

    def find(n):
        return n if parent[n] == n else find(parent[n])

    for i in range(len(texts)):
        for j in range(i):
            alike = len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8
            if alike or (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = make(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "a b", "s")])
    expected = {find(i) for i in range(len(texts))} | {900, 901}
    kept = simhash.drop_near_copies(docs, jaccard=0.8, **blocks) if blocks else corpus_pipeline.near_stage(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == expected
