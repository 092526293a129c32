"""The operators against brute force on a small corpus with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import exact_dedup, html_pages, html_text, line_dedup, minhash, mixing, packing, quality, sharding, simhash, substring_dedup, words
from scriptorium.llm.components import connected_components

from .conftest import make

WS = "[\x20\x09-\x0d]+"


def text_of(t):
    return t or ""


def test_shards(docs, rows, empty):
    out = sharding.shard_by_bytes(docs).collect()
    assert len(out) == len(rows) and sharding.shard_by_bytes(empty).count() == 0
    total = sum(len(text_of(t).encode()) + 1 for _, t, _ in rows)
    at = 0
    for r in sorted(out, key=lambda r: (r.doc_id, r.text_crc32)):
        assert r.start_byte == at and r.shard == min(15, (2 * at + r["size"]) * 16 // (2 * total))
        at += r["size"]
    crc = Counter((i, zlib.crc32(text_of(t).encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text_crc32) for r in out) == crc
    for slots in Counter_slots(out).values():
        assert sorted(slots) == list(range(len(slots)))


def Counter_slots(out):
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    return slots


def reference_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text_of(text))
    words = [w for w in re.split(WS, low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) > len(shingles):
            bits |= 1 << b
    return bits


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash(docs, rows, empty, block):
    out = simhash.near_groups(docs, block).collect()
    fps = {(i, t): reference_fingerprint(t) for i, t, _ in rows}
    assert Counter(r.fingerprint for r in out) == Counter(f"{fps[i, t]:016x}" for i, t, _ in rows)
    nodes = sorted(set(fps.values()))
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), f in fps.items():
        least[find(f)] = min(least[find(f)], i)
    for r in out:
        assert r.component_id == least[find(int(r.fingerprint, 16))]
    if block > 3:
        assert simhash.near_groups(empty).count() == 0
        kept = simhash.drop_near_copies(docs)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs.columns


def test_simhash_cluster_needs_no_pairs():
    rng = np.random.default_rng(1)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 2, replace=False).astype(np.uint64)) for _ in range(300)], np.uint64)
    members = np.unique(np.uint64(0x123456789ABCDEF0) ^ flips)
    assert len(simhash.spanning_links(members)) == len(members) - 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[103] == 100 and len(found) == 44


def test_html(spark, empty):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><a href=/>Site</a> slogan</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies here</div><div class="ad">Buy now &amp; save</div><article><h1>Head &amp; line</h1><p>First  par\n with <a href="/x">a link</a>.<p>Second <b>bold<br>line</b></p>'
        '<aside>Side story of some length here</aside><ul><li>item one</li></ul><p>&copy; 2020 &#8212; x</p></article><section id="comments"><p>I like this article a lot indeed</p></section><form>Mail <input><button>Go</button></form><footer>&copy; foot</footer>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>Just text & more text without any structure at all here.</p>"), (5, "u", "<nav><a href=x>only menu</a></nav>")]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head & line\nFirst par with a link.\nSecond bold line\nitem one\n© 2020 — x"
    assert out[2].text == out[3].text == out[5].text == "" and out[4].text.startswith("Just text & more")
    assert all(r.n_chars == len(r.text) for r in out.values())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="post-header"><p>An introduction of a few words that opens the page.</p></div><p>More text of the same page follows here.</p>', "An introduction of a few words that opens the page.\nMore text of the same page follows here."),
        ('<p title="a"">hello to all who read this page</p>', "hello to all who read this page"),
        ('<p title="a > b">one tag only here</p>', "one tag only here"),
        ("<p>1 < 2 and 3 > 2 are true as everyone knows", "1 < 2 and 3 > 2 are true as everyone knows"),
        ("<p>cut at its end <a href='x", "cut at its end"),
        ('<div class="with-sidebar"><main><h1>Title</h1><p>Text.</p></main></div>', "Title\nText."),
        ("<p>&amp;lt; &#65;&#x42; &nbsp; x&nbsp;y and so on it goes for a while</p>", "&lt; AB x y and so on it goes for a while"),
        ('<article><p>kept<!-- not > this --> and <![CDATA[ nor this ]]>kept</p><p hidden>no</p><p style="display: none">no</p></article>', "kept and kept"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, html_text.grow(html_text.labelled(html_pages.pages()))) == text


def test_tree_holds_on_pages_left_out():
    """Leave one page out: what README states."""
    pages = html_pages.pages()
    right = total = 0
    for i, page in enumerate(pages):
        rows = html_text.labelled([page])
        tree = html_text.grow(html_text.labelled(pages[:i] + pages[i + 1 :]))
        right += int((html_text.classify(tree, rows[:, :-1]) == rows[:, -1]).sum())
        total += len(rows)
    assert total == 236 and right / total > 0.96
    tree = html_text.grow(html_text.labelled(pages))
    asked = lambda t: set() if len(t) == 1 else {html_text.FEATURES[t[0]]} | asked(t[2]) | asked(t[3])
    assert {"words", "density", "density_before", "density_after"} <= asked(tree)


@pytest.mark.parametrize("unit", ["<div><b>x ", '<a href="x ', "<b><p>x</p>", '=>"<a b="', "<table><tr><td>x", "<!-- ", "</"])
def test_pages_take_time_in_proportion(unit):
    import time

    tree = html_text.grow(html_text.labelled(html_pages.pages()))
    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)), tree)
    assert time.process_time() - began < 20


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_packing(spark, docs, rows, empty):
    t = tokenizer()
    docs = docs.unionByName(make(spark, [(1000, "end of <|endoftext|> text", "s")]))
    rows = [*rows, (1000, "end of <|endoftext|> text", "s")]
    out = packing.pack(docs).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text_of(text), add_special_tokens=False).ids, 2]
        at, piece, n = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want[i, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, piece, n = at + n, piece + 1, 1024
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in out) / 1024) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a b", " lead", "trail ", "two  spaces", "tab\t x", "line\n next", "don't  ", "<|endoftext|> x", "a<|endoftext|>b c", "ünï  çö", "", " ", "\n\n", "x \n y"])
def test_cached_encoding(text):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.encode(text, path), "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_fullest_is_fullest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * m for s in sums for m in range(v + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room) and all(m <= counts[k] for k, m in chosen.items())


def repeats(rows):
    docs = [[w for w in re.split(WS, text_of(t)) if w] for _, t, _ in rows]
    seen = Counter(tuple(d[i : i + 35]) for d in docs for i in range(len(d) - 34))
    for d in docs:
        cover = [False] * len(d)
        for i in range(len(d) - 34):
            if seen[tuple(d[i : i + 35])] > 1:
                cover[i : i + 35] = [True] * 35
        yield d, cover


def test_substrings(docs, rows, empty):
    out = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    want = Counter((i, len(d), sum(c), hashlib.sha256(" ".join(w for w, x in zip(d, c, strict=True) if not x).encode()).hexdigest()) for (i, _, _), (d, c) in zip(rows, repeats(rows), strict=True))
    assert out == want and substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_at_factor_boundaries(spark):
    """Passages of many lengths, overlapping each other, inside one document and across, at its very start and end."""
    import random

    rng = random.Random(8)
    w = [f"t{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a, n = rng.randrange(0, 300), rng.choice([10, 34, 35, 36, 40, 52, 58, 60, 90])
            parts += w[a : a + n] + [rng.choice(w[400:]) for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(parts), "s"))
    out = Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(make(spark, rows)).collect())
    want = Counter((i, sum(c), hashlib.sha256(" ".join(x for x, y in zip(d, c, strict=True) if not y).encode()).hexdigest()) for (i, _, _), (d, c) in zip(rows, repeats(rows), strict=True))
    assert out == want


def test_exact(docs, rows, empty):
    norm = lambda t: re.sub(WS, " ", text_of(t))
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = exact_dedup.exact_groups(docs).collect()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    for r in out:
        g = by_sha[r.text_sha256]
        assert r.doc_id in g and r.keep_id == min(g) and r.group_size == len(g) and (not r.kept or r.doc_id == min(g))
    kept = exact_dedup.drop_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values()) and kept.columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def jaccard(a, b):
    sets = [set(minhash.shingle_hashes(x).tolist()) for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_minhash(docs, rows, empty):
    out = minhash.fingerprint_documents(docs).collect()
    order = sorted({(i, text_of(t)) for i, t, _ in rows})
    assert len(out) == len(rows) and minhash.fingerprint_documents(empty).count() == 0
    by_text = defaultdict(set)
    want = {}
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        want[i] = (t, following)
    repeated = [i for i, n in Counter(i for i, _, _ in rows).items() if n > 1]
    for r in out:
        if r.doc_id in repeated:
            continue
        t, following = want[r.doc_id]
        new = minhash.edited(t, following)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, new)) < 0.17 and abs(r.near_next - jaccard(t, following)) < 0.17
        by_text[" ".join(t.split())].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_minhash_bias():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"x{v}" for v in rng.integers(0, 10**6, 400)) for _ in range(80)]
    unlike = [minhash.likeness(minhash.signature(a), minhash.signature(b)) for a, b in zip(texts, texts[1:], strict=False)]
    assert np.mean(unlike) < 0.01


def test_mixing(docs, rows, empty):
    weights = {"hot": 3, "s1": 1, "s2": 2, "*": 4}
    out = sorted(mixing.mix_positions(docs, weights, blocks=60).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(len(rows))) and mixing.mix_positions(empty).count() == 0
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in rows)
    mixed = mixing.mixed(docs, weights, 60)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_mixing_is_row_by_row_at_any_size(spark):
    weights = {"a": 4, "b": 2, "c": 3, "e": 0, "*": 1}
    counts = {"a": 2500, "b": 1100, "c": 900, "e": 40, "*": 700}
    rows = [(i, "", k if k != "*" else f"x{i % 3}") for i, k in enumerate(k for k, n in counts.items() for _ in range(n))]
    out = sorted(mixing.mix_positions(make(spark, rows), weights).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in rows)
    assert [(r.mix_class, r.block, r.release, r.deadline, r.phase) for r in out] == mixing.pfair_order(counts, weights)


def test_pfair_stays_within_a_block():
    weights = {"a": 5, "b": 3, "c": 1, "d": 7, "e": 0}
    blocks = {"a": 90, "b": 120, "c": 40, "d": 33, "e": 4}
    order = mixing.pfair_order(blocks, weights)
    assert Counter(k for k, *_ in order) == blocks
    left, at, phase = dict(blocks), 0, 0
    while at < len(order):
        active = {k: Fraction(weights[k]) for k, n in left.items() if n}
        total, done, now = sum(active.values()), Counter(), 0
        while at < len(order) and order[at][4] == phase:
            k, _, release, due, _ = order[at]
            if total:
                assert release <= now < due
            done[k] += 1
            left[k] -= 1
            at, now = at + 1, now + 1
            if total:
                assert all(abs(done[s] - w / total * now) < 1 for s, w in active.items())
        phase += 1


def spark_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def line_matches(rows):
    """Removed lines by (id, text): documents in order of id (null first), then of their texts' hashes."""
    seen, gone = [], defaultdict(set)
    for i, t in sorted({(i, text_of(t)) for i, t, _ in rows}, key=lambda d: (d[0] is not None, d[0] or 0, spark_hash(d[1]))):
        for n, line in enumerate(t.split("\n")):
            s = set(re.split(WS, line)) - {""}
            if s:
                if any(len(s & o) * 5 >= 4 * len(s | o) for o in seen):
                    gone[i, t].add(n)
                seen.append(s)
    return gone


@pytest.fixture(scope="session")
def line_rows():
    import random

    rng = random.Random(5)
    base = [[f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 5)):
                line[rng.randrange(len(line))] = f"v{rng.randrange(300)}"
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines), "s"))
    return [*rows, (100, None, "s"), (101, "", "s"), (102, "\n \n", "s"), (103, " ".join(f"v{k}" for k in range(3000)), "s"), (104, "v1", "s"), (105, "v1\nv1", "s")]


@pytest.mark.parametrize(("block", "attempts"), [(4096, 2), (10, 1), (2, 1)])
def test_lines(spark, line_rows, empty, block, attempts):
    line_rows = [*line_rows, (2, "a wholly different only line here", "s"), (2, line_rows[9][1], "s"), (None, line_rows[3][1], "s"), (None, "no id here", None), (None, "no id here", "s")]
    gone = line_matches(line_rows)
    out = line_dedup.dedup_lines(make(spark, line_rows), True, block, attempts).collect()
    want = Counter()
    for i, t, _ in line_rows:
        lines = text_of(t).split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone[i, text_of(t)])
        want[i, len(lines), len(gone[i, text_of(t)]), kept, hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text, r.kept_sha256) for r in out) == want
    if block > 10:
        assert line_dedup.dedup_lines(empty).count() == 0


def test_a_hot_word_is_split(spark):
    """Hundreds of near copies of one line share all their index words."""
    import random

    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(240):
        line = list(base)
        for _ in range(rng.randrange(0, 12)):
            line[rng.randrange(60)] = f"c{rng.randrange(40)}"
        rows.append((i, " ".join(line), "s"))
    gone = line_matches(rows)
    for block in (4096, 24):
        out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(make(spark, rows), block=block).collect()}
        assert out == {i: len(gone[i, t]) for i, t, _ in rows}


@pytest.mark.parametrize("column", [["a b\nc  a", "", "x", "\n\n", " tail \n", "é ü\tü", "b"], ["", ""], [], ["w" * 3_000_000 + " z"]])
def test_words_of_a_column(column):
    import pyarrow as pa

    got = list(words.token_chunks(pa.array(["skipped", *column], pa.string())[1:]))
    lines = [(k, line.split()) for t in column for k, line in enumerate(t.encode().split(b"\n"))]
    numbers, hashes, of = [], [], []
    for x in got:
        of += (x.line + len(numbers)).tolist()
        numbers += x.number.tolist()
        hashes += x.hash.tolist()
    assert numbers == [k for k, _ in lines] and of == [i for i, (_, ws) in enumerate(lines) for _ in ws]
    known = dict(zip([w for _, ws in lines for w in ws], hashes, strict=True))
    assert [known[w] for _, ws in lines for w in ws] == hashes and len(set(known.values())) == len(known)


def test_sum_of_squares_is_all_pairs():
    m = quality.FactorisationMachine(6, 3)
    m.w[:] = np.arange(6)
    x = np.random.default_rng(1).random((4, 6))
    pairs = [sum(float(m.v[i] @ m.v[j]) * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(m.raw(x), m.bias + x @ m.w + pairs)


def test_quality(spark, docs, rows, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.scores(d, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in tested) / len(tested) > 0.95
    none = labels.filter("false")
    assert {r.score for r in quality.scores(docs, none).collect()} == {1.0}
    assert quality.scores(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_labels_of_held_out_rows_are_not_learned(spark):
    d = make(spark, [(i, "good words here" if i % 2 else "bad | bad | bad", "s") for i in range(200)])
    right = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in quality.scores(d, x).collect()} for x in (right, wrong))
    assert a == b


