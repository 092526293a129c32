"""Cases that earlier versions of line dedup, fingerprints and HTML extraction got wrong."""

import random

import numpy as np
import pytest

from scriptorium.llm import html_pages, html_text, line_dedup, minhash

from .conftest import make


def thue_morse(n):
    return ["ab"[i.bit_count() & 1] for i in range(n)]


@pytest.mark.parametrize("size", [16, 4096])
def test_lines_of_long_periodic_words_are_told_apart(spark, size):
    w = "".join(thue_morse(size))
    other = w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w + " one two", "s"), (2, other + " one two", "s"), (3, f"one two  {other} one", "s")]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(make(spark, rows)).collect()}
    assert out == {1: 0, 2: 0, 3: 1}


def test_words_of_all_lengths_are_told_apart():
    from scriptorium.llm.words import word_hashes

    rng = random.Random(4)
    found = sorted({bytes(rng.choices(b"ab\x00", k=rng.randrange(1, 24))) for _ in range(20_000)} | {b"a" * i for i in range(1, 200)})
    data = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(w) for w in found])
    one, two = word_hashes(data, ends - [len(w) for w in found], ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(found)


@pytest.mark.parametrize(("shingles", "shared"), [(3, 2), (4, 3), (6, 4), (10, 6), (40, 30)])
def test_likeness_of_short_texts(shingles, shared):
    """The mean error over many pairs, and the mean itself, against the exact Jaccard."""
    rng = random.Random(shingles)
    exact, found = shared / (2 * shingles - shared), []
    for _ in range(150):
        words = [f"v{rng.randrange(10**8)}" for _ in range(shared + 4)]
        tails = [[f"t{rng.randrange(10**8)}" for _ in range(shingles - shared)] for _ in range(2)]
        a, b = (minhash.signature(" ".join(words + t)) for t in tails)
        found.append(minhash.likeness(a, b))
    assert abs(np.mean(found) - exact) < 0.03
    assert np.sqrt(np.mean((np.array(found) - exact) ** 2)) < 0.09


def test_one_filled_bin_fills_all():
    a = minhash.signature("one")
    assert len(a) == minhash.BINS and len(set(a.tolist())) == 1


TEXT = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="legal-news"><h1>Head</h1><p>Body {TEXT}</p></div>', f"Head\nBody {TEXT}"),
        (f'<div class="post alert-2023"><p>Body {TEXT}</p></div>', f"Body {TEXT}"),
        (f'<nav><a href="/">Home</a></nav><div class="share-story"><h1>Head</h1><p>{TEXT}</p><div class="ad">Buy now</div></div><div class="comments"><p>I agree with this.</p></div>', f"Head\n{TEXT}"),
        (f'<div class="masthead"><h1>Site</h1></div><div><h2>Head</h2><p>{TEXT}</p></div>', f"Head\n{TEXT}"),
        (f'<div class="comments"><p>{TEXT}</p></div>', ""),
    ],
)
def test_names_of_a_page_body_do_not_drop_it(page, text):
    tree = html_text.grow(html_text.labelled(html_pages.pages()))
    assert html_text.main_text(page, tree) == text
