"""Dates, lookups, rare prefixes, and rules that lists and names of the styles follow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates, identifiers, names
from scriptorium.operators import lookup, match, render


def values(spark, column, rows, kind="string"):
    return [r.x for r in spark.createDataFrame([(s,) for s in rows], f"s {kind}").select(column.alias("x")).collect()]


def test_dates(spark):
    rows = {
        ((2020,), None): ("2020", "2020", "2020"), ((2020, 5), None): ("May 2020", "May 2020", "2020, May"), ((2020, 5, 3), None): ("May 3, 2020", "3 May 2020", "2020, May 3"),
        ((2019,), (2020,)): ("2019–2020", "2019–2020", "2019–2020"), ((2020, 5), (2020, 6)): ("May–June 2020", "May–June 2020", "2020, May–June"),
        ((2020, 5, 3), (2020, 5, 5)): ("May 3–5, 2020", "3–5 May 2020", "2020, May 3–5"), ((2020, 5, 3), (2020, 6, 2)): ("May 3–June 2, 2020", "3 May–2 June 2020", "2020, May 3–June 2"),
        ((2019, 12, 30), (2020, 1, 2)): ("December 30, 2019–January 2, 2020", "30 December 2019–2 January 2020", "2019, December 30–2020, January 2"),
    }
    table = spark.createDataFrame([([list(a)] + ([list(b)] if b else []),) for a, b in rows], "p array<array<bigint>>").select(dates.of_parts(F.col("p")).alias("d"))
    shown = table.select("d", *(dates.show(F.col("d"), form).alias(form) for form in dates.FORMS))
    out = shown.select("*", *(dates.read(F.col(form)).eqNullSafe(F.col("d")).alias(f"{form}_back") for form in dates.FORMS)).collect()
    assert [(r.mdy, r.dmy, r.ymd) for r in out] == list(rows.values())
    assert all(r.mdy_back and r.dmy_back and r.ymd_back for r in out)


def test_days_of_access_are_read(spark):
    rows = ["A site [cited 2020 May 3].", "A site (Accessed: 13 May 2020)", "Retrieved on May 3, 2020, from x", "accessed 2020-05-03", "Nothing of the kind 2020", None]
    got = values(spark, dates.accessed(F.col("s"))["from"], rows)
    assert got == [[2020, 5, 3], [2020, 5, 13], [2020, 5, 3], [2020, 5, 3], None, None]


def test_dates_without_a_year(spark):
    assert values(spark, dates.of_parts(F.col("s")), [None, [], [[]], [[None, 3]]], "array<array<bigint>>") == [None] * 4
    assert values(spark, dates.read(F.col("s")), [None, "", "May", "no date"]) == [None] * 4


@pytest.mark.parametrize("small", [100, 0])
def test_lookup(spark, small):
    rng = random.Random(2)
    keys = [7 if rng.random() < 0.4 else rng.choice([None, *range(40)]) for _ in range(3000)]
    cited = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "ref long, n int").repartition(3)
    items = spark.createDataFrame([(k, f"t{k}") for k in range(30)], "id long, title string")
    out = lookup.by_key(cited, items, small=small)
    assert out.columns == ["ref", "n", "title"]
    assert Counter((r.ref, r.n, r.title) for r in out.collect()) == Counter((k, i, f"t{k}" if k is not None and k < 30 else None) for i, k in enumerate(keys))
    assert lookup.by_key(cited.limit(0), items, small=small).count() == 0 and lookup.by_key(cited, items.limit(0), small=small).filter("title is not null").count() == 0


def test_title_candidates(spark):
    """The pairs that go on to be compared: all similar ones, and few others."""
    rng = random.Random(5)
    common, rare = ["study", "of", "into", "the", "across"], [f"w{i}" for i in range(300)]
    title = lambda: " ".join(rng.sample(common, rng.randrange(0, 5)) + rng.sample(rare, rng.randrange(0, 5)))
    left = [(i % 2, i, 2000 + i % 7, title()) for i in range(160)]
    right = [(i % 2, i, 1900, t if rng.random() < 0.4 else f"{t} {rng.choice(rare)}" if rng.random() < 0.5 else title()) for i, (_, _, _, t) in enumerate(left)]
    schema = "doc_id long, ordinal int, year int, title string"
    p, e = (match._side(spark.createDataFrame(rows, schema), "doc_id", at, side) for rows, at, side in ((left, "i", "p"), (right, "j", "e")))
    found = [(r.doc_id, r.i, r.j) for r in match.title_candidates(p, e).collect()]
    words = lambda t: frozenset(t.split())
    alike = lambda a, b: not a | b or len(a & b) >= 0.6 * len(a | b)
    similar = {(d, i, j) for d, i, _, t in left for c, j, _, u in right if c == d and alike(words(t), words(u))}
    sharing = sum(c == d and bool(words(t) & words(u)) for d, _, _, t in left for c, _, _, u in right)
    assert len(found) == len(set(found)) and similar <= set(found)
    assert {(r.doc_id, r.i, r.j) for r in match.similar_titles(p, e).collect()} == similar
    assert len(found) < 0.1 * sharing


def test_probes_of_a_long_list_are_gathered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(match, "PROBES", 7)
    docs = spark.createDataFrame([(1, "Some words. A fine title of the sea, and others."), (2, "")], "doc_id long, text string")
    refs = spark.createDataFrame([(1, i, "A Fine Ti-\ntle of the Sea Today" if i % 3 else f"Nowhere to be found {i}") for i in range(50)] + [(2, 99, "A fine title of the sea")], "doc_id long, ref_id long, title string")
    out = match.title_probe(docs, refs).collect()
    assert len(out) == 51 and {r.ref_id for r in out if not r.found} == {i for i in range(50) if i % 3 == 0} | {99}


def test_names_with_suffixes_and_acronyms(spark):
    rows = ["Ada M. Orr Jr., Bo Ray III and Cy Lee", "NASA and Bo Ray", "J. R. R. Orr", "Jr"]
    got = values(spark, names.people("'acm'", "s"), rows)
    assert [[(p.family, p.given, p.literal) for p in x] for x in got] == [
        [("Orr Jr", "Ada M.", None), ("Ray III", "Bo", None), ("Lee", "Cy", None)], [(None, None, "NASA"), ("Ray", "Bo", None)], [("Orr", "J. R. R.", None)], [(None, None, "Jr")],
    ]


def test_containers_and_numbers(spark):
    rows = ["Journal of Rivers 41 (2): 655–84", "Journal 12, pp. 3-9.", "Studies 2000", "12 (3): 4–5", None]
    got = values(spark, identifiers.split_container(F.col("s")), rows)
    assert [x and (x.container, x.vip) for x in got] == [("Journal of Rivers", "41 (2): 655–84"), ("Journal", "12, pp. 3-9"), ("Studies 2000", ""), ("12 (3): 4–5", ""), (None, "")]


def test_same_authors_are_said_once(spark):
    person = "array<struct<family:string,given:string,literal:string>>"
    none = dict.fromkeys(("container", "volume", "issue", "page", "doi", "url", "publisher", "place", "genre", "edition"))
    who = [("Orr", "Ada", None)]
    rows = [{"doc_id": 1, "ordinal": i, "type": "book", "author": a, "title": t, "year": 2000, "editor": [], **none, "publisher": "Press"} for i, (a, t) in enumerate([(who, "B"), (who, "A"), ([("Órr", "Bo", None)], "C"), ([], "M"), ([], "N")])]
    schema = f"doc_id long, ordinal int, type string, author {person}, title string, year int, editor {person}, " + ", ".join(f"{c} string" for c in none)
    out = render.bibliography(spark.createDataFrame(rows, schema), "mla").orderBy("entry_no").collect()
    assert [r.text for r in out] == ["M. Press, 2000.", "N. Press, 2000.", "Orr, Ada. A. Press, 2000.", "———. B. Press, 2000.", "Órr, Bo. C. Press, 2000."]
