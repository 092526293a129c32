"""Citations in text: reading, resolution, letters, labels that are all different; styled runs written and read."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import citations, cite, markup, render
from scriptorium.plans.synthetic import records
from scriptorium.sources import readers, writers

SF = "/root/testdata/sf0.001"
PERSON = "array<struct<family:string,given:string,literal:string>>"


def read(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(cite.mentions(F.col("c")).alias("m")).collect()
    name = lambda n: f"{n.given} {n.family}" if n.given else n.family
    return [[(" + ".join(map(name, m.names)) + (" et al." if m.et_al else ""), m.year, m.letter) for m in r.m] for r in rows]


def test_citations_are_read(spark):
    cases = {
        "(Orr, 2000)": [("Orr", 2000, None)],
        "(see Orr 2001a, b; A. Ray & Lee, 2003, 2004)": [("Orr", 2001, "a"), ("Orr", 2001, "b"), ("A. Ray + Lee", 2003, None), ("A. Ray + Lee", 2004, None)],
        "(Orr, 2001a–c; 2003)": [("Orr", 2001, "a"), ("Orr", 2001, "b"), ("Orr", 2001, "c"), ("Orr", 2003, None)],
        "Orr et al. (2001, 2003b)": [("Orr et al.", 2001, None), ("Orr et al.", 2003, "b")],
        "(Orr, Ray, & Lee, n.d.)": [("Orr + Ray + Lee", None, None)],
        "(Orr, Ray, et al. 1999z–ab)": [("Orr + Ray et al.", 1999, x) for x in ("z", "aa", "ab")],
        "(Orr and Ray 2001, pp. 12, 14)": [("Orr + Ray", 2001, None)],
        "(Study 1941 of the Sea, 2000)": [("Study 1941 of the Sea", 2000, None)],
        "(See, 1990)": [("See", 1990, None)],
        "(no year here)": [],
        "": [],
    }
    assert read(spark, list(cases)) == list(cases.values())


def test_letters(spark):
    n = [1, 26, 27, 52, 53, 702, 703, 18278, 18279]
    rows = spark.createDataFrame([(i,) for i in n], "n int").select("n", render.letters(F.col("n")).alias("s")).withColumn("back", cite.letter_number(F.col("s"))).collect()
    assert [r.s for r in rows] == ["a", "z", "aa", "az", "ba", "zz", "aaa", "zzz", "aaaa"] and [r.back for r in rows] == n


@pytest.mark.parametrize("style", cite.CITE_STYLES)
def test_labels_are_all_different(spark, style):
    rng = random.Random(3)
    people = [(f, g) for f in ("Orr", "Ray") for g in ("Ada", "Alma", "Bo", None)]
    rows = []
    for i in range(400):
        authors = [(*rng.choice(people), None) for _ in range(rng.randrange(0, 6))]
        rows.append((i // 40, i % 40, authors if i % 9 else None, f"T{rng.randrange(5)}" if i % 7 else None, rng.choice([2000, 2001, None])))
    rows += [rows[3], rows[3]]
    out = cite.label_references(spark.createDataFrame(rows, f"doc_id long, ordinal int, author {PERSON}, title string, year int"), style).collect()
    assert len(out) == len(rows) and len({(r.doc_id, r.who, r.year, r.letter) for r in out}) == len(rows)
    # a letter only where names, as far as the style may show them, and the year are the same
    for r in out:
        alike = [x for x in out if (x.doc_id, x.who, x.year) == (r.doc_id, r.who, r.year)]
        assert (r.letter is None) == (len(alike) == 1)


def test_more_names_before_letters(spark):
    p = lambda *names: [(n.split()[1], n.split()[0], None) for n in names]
    rows = [(p("Ada Orr", "Bo Ray", "Cy Lee", "Di Fox"), "x"), (p("Ada Orr", "Bo Ray", "Cy Lee", "Ed Gil"), "y"), (p("Ada Orr", "Bo Kay", "Cy Lee", "Di Fox"), "z"), (p("Al Fay"), "u"), (p("Ann Fay"), "v"), (p("Al Fay"), "w")]
    docs = spark.createDataFrame([(1, i, a, t, 2000) for i, (a, t) in enumerate(rows)], f"doc_id long, ordinal int, author {PERSON}, title string, year int")
    said = lambda style: {r.title: (r.who, r.letter) for r in cite.label_references(docs, style).collect()}
    assert said("harvard") == {
        "x": ("Orr, Ray, Lee and Fox", None), "y": ("Orr, Ray, Lee and Gil", None), "z": ("Orr, Kay, et al.", None), "u": ("Al Fay", "a"), "v": ("Ann Fay", None), "w": ("Al Fay", "b"),
    }
    assert said("apa") == {
        "x": ("Orr, Ray, Lee, & Fox", None), "y": ("Orr, Ray, Lee, & Gil", None), "z": ("Orr, Kay, et al.", None), "u": ("Fay", "a"), "v": ("Fay", "b"), "w": ("Fay", "c"),
    }


def test_resolution(spark):
    p = lambda *names: [(n.split()[-1], " ".join(n.split()[:-1]), None) for n in names]
    listed = [(1, 0, p("Ada Orr", "Bo Ray"), 2000, None), (1, 1, p("Ada Orr"), 2000, "a"), (1, 2, p("Ada Orr"), 2000, "b"), (1, 3, p("B. M. Fox", "Cy Lee", "Di Kay"), 2001, None), (1, 4, p("Bo Fox", "Cy Lee", "Ed Kay"), 2001, None), (1, 5, [(None, None, "Port Authority")], 2002, None)]
    said = ["(Orr & Ray, 2000)", "(Orr, 2000a)", "(Orr, 2000)", "(Orr, 2000c)", "(B. M. Fox et al., 2001)", "(B. Fox et al., 2001)", "(Fox et al., 2001)", "(Fox & Gil, 2001)", "(Port Authority, 2002)", "(Nobody, 2000)"]
    bodies = spark.createDataFrame(list(enumerate(said)), "mention_id long, c string").select(F.lit(1).cast("long").alias("doc_id"), "mention_id", F.explode(cite.mentions(F.col("c"))).alias("m")).select("doc_id", "mention_id", "m.*")
    out = cite.resolve(bodies, spark.createDataFrame(listed, f"doc_id long, ordinal int, author {PERSON}, year int, letter string"), least=3).collect()
    assert [(r.status, r.ordinal) for r in sorted(out, key=lambda r: r.mention_id)] == [
        ("ok", 0), ("ok", 1), ("ambiguous", None), ("loose", None), ("ok", 3), ("ok", 4), ("ambiguous", None), ("loose", None), ("ok", 5), ("not listed", None),
    ]


def test_both_years_of_a_citation_count(spark):
    found = spark.createDataFrame([(1, "author_year", "(Orr 2001, 2003)"), (1, "narrative", "Ray (1999a, b)")], "doc_id long, kind string, citation string")
    none = spark.createDataFrame([], "doc_id long, number int, year int")
    assert {r.year: r.n for r in citations.year_histogram(found, none).collect()} == {2001: 1, 2003: 1, 1999: 2}


def test_styled_runs(spark):
    rows = [("A & <b>", None), ("", "x"), ("Why?", "y")]
    t, c = (F.col(x) for x in ("t", "c"))
    token = render._marked.set(True)
    try:
        marked = render.cat(render._stop(render.italic(t)), " ", F.coalesce(render.styled(c, "bold"), F.lit("-")), render.styled(F.lit("1"), "bold"), render.styled(F.lit("2"), "raised"))
    finally:
        render._marked.reset(token)
    out = spark.createDataFrame(rows, "t string, c string").select(render.to_runs(marked).alias("r")).withColumn("h", markup.html(F.col("r"))).withColumn("back", markup.runs(F.col("h"))).collect()
    assert [r.h for r in out] == ["<i>A &amp; &lt;b&gt;</i>. -<b>1</b><sup>2</sup>", ". <b>x1</b><sup>2</sup>", "<i>Why?</i> <b>y1</b><sup>2</sup>"]
    assert all(r.r == r.back for r in out)


def test_bibliographies_are_written_and_read(spark, tmp_path):
    rows = records(spark, SF).filter("doc_id = 1").withColumn("style", F.lit("acs"))
    entries = rows.select("style", F.col("ordinal").alias("entry_no"), render.render_runs("acs").alias("runs")).coalesce(1)
    writers.write_bibliographies(entries, str(tmp_path / "out"))
    writers.write_expected(rows, str(tmp_path / "expected"))
    plain = sorted(r.text for r in readers.entries(spark, str(tmp_path / "out/plain/style=acs")).collect())
    assert plain == sorted(r.t for r in rows.select(render.render("acs").alias("t")).collect())
    tagged = readers.entries(spark, str(tmp_path / "out/annotated/style=acs")).select(markup.plain(markup.runs(F.col("text"))).alias("t"), F.contains("text", F.lit("<i>")).alias("i")).collect()
    assert sorted(r.t for r in tagged) == plain and all(r.i for r in tagged)
    expected = spark.read.json(str(tmp_path / "expected/style=acs"))
    assert {r.title for r in expected.collect()} == {r.title for r in rows.collect()}


def test_entries_of_real_difficulty_are_read_back(spark):
    """Organisations, long lists, names with marks and hyphens, editions, ranges of issues and years in titles, in ten styles."""
    from scriptorium.functions import text
    from scriptorium.operators import parse

    person = lambda s: [(n.split("/")[1], n.split("/")[0], None) for n in s.split("; ")]
    fields = ("type", "author", "title", "container", "volume", "issue", "page", "year", "doi", "publisher", "place", "edition", "genre")
    items = [
        ("article-journal", person("Søren M./Kjærgaard; Anne/Baudouin; Chidi/Okafor"), "Nitrogen retention in restored wetlands of the lower basin", "Ecological Engineering", "13", "1-4", "201-217", 1999, "10.1000/a.1", None, None, None, None),
        ("article-journal", person("Ana/Silva; Bo/Lund; Cy/Ray; Di/Fox; Ed/Gil; Fay/Orr; Gus/Lee; Hal/Kim; Ida/Poe"), "Mapping of drought tolerance across spring wheat", "Theoretical Genetics", "104", "6", "987-1001", 2002, "10.1000/a.2", None, None, None, None),
        ("article-journal", person("Sung-Jin/Hwang; Élodie/Lefèvre"), "Floods from 1950 onwards and their causes", "River Letters", "7", "2", "33-41", 2011, "10.1000/a.3", None, None, None, None),
        ("book", person("Ruth M./Almeida"), "Principles of computational hydrology", None, None, None, None, 2001, None, "Oxford University Press", "Oxford", "2", None),
        ("thesis", person("Karin/Lundgren"), "Sediment budgets of northern deltas", None, None, None, None, 2008, None, "University of Graz", "Graz", None, "PhD thesis"),
    ]
    rows = [{"id": f"{i}/{style}", "style": style, "editor": [], "url": None, **dict(zip(fields, item, strict=True))} for i, item in enumerate(items) for style in render.RENDERERS]
    schema = f"id string, style string, author {PERSON}, editor {PERSON}, year int, url string, " + ", ".join(f"{f} string" for f in fields if f not in ("author", "year"))
    df = spark.createDataFrame(rows, schema)
    raw = F.coalesce(*(F.when(F.col("style") == s, render.render(s)) for s in render.RENDERERS))
    out = parse.extract_fields(df.select("id", "style", text.fold_text(raw).alias("raw"))).collect()
    wrong = []
    for r in out:
        i, style = r.id.split("/")
        kind, author, title, container, volume, _, page, year, *_ = items[int(i)]
        got = (r.type, r.year, r.title.lower(), r.container, r.volume, r.author[0].family)
        if got != (kind, year, title.lower(), container, volume, author[0][0]):
            wrong.append((r.id, got))
    assert not wrong


def test_mentions_are_read_once(spark):
    """A resolution joined its best ranks back and was read twice by the cross check, so each mention was read four times."""
    cited = spark.createDataFrame([(1, 1, [(None, "Orr")], False, 2001, None), (1, 2, [(None, "Kay")], False, 2001, None)], "doc_id long, mention_id long, names array<struct<given:string,family:string>>, et_al boolean, year int, letter string")
    listed = spark.createDataFrame([(1, o, [("Orr", "Ada", None)], y, None) for o, y in ((0, 2001), (1, 2002), (1, 2002))], "doc_id long, ordinal int, author array<struct<family:string,given:string,literal:string>>, year int, letter string")
    checked = cite.cross_check_names(cite.resolve(cited, listed), listed)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, checked.collect()), key=str) == [(1, 0, "ok", 1), (1, 1, "not cited", 0), (1, 1, "not cited", 0), (1, None, "not listed", 1)]


def test_letters_grow_by_one_each(spark):
    text = str(render.letters(F.col("n"))._jc)
    assert text.count("CASE") == 5
    rows = spark.createDataFrame([(n,) for n in (None, 0, 1, 26, 27, 52, 53, 702, 703, 18279, 475255)], "n int").select(render.letters(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["", "", "a", "z", "aa", "az", "ba", "zz", "aaa", "aaaa", "aaaaa"]


def test_documents_are_checked_by_two_joins(spark):
    """One looks names up, one compares numbers; the texts have one exchange for both."""
    from scriptorium.plans.citation_queries import cross_check_documents

    plan = cross_check_documents(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("RepartitionByExpression [doc_id") >= 2
