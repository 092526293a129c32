"""What a row costs: expressions whose evaluation does more than their result needs."""

from pyspark.sql import functions as F

from scriptorium.functions import binding, identifiers, names, text
from scriptorium.operators import forms


def test_let_works_out_no_type_a_row(spark):
    """An element of a transformed array has its type worked out for every row, twice at each nested one."""
    nested = F.col("id")
    for _ in range(3):
        nested = binding.let(nested, lambda x: x + x)
    assert "transform(" not in str(nested._jc) and "transform(array(" not in names.people_sql("style", "block") + str(forms.matched("style", "after")._jc)
    assert [r[0] for r in spark.range(3).select(nested).collect()] == [0, 8, 16]
    assert spark.range(1).select(binding.let(F.lit(None).cast("string"), F.isnull)).first()[0] is True


def test_no_in_inside_lambdas():
    assert " in (" not in names.people_sql("style", "block")


def test_years_are_cut_by_marks(spark):
    """Texts that begin with a year, hold one, several or none, or hold the mark itself."""
    cases = {
        "2001 one": (2001, 0), "(1999) and 2005.": (1999, 1), "12005 and 20011": None, "": None, "in 1987-1999: 1995;": (1995, 14),
        "a\u0003 2004.": (2004, 3), "1901–1999": (1999, 5), "a\u00032003\u00032004.": (2004, 7),
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select(identifiers.find_year(F.col("t")).alias("y")).collect()
    assert [r.y and tuple(r.y) for r in rows] == [*cases.values(), None]
    plan = str(identifiers.find_year(F.col("t"))._jc)
    assert "(?=(?:19|20)" not in plan  # split() compiles a longer pattern for every row


def test_identifiers_stand_apart(spark):
    found = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(identifiers.extract_identifiers(F.col("t")).alias("x")).select("x.doi", "x.url", "x.arxiv", "x.isbn").first())
    assert found("x10.1234/a 10.5555/b. 12001.12345 2001.12345 1978-3-16-148410-0 978-3-16-148410-0") == ("10.5555/b", None, "2001.12345", "978-3-16-148410-0")
    assert found("10.1234/a xhttps://a.org https://b.org, xarXiv:2001.00001 arXiv: 2002.00002v3") == ("10.1234/a", "https://b.org", "2002.00002", None)


def test_prefixes_and_last_stops(spark):
    cases = {" [1] (2) 3. A": "A", "[1]A": "A", " A": " A", "3.A": "3.A", "(2)(3) A": "(3) A", "[1][2]": "[2]"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select(text.strip_number_prefix(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == list(cases.values())
    stops = {"a.,;: \t": "a.,;:", "a ;.": "a", "a. ;": "a.", ".": "", "a .": "a "}
    rows = spark.createDataFrame([(t,) for t in stops], "t string").select(text.strip_trailing_dot(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == list(stops.values())


def test_people_with_the_mark_in_their_text(spark):
    rows = spark.createDataFrame([("apa", "Orr, A., & Lee, B."), ("apa", "Orr, A\u0003., & Lee, B."), ("mla", "Orr, Ada, and Bo Lee, et al."), ("mla", "World Health Organization")], "style string, b string")
    got = [[(p.family, p.given, p.literal) for p in r[0]] for r in rows.select(names.people("style", "b")).collect()]
    assert got == [
        [("Orr", "A", None), ("Lee", "B", None)], [("Orr", "A\u0003", None), ("Lee", "B", None)], [("Orr", "Ada", None), ("Lee", "Bo", None)], [(None, None, "World Health Organization")],
    ]
