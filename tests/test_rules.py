"""Rules of single functions, and choices inside one document against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import identifiers, names
from scriptorium.operators import geometry, match, parse, render


def values(spark, column, rows):
    return [r.x for r in spark.createDataFrame([(s,) for s in rows], "s string").select(column.alias("x")).collect()]


def test_days_of_access(spark):
    rows = [
        "A (accessed 2021-03-04) B", "A [cited 2020 May 3] B", "A Accessed: May 3, 2020 B", "A accessed May. 13 2020 B", "A cited 2019 June 14 B", "A (Accessed: June 2, 2018) B", "A was cited in 2020",
    ]
    assert values(spark, identifiers.strip_accessed_phrases(F.col("s")), rows) == ["A   B"] * 6 + ["A was cited in 2020"]


def test_volume_issue_pages(spark):
    rows = ["Journal 12(3), 45–67", "J. 12 (3-4): 45-67.", "vol. 7, no. 2, pp. 10–19", "12(3), 45", "12, 34–56", "pp. 5-9", "vol. 7, nos. 1–2, pp. 3–4", "none"]
    got = values(spark, identifiers.volume_issue_pages(F.col("s")), rows)
    assert [x and tuple(x) for x in got] == [
        ("12", "3", "45-67"), ("12", "3-4", "45-67"), ("7", "2", "10-19"), ("12", "3", "45"), ("12", None, "34-56"), (None, None, "5-9"), ("7", "1–2", "3-4"), None,
    ]


def test_organisations(spark):
    rows = ["World Health Organization", "Board for the Study of Rivers", "Silva, J. P.", "J. P. Silva", "Silva", "lower case words", "Instituto de Salud"]
    assert values(spark, F.expr(names.looks_like_org_sql("s")), rows) == [True, True, False, False, False, False, False]


def test_furniture(spark):
    heads = ["Coastal Records. 12 (2020) 34–56", "Coastal Records 12 (2020) 34-56", "Silva, J. 12 (2020) 34 more", "Page 3 of 12", "p. 3 / 12", "Page 3 of the book"]
    assert values(spark, F.col("s").rlike(parse.RUNNING_HEAD) | F.col("s").rlike(parse.PAGE_OF), heads) == [True, True, False, True, True, False]
    closings = ["Appendix A", "7 Acknowledgements", "Acknowledgment", "Supplementary Material", "A P P E N D I X", "Appended", "On appendices"]
    assert values(spark, F.col("s").rlike(parse.STOP), closings) == [True, True, True, True, True, False, False]


@pytest.mark.parametrize(("text", "more"), [("A title without", True), ("A 2020 title", False), ("A 2020 doi:", True), ("A 2020 https://x.org/", True), ("A 2020 https://x.org/a", False), ("2020 doi: 10.1/", True), ("", True)])
def test_needs_more(text, more):
    assert geometry.needs_more(text) is more


def test_orphans_go_to_incomplete_entries():
    rows = [("One, A. title", 10.0, True), ("Two, B. 2001 done", 12.0, True), ("Three, C. title", 8.0, True), ("odd 1 2 3 small 2003", 8.2, False), ("wide 2004", 10.1, False), ("left over", 10.0, False)]
    lines, heights, starts = (pd.Series([np.array(x)]) for x in zip(*rows, strict=True))
    assert geometry._reattach(lines, starts, heights).tolist() == [[["One, A. title", "wide 2004"], ["Two, B. 2001 done"], ["Three, C. title", "odd small 2003"]]]


def test_numbers_of_titles_are_no_years():
    assert geometry.needs_more("One, A. Study 11980 of rivers") and geometry.needs_more("One, A. A title doi:10.1000/ref.1990")
    rows = [("One, A. Study 1900 of rivers. Coastal", True), ("Two, B. Study 11980 of rivers. Coastal", True), ("Three, C. A study. 2001;2:3-4.", True), ("Four, D. Study 4. Coastal", True), ("Records. 2003;1:2-3.", False), ("Records. 2004;1:2-3.", False), ("doi:10.1000/ref.1990", False), ("Records. 2005;1:2-3.", False)]
    lines, starts = (pd.Series([np.array(x)]) for x in zip(*rows, strict=True))
    got = geometry._reattach(lines, starts, pd.Series([np.array([10.0] * len(rows))])).tolist()[0]
    assert [len(entry) for entry in got] == [2, 2, 1, 3]
    assert [entry[-1] for entry in got] == ["Records. 2003;1:2-3.", "Records. 2004;1:2-3.", "Three, C. A study. 2001;2:3-4.", "Records. 2005;1:2-3."]


def test_greedy_matching(spark):
    rng = random.Random(7)
    rows = [(d, i, j, rng.choice([0.6, 0.75, 1.0, 2.0, 2.5])) for d in range(6) for i in range(8) for j in range(8) if rng.random() < 0.4]
    want = []
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    for pairs in by_doc.values():
        used_i, used_j = set(), set()
        for d, i, j, s in sorted(pairs, key=lambda r: (-r[3], r[1], r[2])):
            if i not in used_i and j not in used_j:
                want.append((d, i, j, s))
                used_i.add(i)
                used_j.add(j)
    got = match.greedy_one_to_one(spark.createDataFrame(rows, "doc_id long, i int, j int, s double"))
    assert got.dtypes == [("doc_id", "bigint"), ("i", "int"), ("j", "int"), ("s", "double")] and sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_need_a_year_or_a_word(spark):
    kinds = "doc_id long, ordinal int, year int, title string"
    parsed = spark.createDataFrame([(1, 0, 2001, "alpha beta"), (1, 1, None, "gamma delta"), (1, 2, None, None), (2, 0, 2001, "x")], kinds)
    expected = spark.createDataFrame([(1, 0, 2001, "other words"), (1, 1, 2002, "gamma delta"), (1, 2, 2003, ""), (2, 0, 2005, "y")], kinds)
    got = {(r.doc_id, r.i, r.j): round(r.s, 6) for r in match.candidate_pairs(parsed, expected).collect()}
    assert got == {(1, 0, 0): 2.0, (1, 1, 1): 1.0, (1, 2, 2): 1.0}
    first = {(r.j, r.i) for r in match.match_year_first(parsed, expected).filter("doc_id = 1").collect()}
    assert first == {(0, 0), (1, 1), (2, 2)}


RECORD = "doc_id long, ordinal int, type string, author array<struct<family:string,given:string,literal:string>>, title string, container string, volume string, issue string, page string, year int, doi string, url string, publisher string, place string, edition string, editor array<struct<family:string,given:string,literal:string>>, genre string"


def test_issue_ranges_and_suffixes(spark):
    who = [("Silva", "Joana", None)]
    rows = [(1, i, "article-journal", who, f"{t} title", "Records", "5", "1-4", "10-12", 2020, None, None, None, None, None, [], None) for i, t in enumerate(("Beta", "Alpha"))]
    rows.append((1, 2, "article-journal", who, "Gamma title", "Records", "5", "2", "10-12", 2021, None, None, None, None, None, [], None))
    records = spark.createDataFrame(rows, RECORD)
    apa = {r.entry_no: r.text for r in render.bibliography(records, "apa").collect()}
    assert apa[1].startswith("Silva, J. (2020a). Alpha title. Records, 5(1–4)") and "(2020b). Beta" in apa[2] and "(2021). Gamma" in apa[3]
    mla = [r.text for r in render.bibliography(records, "mla").collect()]
    assert "nos. 1–4" in mla[0] and "no. 2" in mla[2]


def test_nature_initials_may_have_marks(spark):
    text = "1. Fournier, É. & Ng, P. L. A study of rivers. Coastal Records 12, 34–56 (2020).\n\n2. Abbott, A. & Grover, Á. B. Another study. Coastal Records 3, 4–5 (2019).\n\n3. Moe, E. Third. Coastal Records 3, 14–15 (2018)."
    refs = parse.parse_text(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    first = refs.filter("entry_no = 1").first()
    assert first.style == "nature" and [a.family for a in first.author] == ["Fournier", "Ng"]


def test_parts_follow_rows(spark, tmp_path):
    """More rows, more parts, also of one file; documents stay whole."""
    from scriptorium.plans import synthetic

    rows = 2 * synthetic.PART_ROWS * spark.sparkContext.defaultParallelism
    spark.range(rows).selectExpr("id as o_orderkey", "timestamp'1995-01-01' as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = synthetic.records(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("part")).groupBy("doc_id").agg(F.countDistinct("part").alias("n"), F.max("part").alias("part"))
    assert found.agg(F.max("n")).first()[0] == 1 and found.agg(F.max("part")).first()[0] >= spark.sparkContext.defaultParallelism
