"""What an entry costs: parts are joined in one list, titles without a word to raise aren't taken apart, letters take one window."""

from pyspark.sql import functions as F

from scriptorium.operators import cite, render


def test_parts_are_joined_in_one_list(spark):
    rows = [("a", "b", "c"), (None, "b", ""), ("", "", None), (None, None, None), ("a", None, "c"), (" ", "", "c")]
    joined = render.join(", ", F.col("a"), F.col("b"), F.col("c"))
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string").select(joined).collect()] == ["a, b, c", "b", None, None, "a, c", " , c"]
    assert str(joined._jc).count("array_remove(") == 2


def test_titles_in_title_case_stay_whole(spark):
    cases = {
        "Study 12 Into Erosion": "Study 12 Into Erosion", "a study of the sea": "A Study of the Sea", "Up-to-date Work": "Up-to-Date Work", "Run: of tides": "Run: Of Tides",
        "“quoted words” Here": "“Quoted Words” Here", "iPhone and eBay": "iPhone and eBay", "3d Print": "3D Print", "": "", "A  b": "A  B", "Éa ébc": "Éa Ébc", "X\nbc": "X\nbc",
    }
    frame = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    assert [r[0] for r in frame.select(render.title_case(F.col("t"))).collect()] == [*cases.values(), None]
    assert "(?:^|[ -])" in str(render.title_case(F.col("t"))._jc)


def test_letters_take_one_window(spark):
    kinds = "doc_id long, ordinal int, title string, year int, author array<struct<family:string,given:string,literal:string>>"
    orr = [("Orr", "Ada", None)]
    rows = spark.createDataFrame([(1, 0, "b", 2001, orr), (1, 1, "a", 2001, orr), (1, 2, "c", 2002, orr), (1, 3, "a", 2001, orr)], kinds)
    labelled = cite.label_references(rows, "harvard")
    assert {r.ordinal: r.letter for r in labelled.collect()} == {0: "c", 1: "a", 2: None, 3: "b"}
    plan = labelled._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [line for line in plan if "Window [" in line and "row_number()" in line and "count(1)" in line]
