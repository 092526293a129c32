from pyspark.sql import functions as F

from scriptorium.operators import markup


def test_a_tag_is_read_once(spark):
    """The tag of a piece was read anew for each sign that it was tried for: `regexp_extract` stood 46 times in the expression."""
    assert str(markup.runs(F.col("h"))._jc.node()).count("regexp_extract") <= 12


def test_runs(spark):
    html = '<em>A &amp; B</em> no. <span style="font-weight: bold">7</span><sup>&#50;</sup><b>x</b>&lt;'
    row = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(markup.runs(F.col("h")).alias("r")).collect()
    assert [tuple(x) for x in row[0].r] == [("A & B", True, False, False), (" no. ", False, False, False), ("7", False, True, False), ("2", False, True, True), ("x", False, True, False), ("<", False, False, False)]
    assert row[1].r is None and row[2].r == []
