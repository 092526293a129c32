"""What a citation costs to read: its parts are cut by one match each, lone years and names aren't taken apart, and what is read stays the same."""

from pyspark.sql import functions as F

from scriptorium.operators import cite


def test_a_part_is_cut_by_one_match(spark):
    read = str(cite.mentions(F.col("c"))._jc)
    assert read.count("fig|sec") == 1


def test_mentions_with_odd_parts(spark):
    cases = {
        "(Orr, 2001)": [("Orr", None, 2001, None)], "(see also A. B. Orr et al., 2001a, b; 2003)": [("Orr", "A. B.", 2001, "a"), ("Orr", "A. B.", 2001, "b"), ("Orr", "A. B.", 2003, None)],
        "(Orr, 2001y–ab)": [("Orr", None, 2001, x) for x in ("y", "z", "aa", "ab")], "(Orr, n.d., 2001, p. 5)": [("Orr", None, None, None), ("Orr", None, 2001, None)],
        "(Orr\u0001, 2001)": [("Orr\u0001", None, 2001, None)], "(\u00012001)": [("\u0001", None, 2001, None)], "(Orr\u0001A, Lee 2001)": [("Orr\u0001A", None, 2001, None)],
        "(Orr, 2001 and more)": [("Orr", None, 2001, None)], "(2001)": [], "()": [],
    }
    rows = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string").select(cite.mentions(F.col("c")).alias("m")).collect()
    got = [r.m and [(m.names[0].family, m.names[0].given, m.year, m.letter) for m in r.m] for r in rows]
    assert got == [*cases.values(), None]
