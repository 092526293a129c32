"""What pages cost: lines are made once for all that read them, tracks are found once a line, and entries share the rows that go past the UDF."""

import datetime

from pyspark.sql import functions as F

from scriptorium.operators import geometry
from scriptorium.plans import queries, style_queries


def _orders(spark, folder):
    rows = [(k, datetime.datetime(1990 + k % 20, 1, 1)) for k in [*range(140), 7, 27]] + [(None, datetime.datetime(1999, 1, 1)), (130, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_lines_are_made_once(spark, tmp_path):
    sf_dir, adaptive = _orders(spark, tmp_path), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for run in (style_queries.pages_of_all_markers, queries.parse_pages):
            plan = run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
            assert 0 < plan.count("Generate explode(") <= 3 and "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_entries_beyond_one_row(spark):
    rows = [(1, i, f"t{i}", i % 2 == 0, i // 2 + 1, False, True, 10.0) for i in range(90)] + [(None, 0, "x", True, 1, False, True, 10.0)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, _t string, _start boolean, _block long, _deg boolean, section_found boolean, h double").repartition(3)
    got = geometry.assembled(lines).orderBy("doc_id", "_block", "_nth").collect()
    assert [r.texts for r in got] == [["x"]] + [[f"t{2 * i}", f"t{2 * i + 1}"] for i in range(45)]
    assert len({(r.doc_id, r._block) for r in got}) < 6


def test_an_item_alone(spark):
    rows = [([("a–b", 5.0, 10.0, 0.0, False)],), ([("a", None, 10.0, 8.0, False)],), ([("a", 5.0, None, None, True)],), ([],), (None,), ([("a", 5.0, 10.0, 8.0, False), ("b", 17.0, 1.0, 8.0, False)],)]
    frame = spark.createDataFrame(rows, f"i array<{geometry.ITEM}>")
    got = frame.select(geometry.items_to_text(F.col("i")).alias("t"), geometry.split_tracks(F.col("i")).alias("s")).collect()
    assert [r.t for r in got] == ["a–b", "a", "a", "", None, "a b"]
    assert [r.s and [(len(t["items"]), t.x0, t.x1, t.h, t.ov) for t in r.s] for r in got] == [
        [(1, 5.0, 15.0, 0.0, False)], [(1, None, None, 8.0, False)], [(1, 5.0, 5.0, 0.0, False)], [], None, [(2, 5.0, 18.0, 8.0, False)],
    ]
