"""The cross-check of in-text citations covers every document, by number or by name."""

from collections import Counter

from scriptorium.plans.queries import QUERIES
from scriptorium.plans.synthetic import records

SF = "/root/testdata/sf0.001"


def test_cross_check_by_name(spark):
    refs = [(r.doc_id, r.ordinal, r.author[0].family, str(r.year)) for r in records(spark, SF).collect() if r.doc_id % 2 == 0]
    times = Counter((d, f, y) for d, _, f, y in refs)
    listed = {(d, f, y) for d, k, f, y in refs if k}
    out = QUERIES["cross_check_names"](spark, SF).collect()
    assert {(r.doc_id, r.family, r.year): (r.times, r.status) for r in out} == {k: (n, "ok" if k in listed else "not listed") for k, n in times.items()}
    assert len(out) == len(times) and {r.status for r in out} == {"ok", "not listed"}
