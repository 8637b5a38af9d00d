from datetime import date

import __spark_entry__ as entry
from plenaria.operators import lookups


def test_next_after_makes_no_pairs(spark):
    events = spark.createDataFrame([(i, 1 + i % 2, date(2024, 1, 1 + i % 28)) for i in range(500)] + [(900, 1, None), (901, None, date(2024, 1, 1)), (902, 3, date(2024, 1, 1)), (903, 1, date(2024, 6, 1))], "sid bigint, who bigint, day date")
    reactions = [(1 + i % 2, date(2024, 1, 1 + (7 * i) % 30), i) for i in range(300)] + [(1, None, 901), (None, date(2024, 1, 3), 902)]
    later = spark.createDataFrame(reactions, "who bigint, at date, id bigint")
    df = lookups.next_after(events, later, ["who"], "day", "at", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan.replace("asof_left_join", "")
    found = {r["sid"]: (r["at"], r["id"]) for r in df.collect()}
    expected = {}
    for sid, who, day in (tuple(r) for r in events.collect()):
        after = [(at, k) for w, at, k in reactions if w is not None and w == who and at and day and at >= day]
        if after:
            expected[sid] = min(after)
    assert found == expected and len(found) > 400


def test_all_speeches_are_covered(spark):
    every = entry.queries()["j7_next_aside_all"](spark, "/root/testdata/sf0.01")
    labelled = entry.queries()["j7_next_aside"](spark, "/root/testdata/sf0.01")
    assert every.count() > 5 * labelled.count() and labelled.subtract(every).isEmpty()
