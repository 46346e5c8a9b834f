from __future__ import annotations

from lychgate.operators import replay


def test_differences_count_rows(spark):
    schema = "a int, b string"
    first = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], schema)
    second = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("y", 4)], "b string, a int")
    rows = sorted(map(tuple, replay.differences(first, second).collect()), key=repr)
    assert rows == sorted([(1, "x", "first"), (3, "z", "first"), (2, None, "second"), (4, "y", "second")], key=repr)
    assert tuple(replay.agreement(first, second).first()) == (2, 2, 2)
    assert replay.differences(first, first.repartition(3)).count() == 0
    assert tuple(replay.agreement(first.limit(0), first.limit(0)).first()) == (0, 0, 0)


def test_each_run_is_made_once(spark):
    plan = replay.agreement(spark.range(5), spark.range(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 2
