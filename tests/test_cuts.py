import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import ranking as W
from corpuskit.operators.cuts import as_number, cut_at


@pytest.mark.parametrize("digit", [3, 12])
def test_cuts_stand_where_sorting_puts_them(spark, monkeypatch, digit):
    from corpuskit.operators import cuts
    monkeypatch.setattr(cuts, "DIGIT", digit)
    r = random.Random(digit)
    values = [r.choice([None, 0, -1, 5, r.randrange(-9, 9), r.randrange(-2**63, 2**63), 2**63 - 1, -2**63 + 1]) for _ in range(300)]
    rows = [(v, r.randrange(3), i) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "v long, w int, i long").repartition(4, "i")
    order = [as_number(F.col("v"), "bigint"), as_number(F.col("w"), "int")]
    wanted = [0, 1, 17, 17, 150, 299, 300, 400]
    got = {x.i: x.s for x in cut_at(d, order, wanted, [f"s{k}" for k in range(len(wanted))] + ["rest"], "s").collect()}
    key = lambda x: (-2**63 if x[0] is None else x[0], x[1])
    names = [next((f"s{k}" for k, w in enumerate(wanted) if p < w), "rest") for p in range(300)]
    # rows that tie may change places
    assert sorted((key(x), got[x[2]]) for x in rows) == sorted((key(x), n) for x, n in zip(sorted(rows, key=key), names))


def test_splits_of_repeated_keys_have_exact_sizes(spark):
    d = spark.createDataFrame([(i % 3, i) for i in range(101)], "k long, i long").repartition(3)
    sizes = lambda x, c: sorted((r[0], r[1]) for r in x.groupBy(c).count().collect())
    assert sizes(W.random_split(d, "k"), "split") == [("test", 11), ("train", 80), ("validation", 10)]
    assert sizes(W.random_split(d, "k", (0.9, 0.1), ("train", "validation"), rounding="ceil_last"), "split") == [("train", 90), ("validation", 11)]
    assert sizes(W.kfold(d, "k", 4), "fold") == [(0, 26), (1, 25), (2, 25), (3, 25)]
    assert sizes(W.positional_split(d, "k"), "split") == [("train", 90), ("validation", 11)]
    assert sizes(W.kfold(d.limit(2), "i", 4), "fold") == [(0, 1), (1, 1)]
    assert W.random_split(d.filter("false"), "k").count() == 0


def test_splits_do_not_depend_on_partitions_and_leave_no_columns(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i * 7 % 50), f"n{i}") for i in range(50)]
    d = spark.createDataFrame(rows, "day date, name string")
    for split in (lambda x: W.random_split(x, "name"), lambda x: W.kfold(x, "name", 3), lambda x: W.positional_split(x, "day"), lambda x: W.positional_split(x, "name")):
        one, many = split(d.coalesce(1)), split(d.repartition(7))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
        assert one.columns[:2] == ["day", "name"] and len(one.columns) == 3
    train = {r.name for r in W.positional_split(d, "day", 0.5).filter("split = 'train'").collect()}
    assert train == {n for _, n in sorted(rows)[:25]}


def test_no_sort_and_no_shuffle_of_rows(spark):
    d = spark.range(1000).withColumn("text", F.lit("x"))
    plan = W.random_split(d, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
