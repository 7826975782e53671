import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators import ordering
from tests.conftest import plan_of


@pytest.mark.parametrize("bits,span", [(3, 9), (16, 64), (20, 40)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_aggregates_match_a_loop(spark, bits, span, inclusive):
    rng = random.Random(bits * 100 + span)
    rows = []
    for run, size in ((0, 300), (1, 40), (2, 1)):
        for step in rng.sample(range(-50, 500), size):
            rows.append((run, step, rng.randint(-9, 9), rng.choice([None, rng.randint(0, 99)])))
    frame = spark.createDataFrame(rows, "run INT, step BIGINT, x INT, y INT").repartition(5)
    got = ordering.running_aggregates(
        frame, "step", {"total": ("sum", F.col("x")), "top": ("max", F.col("y"))},
        by=["run"], inclusive=inclusive, bits=bits, span=span,
    )
    assert got.columns == ["run", "step", "x", "y", "total", "top"]
    found = {(r.run, r.step): (r.total, r.top) for r in got.collect()}
    assert len(found) == len(rows)
    for run, step, x, _ in rows:
        before = [r for r in rows if r[0] == run and (r[1] <= step if inclusive else r[1] < step)]
        tops = [r[3] for r in before if r[3] is not None]
        assert found[run, step] == (sum(r[2] for r in before), max(tops) if tops else None)


@pytest.mark.parametrize("bits,span", [(2, 6), (16, 64), (20, 40)])
def test_positions(spark, bits, span):
    rng = random.Random(span)
    keys = [rng.randint(-(2**60), 2**60) for _ in range(200)] + list(range(150))
    frame = spark.createDataFrame([(k,) for k in keys], "key BIGINT").repartition(6)
    got = ordering.with_position(frame, "key", bits=bits, span=span).orderBy("position").collect()
    assert [(r.key, r.position) for r in got] == [(k, i) for i, k in enumerate(sorted(keys))]


def test_positions_do_not_depend_on_partitions(spark):
    frame = spark.range(500).select((F.col("id") * 7919 % 5003).alias("key"))
    results = [
        sorted(map(tuple, ordering.with_position(frame.repartition(n), "key", bits=4, span=12).collect()))
        for n in (1, 3, 8)
    ]
    assert results[0] == results[1] == results[2]


def test_a_hot_group_is_split_into_blocks(spark):
    """Rows are shuffled once, by group and block, and never by group alone."""
    frame = spark.range(10_000).select(F.when(F.col("id") >= 0, 7).alias("run"), F.col("id").alias("step"))
    got = ordering.running_aggregates(frame, "step", {"n": ("sum", F.lit(1))}, by=["run"], bits=8, span=24)
    plan = plan_of(got)
    assert "hashpartitioning(run" in plan and "SinglePartition" not in plan
    assert got.where("n != step + 1").count() == 0


@pytest.mark.parametrize("bits,span", [(20, 40), (2, 6)])
def test_first_n(spark, bits, span):
    keys = sorted((i * 7919) % 1009 - 300 for i in range(30))
    frame = spark.createDataFrame([(k, str(k)) for k in keys], "key BIGINT, text STRING").repartition(4)
    for n in (1, 7, 30):
        assert frame.select(ordering.nth_key(frame, n, "key", bits, span).alias("k")).first().k == keys[n - 1]
    for n, want in ((None, 30), (0, 30), (7, 7), (30, 30), (99, 30)):
        rows = ordering.first_n(frame, n, "key").collect()
        assert sorted(r.key for r in rows) == keys[:want]


def test_first_n_rejects_negatives_and_moves_no_rows(spark):
    with pytest.raises(ValueError):
        ordering.first_n(spark.range(3), -1, "id")
    frame = spark.range(100).select("id", F.repeat(F.lit("x"), 10).alias("text"))
    main = plan_of(ordering.first_n(frame, 5, "id")).split("Subquery")[0]
    assert "TakeOrdered" not in main and "Exchange" not in main


def test_fan_out_needs_no_cross_join(spark):
    numbered = spark.createDataFrame([(0, "x"), (1, "y")], "no INT, name STRING")
    got = ordering.fan_out(spark.range(3), numbered, "no", 2)
    assert sorted(map(tuple, got.collect())) == [(i, n) for i in range(3) for n in "xy"]
    assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)
