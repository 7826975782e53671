import math
import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators.sums import exact_sums, grid_exponent, grid_limbs, grid_value, on_grid


def values():
    dice = random.Random(3)
    found = [dice.uniform(-1, 1) * 10.0 ** dice.randint(-12, 12) for _ in range(3000)]
    return found + [5e-324, -5e-324, 1e300, -1e300, 0.0, -0.0, 2.0**32, 2.0**-32, 1.0, None]


def frame_of(spark, rows):
    return spark.createDataFrame([(i % 3, v) for i, v in enumerate(rows)], "g INT, x DOUBLE")


def test_sums_equal_a_correctly_rounded_loop(spark):
    rows = values()
    for r in exact_sums(frame_of(spark, rows), ["g"], {"s": F.col("x"), "d": F.col("x") * 2}).collect():
        mine = [v for i, v in enumerate(rows) if i % 3 == r.g and v is not None]
        assert r.s == pytest.approx(math.fsum(mine), rel=1e-15) and r.d == 2 * r.s
        assert (r.s_n, r.s_low, r.s_high) == (len(mine), min(mine), max(mine))


def test_every_order_and_partitioning_gives_the_same_bits(spark):
    rows, found = values(), set()
    for seed, parts in ((1, 1), (2, 7), (3, 16)):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame([(v,) for v in rows], "x DOUBLE").repartition(parts)
        found.add(exact_sums(frame, [], {"s": F.col("x")}).first().s.hex())
    assert len(found) == 1


def test_cancelled_bands_leave_what_is_small(spark):
    frame = frame_of(spark, [1e300, 1e300, 1e300, 1.0, 2.0, 3.0, -1e300, -1e300, -1e300])
    assert sorted(r.s for r in exact_sums(frame, ["g"], {"s": F.col("x")}).collect()) == [1.0, 2.0, 3.0]


def test_odd_values_and_empty_tables(spark):
    inf = float("inf")
    frame = frame_of(spark, [inf, None, inf, 1.0, None, -inf, inf])
    got = {r.g: (r.s, r.s_n) for r in exact_sums(frame, ["g"], {"s": F.col("x")}).collect()}
    assert got[0] == (inf, 3) and got[1] == (None, 0) and math.isnan(got[2][0])
    nan = exact_sums(frame_of(spark, [float("nan")] * 3 + [1.0] * 3), ["g"], {"s": F.col("x")}).collect()
    assert all(math.isnan(r.s) for r in nan)
    none = frame.limit(0)
    assert exact_sums(none, ["g"], {"s": F.col("x")}).count() == 0
    assert tuple(exact_sums(none, [], {"s": F.col("x")}).first()) == (None, 0, None, None)


def test_grid_integers_read_back(spark):
    rows = [v for v in values() if v is not None and abs(v) < 1e13]
    frame = spark.createDataFrame([(v,) for v in rows], "x DOUBLE")
    placed = frame.withColumn("e", grid_exponent(F.lit(max(map(abs, rows))))).withColumn("w", on_grid(F.col("x"), F.col("e")))
    cut = placed.select("e", *grid_limbs(F.col("w"), ("hi", "lo"))).groupBy("e").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    assert cut.select(grid_value(F.col("hi"), F.col("lo"), F.col("e")).alias("s")).first().s == pytest.approx(math.fsum(rows), rel=1e-12)
