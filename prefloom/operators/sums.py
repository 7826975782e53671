"""Sums of doubles that do not depend on the order of additions.

Doubles are cut into integer limbs, and integers add up to the same sum however rows are dealt to
partitions, combined early or computed again after a loss.
"""

from functools import reduce

from pyspark.sql import functions as F

# A band holds the values of so many neighbouring exponents; a limb has so many bits.
BAND_BITS, LIMB_BITS = 32, 29
MANTISSA_BITS = 53


def _times_power(x, power):
    """x * 2**power in two steps: one power alone may be beyond the doubles."""
    half = F.call_function("div", power, F.lit(2))
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def _limbs(x, names):
    """Integers of LIMB_BITS bits, highest first, that make up the integer-valued double x exactly."""
    found, rest = [], x
    for place, name in reversed(list(enumerate(reversed(names)))):
        unit = float(1 << (place * LIMB_BITS))
        limb = (rest / F.lit(unit)).cast("bigint")
        found.append(limb.alias(name))
        rest = rest - limb.cast("double") * F.lit(unit)
    return found


def _total(names):
    """The exact value of summed limbs, as a decimal."""
    parts = [
        F.col(name).cast("decimal(19,0)") * F.lit(1 << (place * LIMB_BITS)).cast("decimal(18,0)")
        for place, name in enumerate(reversed(names))
    ]
    return reduce(lambda a, b: a + b, [part.cast("decimal(38,0)") for part in parts])


def exact_sums(frame, by, columns):
    """Per group, for every named column: its sum, `<name>_n` values, `<name>_low` and `<name>_high`.

    Null values do not count; a group without values has a null sum, as in SQL, and so have its
    bounds. NaN and infinities give what double additions give. Within a band of exponents a sum is
    exact for up to 2**34 rows, beyond which it fails instead of wrapping; bands are added
    from the smallest up. `by` may be empty: an empty frame then still gives a row.

    Rows are combined before the only shuffle of them, to a row per group, column and band.
    """
    by, names = list(by), ["_hi", "_mid", "_lo"]
    x, finite = F.col("_x"), F.abs(F.col("_x")) < F.lit(float("inf"))
    entries = [
        F.struct(F.lit(i).alias("_i"), column.cast("double").alias("_x")) for i, column in enumerate(columns.values())
    ]
    band = F.floor(F.log2(F.abs(x)) / BAND_BITS)
    rows = frame.select(*by, F.inline(F.array(*entries))).withColumn(
        "_band", F.when(finite & (x != 0), band).otherwise(0).cast("bigint")
    )
    # No bit of a value of the band lies below its first power: the value is an integer there.
    whole = _times_power(F.when(finite, x), F.lit(MANTISSA_BITS) - F.col("_band") * BAND_BITS)
    banded = (
        rows.withColumn("_whole", whole)
        .select(*by, "_i", "_band", "_x", F.when(~finite | F.isnan(x), x).alias("_odd"), *_limbs(F.col("_whole"), names))
        .groupBy(*by, "_i", "_band")
        .agg(
            F.count("_x").alias("_n"),
            F.min("_x").alias("_low"),
            F.max("_x").alias("_high"),
            F.sum("_odd").alias("_odd"),
            *[F.sum(name).alias(name) for name in names],
        )
        .withColumn("_part", _times_power(_total(names).cast("double"), F.col("_band") * BAND_BITS - MANTISSA_BITS))
    )
    out = []
    for i, name in enumerate(columns):
        mine = F.col("_i") == i

        def of(column):
            return F.when(mine, F.col(column))

        parts = F.array_sort(F.collect_list(F.when(mine & F.col("_part").isNotNull(), F.struct("_band", "_part"))))
        summed = F.aggregate(parts, F.lit(0.0), lambda total, part: total + part["_part"])
        odd, n = F.sum(of("_odd")), F.coalesce(F.sum(of("_n")), F.lit(0))
        out += [
            F.when(n > 0, F.coalesce(odd, F.lit(0.0)) + summed).alias(name),
            n.alias(f"{name}_n"),
            F.min(of("_low")).alias(f"{name}_low"),
            F.max(of("_high")).alias(f"{name}_high"),
        ]
    return banded.groupBy(*by).agg(*out)


def grid_exponent(largest):
    """The exponent of a power of two that is above `largest`, which is not negative; 0 for 0."""
    return F.when(largest > 0, F.floor(F.log2(largest)) + 2).otherwise(0).cast("bigint")


def on_grid(x, exponent):
    """x as a whole number of 2**(exponent - 57), for any x below 2**exponent in size."""
    return F.rint(_times_power(x, F.lit(2 * LIMB_BITS - 1) - exponent))


def grid_limbs(whole, names):
    """The two integers of a value on a grid. Integers of one grid add up to the same in any order,
    so they serve running sums; `grid_value` reads a sum of up to 2**34 values."""
    return _limbs(whole, names)


def grid_value(hi, lo, exponent):
    whole = hi.cast("double") * F.lit(float(1 << LIMB_BITS)) + lo.cast("double")
    return _times_power(whole, exponent - F.lit(2 * LIMB_BITS - 1))
