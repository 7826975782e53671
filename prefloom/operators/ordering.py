"""Row positions, row caps and running aggregates that never need one task to see everything.

The obvious forms (a window without partitions, or one partitioned only by a run) put a whole
table or a whole run into one task. Here an integer order key is cut into blocks of 2**bits
consecutive values. Each window covers one block, and block totals are carried forward from a
small table that is aggregated before it is shuffled.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_BITS = 20
KEY_BITS = 64


def _running_sum(within, carried):
    return F.coalesce(within, F.lit(0)) + F.coalesce(carried, F.lit(0))


_AGGREGATES = {"sum": (F.sum, _running_sum), "max": (F.max, F.greatest)}


def running_aggregates(df, order, aggregates, by=(), inclusive=True, bits=BLOCK_BITS, span=KEY_BITS):
    """Running sums and maxima over an integer order key, per group of `by`.

    `aggregates` maps an output name to `("sum" | "max", column)`. With `inclusive=False` the
    current row is left out. (`by`, `order`) must be unique and never null.

    The rows are shuffled once, on (`by`, block); a block holds at most 2**bits rows whatever
    the group size. The carried totals go through the same function one level up, so no level
    has a larger window as long as keys stay below 2**span, which the default grants for every
    key. A span known to be smaller spares levels; the result is the same for every choice.
    """
    by = list(by)
    end = Window.currentRow if inclusive else -1
    top = span <= bits
    block = f"_block_{order}"
    blocked = df if top else df.withColumn(block, F.shiftright(F.col(order), bits))
    cells = by if top else [*by, block]
    window = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    running = {
        name: _AGGREGATES[how][0](column).over(window) for name, (how, column) in aggregates.items()
    }
    if top:
        # An empty frame sums to zero.
        return df.withColumns(
            {
                name: F.coalesce(column, F.lit(0)) if aggregates[name][0] == "sum" else column
                for name, column in running.items()
            }
        )

    totals = blocked.groupBy(*cells).agg(
        *[_AGGREGATES[how][0](column).alias(f"_total_{name}") for name, (how, column) in aggregates.items()]
    )
    carried = running_aggregates(
        totals,
        block,
        {f"_before_{name}": (how, F.col(f"_total_{name}")) for name, (how, _) in aggregates.items()},
        by=by,
        inclusive=False,
        bits=bits,
        span=span - bits,
    ).select(*cells, *[f"_before_{name}" for name in aggregates])

    within = blocked.withColumns({f"_within_{name}": column for name, column in running.items()})
    combined = [
        _AGGREGATES[how][1](F.col(f"_within_{name}"), F.col(f"_before_{name}")).alias(name)
        for name, (how, _) in aggregates.items()
    ]
    return within.join(carried, cells, "left").select(*df.columns, *combined)


def with_position(df, key, name="position", bits=BLOCK_BITS, span=KEY_BITS):
    """A 0-based position by a unique integer key."""
    ranked = running_aggregates(df, key, {name: ("sum", F.lit(1))}, inclusive=False, bits=bits, span=span)
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def nth_key(df, n, key, bits=BLOCK_BITS, span=KEY_BITS):
    """The n-th smallest of a unique integer key as a scalar subquery; null when there are fewer.

    Only keys are read. Counts per block are combined before their shuffle, and only the one
    block that holds the answer is ranked.
    """
    keys = df.select(key, F.shiftright(F.col(key), bits).alias("_block"))
    counts = keys.groupBy("_block").agg(F.count("*").alias("_n"))
    running = running_aggregates(
        counts, "_block", {"_before": ("sum", F.col("_n"))}, inclusive=False, bits=bits, span=span - bits
    )
    holder = running.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    # At most one block qualifies, so the broadcast is one row.
    inside = keys.join(F.broadcast(holder), "_block").withColumn("_rank", rank + F.col("_before"))
    return inside.where(F.col("_rank") == n).select(key).scalar()


def first_n(df, n, key):
    """The first n rows by a unique integer key, in no particular order. None and 0 mean no cap.

    Rows are kept by comparing their key with the n-th one: a filter, however large n is, where
    a sorted limit would send n whole rows of every partition to one task.
    """
    if n is None or n == 0:
        return df
    if n < 0:
        raise ValueError("n must not be negative")
    return df.where(F.col(key) <= F.coalesce(nth_key(df, n, key), F.col(key)))


def fan_out(df, numbered, number, count):
    """Every row of `df` with every row of `numbered`, whose `number` column runs 0..count-1.

    Each row emits its own numbers and meets them in an equi-join, so the plan has neither a
    cross join nor a nested loop and streams as many rows as the result has.
    """
    if count < 1:
        raise ValueError("nothing to fan out to")
    numbers = df.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return numbers.join(numbered, number).drop(number)
