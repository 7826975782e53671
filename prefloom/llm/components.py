"""Connected components of a table of links, by alternating star contraction."""

from pyspark.sql import functions as F

from prefloom.llm.common import stored


def _nearest(links):
    return links.groupBy("u").agg(F.min("v").alias("low"))


def _both_ways(links):
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links):
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    ways = _both_ways(links)
    low = _nearest(ways).withColumn("low", F.least("low", "u"))
    return (
        ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
    )


def _small_star(links):
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _nearest(down)
    moved = down.join(low, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionAll(low.select("u", F.col("low").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(spark, links):
    """(node, component): each linked node with the smallest node it reaches.

    `links` has bigint columns u and v; loops and repeated links do no harm, null ends are left
    out, nodes without a link do not appear. Minima are combined before each shuffle; each round is stored in the
    shared folder, so a lost executor never goes back further than one round.
    """
    links = stored(spark, links.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        links = stored(spark, _small_star(_large_star(links)))
        mark = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if mark == before:
            break
        before = mark
    low = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(low)
