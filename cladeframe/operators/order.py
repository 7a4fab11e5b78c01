"""Numbers over all rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.scratch import written

#: Places of a numbering that are summed in one group.
BUCKET = 1 << 14


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their numbers 0, 1 ... in an order that tells them apart, written once.

    Ranges of the order are sorted side by side, so that neither a partition nor a frequent key is one
    task; a range's first number is the sum of the counts of those before, one row a range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = held.withColumn("__part", part).join(F.broadcast(starts), "__part")  # as many rows as there are shuffle partitions
    return joined.withColumn(name, F.col("__start") + within).drop("__at", "__part", "__start")


def running(rows: DataFrame, sums: dict[str, Column], at: str = "pre", key: str = "tree_id") -> DataFrame:
    """rows with running sums by name: of a key's rows up to and with this one, in order of `at`, which tells them
    apart. Buckets of BUCKET places are summed side by side, and a bucket starts from the sums of those before."""
    dealt = rows.withColumn("__bucket", F.floor(F.col(at) / BUCKET))
    totals = dealt.groupBy(key, "__bucket").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(key, "__bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(starts, [key, "__bucket"])
    return summed.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def subtree_sums(nodes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """tree_id, node_id and the sums by name over the nodes at or below each, from running sums in pre-order."""
    own = nodes.select("tree_id", "node_id", "pre", "post", *[c.alias(f"__own_{n}") for n, c in sums.items()])
    upto = written(running(own, {n: F.col(f"__own_{n}") for n in sums}))
    ends = upto.select("tree_id", F.col("pre").alias("post"), *[F.col(n).alias(f"__till_{n}") for n in sums])
    met = upto.join(ends, ["tree_id", "post"])
    return met.select("tree_id", "node_id", *[(F.col(f"__till_{n}") - F.col(n) + F.col(f"__own_{n}")).alias(n) for n in sums])
