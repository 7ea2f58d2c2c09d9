"""Numbering and running sums inside groups that may hold a large share of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: str, value, out: str, chunk: int = 1_000_000) -> DataFrame:
    """Sum of ``value`` over the rows before each row, in its group, by an integer column.

    A plain window partitioned by ``keys`` sends a hot group to one task. Here
    ``order`` is cut into chunks of equal width: the sum runs inside
    (keys, chunk), and the small table of chunk totals gives each chunk its
    offset. ``order`` must be unique inside a group, so a chunk holds at most
    ``chunk`` rows.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk))).withColumn("_v", value)
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_chunk", "_v", "_inside", "_offset")
    )


def row_chunks(df: DataFrame, keys: list[str], order: str, rows: int, out: str = "chunk", bins: int = 4096) -> DataFrame:
    """``df`` with a chunk number per row, in the order of ``order``, for groups that are walked.

    A group of up to ``rows`` rows is chunk 0. A larger one is counted in ``bins``
    equal steps of ``order``, and neighbouring steps are joined until they hold
    ``rows`` rows. The counts of few large groups are all that is joined back.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    large = large.where(F.col("_n") > rows).withColumn("_step", F.expr(f"(_hi - _lo) div {bins} + 1")).drop("_n", "_hi")
    large = large.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    binned = df.join(large, keys, "left").withColumn("_bin", F.expr(f"({order} - _lo) div _step")).drop("_lo", "_step")
    counts = binned.where("_bin is not null").groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    named = counts.select(*keys, "_bin", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("long").alias(out))
    return binned.join(named, [*keys, "_bin"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("_bin")


def last_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The ``n`` rows that sort first by ``order`` (given descending: the last) in each group.

    Spark turns the bounded ``row_number`` into a group limit that runs before
    the exchange, so each map task sends at most ``n`` rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
