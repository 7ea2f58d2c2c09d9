"""Joins of a large table to a small row per key, safe where one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_per_key(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has few rows per key (a count, a mean, a header, a command).

    The join is a plain one. Spark splits the rows of a hot key over several tasks
    once the shuffle has shown that they are many, but only where both sides come
    straight from a shuffle for this join; an aggregate by the same keys does not.
    So the small side is dealt out once more below the join. A small side under
    Spark's broadcast threshold is broadcast by Spark itself.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    parts = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return big.join(small.repartition(parts), keys, how)
