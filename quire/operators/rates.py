"""Sliding-window rate limits and offered load."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.ranking import last_rows, running_sum
from quire.session import cut_lineage

WINDOWS = 4  # windows' widths in a bucket of time


def stamped(requests: DataFrame, key: str | None, *more: str) -> DataFrame:
    """(request_id, key, us, ``more``) with the time in whole microseconds; one key for all if none is given."""
    owner = F.lit("all") if key is None else F.col(key).cast("string")
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    return requests.select("request_id", owner.alias("key"), us, *more)


def request_rate(requests: DataFrame, window_s: int = fv.RATE_LIMIT_WINDOW_S, key: str | None = None) -> DataFrame:
    """Requests in the closed window that ends at each request of ``requests(request_id, ts)``.

    Requests with equal times are counted together first; their windows' loads are running sums.
    """
    asked = stamped(requests, key)
    times = asked.groupBy("key", "us").agg(F.count(F.lit(1)).alias("n"))
    load = window_loads(times, window_s * 1_000_000).where("_own = _bucket").select("key", "us", "load")
    return asked.join(load, ["key", "us"])


def window_loads(times: DataFrame, width: int, ahead: bool = False) -> DataFrame:
    """``times(key, us, n)`` with ``load``, the requests in the closed window of ``width`` that ends at each time.

    A time adds its requests when it comes and takes them away when it has left the window, so a load is a running sum
    and costs the same however many requests a window holds. The sums run within (key, bucket of several widths), never
    over a hot key alone. A time that is still in the window when its bucket ends goes into the next one as well.
    ``ahead`` gives the times of a bucket's first width to the bucket before too; ``_own`` and ``_bucket`` tell which
    row is the time's own one.
    """
    span = WINDOWS * width
    us, n = F.col("us"), F.col("n")
    left = us + width + 1
    own, inside, stays = F.floor(us / span), F.pmod(us, F.lit(span)), F.floor(left / span) > F.floor(us / span)

    def step(bucket: Column, at: Column, change: Column, is_time: bool) -> Column:
        return F.struct(bucket.alias("_bucket"), at.alias("_at"), change.alias("_change"), F.lit(is_time).alias("_is_time"))

    steps = [step(own, us, n, True), step(own, left, -n, False)]
    steps += [F.when(stays, step(own + 1, us, n, False)), F.when(stays, step(own + 1, left, -n, False))]
    if ahead:
        steps.append(F.when(inside <= width, step(own - 1, us, n, True)))
    moved = times.withColumn("_own", own).withColumn("_step", F.explode(F.array_compact(F.array(*steps))))
    up_to = Window.partitionBy("key", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    moved = moved.select(*times.columns, "_own", "_step.*").withColumn("load", F.sum("_change").over(up_to))
    return moved.where("_is_time").drop("_at", "_change", "_is_time")


def contested(times: DataFrame, width: int, limit: int) -> DataFrame:
    """The rows of ``times(key, us, n)`` that a limit can bear on: those with more than ``limit`` requests in the window
    that ends at them, and those in such a window.

    At any other time everything is admitted: no more than ``limit`` requests were even made. The first time over the
    limit from each time on is a running minimum, from the end of each bucket and the width after it to its start.
    """
    loads = window_loads(times, width, ahead=True)
    down = Window.partitionBy("key", "_bucket").orderBy(F.desc("us")).rowsBetween(Window.unboundedPreceding, 0)
    met = loads.withColumn("_hot", F.min(F.when(F.col("load") > limit, F.col("us"))).over(down))
    return met.where((F.col("_hot") <= F.col("us") + width) & (F.col("_own") == F.col("_bucket"))).select(*times.columns)


def stretches(times: DataFrame, width: int, part_rows: int) -> DataFrame:
    """Contested ``times(key, us, n)`` with a stretch and a part of it.

    Between two stretches lies a whole width without a contested time, so each can be walked without knowing the
    one before. A stretch is cut into parts of at most ``part_rows`` times.
    """
    span = WINDOWS * width
    own = F.floor(F.col("us") / span)
    late = F.when(F.pmod("us", F.lit(span)) >= span - width, own + 1)
    copies = times.withColumn("_own", own).withColumn("_bucket", F.explode(F.array_compact(F.array(own, late))))
    before = F.lag("us").over(Window.partitionBy("key", "_bucket").orderBy("us"))
    begun = copies.withColumn("_first", F.coalesce(before < F.col("us") - width, F.lit(True)))
    begun = cut_lineage(begun.where("_own = _bucket").drop("_own", "_bucket"))
    chunk = 4 * span
    named = running_sum(begun, ["key"], "us", F.col("_first").cast("long"), "_before", chunk)
    named = named.withColumn("stretch", F.col("_before") + F.col("_first").cast("long")).drop("_before", "_first")
    counted = running_sum(named, ["key", "stretch"], "us", F.lit(1), "_at", chunk)
    return counted.withColumn("part", F.floor(F.col("_at") / part_rows).cast("long")).drop("_at")


def walk(us, n, live: deque, width: int, limit: int) -> list[tuple[int, int]]:
    """(place, requests admitted) of the times of a part that let any in; ``live`` holds the admitted times of the last window.

    While the window is full nothing gets in before its oldest request is more than a width old, so the walk goes
    straight to the first time after that: it takes a step per admitted time, none per rejected one.
    """
    out, i, end = [], 0, len(us)
    while i < end:
        now = us[i]
        while live and live[0] < now - width:
            live.popleft()
        free = limit - len(live)
        if free <= 0:
            i = bisect_right(us, live[0] + width, i + 1) if live else end
            continue
        taken = min(n[i], free)
        live.extend([now] * taken)
        out.append((i, taken))
        i += 1
    return out


def admitted_times(times: DataFrame, window_s: int, limit: int, part_rows: int = 200_000) -> DataFrame:
    """(key, us, n, taken): how many of the ``n`` requests at each contested time of ``times(key, us, n)`` are admitted.

    A part is one row with its sorted times; the parts of a stretch follow one another, and only the admitted times
    of the last window go from one to the next. All stretches run side by side. A key over its limit all the time is
    one stretch, a chain by nature, whose steps are its admitted times.
    """
    width = window_s * 1_000_000
    cut = cut_lineage(stretches(contested(times, width, limit), width, part_rows))
    group = ["key", "stretch", "part"]
    parts = cut.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("us", "n"))).alias("times"))
    parts = parts.repartition("key", "stretch").sortWithinPartitions(*group)

    def run(batches):
        before, live = None, deque()
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = batch.column(3)
            at = rows.offsets.to_numpy()
            us, n = (np.ascontiguousarray(rows.values.field(f).to_numpy()) for f in (0, 1))
            found = {"key": [], "us": [], "taken": []}
            for k, owner in enumerate(zip(keys, names, strict=True)):
                if owner != before:
                    before, live = owner, deque()
                lo, hi = int(at[k]), int(at[k + 1])
                mine = us[lo:hi]
                for place, taken in walk(memoryview(mine), memoryview(n[lo:hi]), live, width, limit):
                    found["key"].append(owner[0])
                    found["us"].append(int(mine[place]))
                    found["taken"].append(taken)
            types = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types, strict=True)], list(found))

    walked = parts.mapInArrow(run, "key string, us long, taken long")
    return cut.select("key", "us", "n").join(walked, ["key", "us"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def admitted(asked: DataFrame, window_s: int, limit: int, part_rows: int = 200_000) -> DataFrame:
    """``asked(request_id, key, us)`` with ``admitted``; of equal times the smallest ids come first, null before all."""
    times = asked.where("key is not null and us is not null").groupBy("key", "us").agg(F.count(F.lit(1)).alias("n"))
    taken = cut_lineage(admitted_times(times, window_s, limit, part_rows))
    split = taken.where("taken > 0 AND taken < n")
    # the last admitted id where only some of the requests of one time get in
    first_ids = last_rows(asked.join(split.select("key", "us"), ["key", "us"], "left_semi"), ["key", "us"], ["request_id"], limit)
    rank = Window.partitionBy("key", "us").orderBy("request_id")
    cutoff = (
        first_ids.withColumn("_rank", F.row_number().over(rank))
        .join(split, ["key", "us"])
        .where("_rank = taken")
        .select("key", "us", F.col("request_id").alias("_cutoff"))
    )
    told = taken.join(cutoff, ["key", "us"], "left")
    let_in = F.col("n").isNull() | (F.col("taken") == F.col("n")) | F.coalesce(F.col("request_id") <= F.col("_cutoff"), F.lit(False))
    known = F.col("key").isNotNull() & F.col("us").isNotNull()
    return asked.join(told, ["key", "us"], "left").select(*asked.columns, (known & let_in).alias("admitted"))


def rate_limit(
    requests: DataFrame,
    window_s: int = fv.RATE_LIMIT_WINDOW_S,
    limit: int = fv.RATE_LIMIT_REQUESTS,
    key: str | None = None,
    part_rows: int = 200_000,
) -> DataFrame:
    """Whether each of ``requests(request_id, ts)`` is admitted; rejected ones do not count.

    Requests at the same time are admitted in ``request_id`` order. One without a key or a time is not admitted.
    """
    return admitted(stamped(requests, key), window_s, limit, part_rows).select("request_id", "key", "admitted")
