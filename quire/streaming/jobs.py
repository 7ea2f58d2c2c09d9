"""Structured Streaming jobs: ingest, rate limit, history, annotations and expiry.

Ingest, rate limit and history decide each micro-batch as a whole, with the batch
operators and a small stored state that the batch before left behind. So a hot key
is spread over tasks as it is in a batch, and a batch that runs again after a
failure reads the same state and writes the same rows into the same folders.
Decisions are final. A row that comes too late for one, because it lies further
behind the stream than allowed or before a row of its key that is already decided,
is not dropped: it goes to the ``late`` output. Every row comes out in one of both.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire import fixed_values as fv
from quire.functions.joins import join_per_key
from quire.operators import history, rates
from quire.session import cut_lineage
from quire.sources.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def read_folder(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int | None = 64) -> DataFrame:
    """Parquet files of a folder as a stream, in arrival order; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None):
    """Start an available-now query that writes each micro-batch to a folder of its own.

    A batch that runs again after a failure overwrites its own folder, so every
    row arrives exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if make is None else make(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- micro-batches with a stored state ---------------------------------------------

#: step(batch, state, clock) -> (decided rows, late rows, state for the next batch)
Step = Callable[[DataFrame, DataFrame | None, int | None], tuple[DataFrame, DataFrame, DataFrame]]


def decide_batches(
    stream: DataFrame, path: str, checkpoint: str, step: Step, event_time: str, late_s: int, keep_states: bool = False
) -> StreamingQuery:
    """Start an available-now query that decides each micro-batch by ``step`` and writes ``path/out`` and ``path/late``.

    ``step`` gets the batch with a column ``_late`` (more than ``late_s`` seconds behind the newest event of earlier
    batches), the state that the batch before left, and the newest event time so far, this batch included, in
    microseconds. State is in ``path/state``, one folder a batch; with ``keep_states`` none is deleted and ``step`` gets
    those of all earlier batches.
    """
    spark = stream.sparkSession

    def folder(name: str, batch_id: int) -> str:
        return f"{path}/{name}/batch_id={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        given = cut_lineage(batch, spark)
        us = F.unix_micros(F.col(event_time).cast("timestamp"))
        clock = state = None
        if batch_id:
            clock = spark.read.parquet(folder("clock", batch_id - 1)).first()[0]
            if keep_states:
                state = spark.read.parquet(f"{path}/state").where(F.col("batch_id") < batch_id).drop("batch_id")
            else:
                state = spark.read.parquet(folder("state", batch_id - 1))
        late = F.lit(False) if clock is None else F.coalesce(us < clock - late_s * 1_000_000, F.lit(False))
        newest = max((x for x in (clock, given.agg(F.max(us)).first()[0]) if x is not None), default=None)
        out, too_late, left = step(given.withColumn("_late", late), state, newest)
        for name, rows in (("out", out), ("late", too_late), ("state", left)):
            rows.write.mode("overwrite").parquet(folder(name, batch_id))
        spark.createDataFrame([(newest,)], "us long").coalesce(1).write.mode("overwrite").parquet(folder("clock", batch_id))
        old = [] if keep_states else [folder("state", batch_id - 2), folder("clock", batch_id - 2)]
        for name in old:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """The rows that have been decided by the query that writes to ``path``."""
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def too_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late for the query that writes to ``path``."""
    return spark.read.parquet(f"{path}/late").drop("batch_id")


# --- ingest --------------------------------------------------------------------


def stream_ingest(
    docs: DataFrame, path: str, checkpoint: str, accept, analyse, event_time: str = "ts", late_s: int = 86_400
) -> StreamingQuery:
    """Validate and analyse ``docs(doc_id, text, ts, ...)`` as they arrive, each id once.

    ``accept(docs)`` keeps the valid uploads, ``analyse(docs)`` gives the rows to store. Of an id that is delivered
    again the first delivery counts, within a batch the oldest; the ids delivered so far are the state.
    """

    def step(batch, state, clock):
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(event_time, F.xxhash64("text")))
        new = batch.where("NOT _late").withColumn("_n", first).where("_n = 1").drop("_n", "_late")
        if state is not None:
            new = new.join(state, "doc_id", "left_anti")
        new = cut_lineage(new)
        return analyse(accept(new)), batch.where("_late").drop("_late"), new.select("doc_id")

    return decide_batches(docs, path, checkpoint, step, event_time, late_s, keep_states=True)


# --- rate limit ------------------------------------------------------------------


def stream_rate_limit(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    window_s: int = fv.RATE_LIMIT_WINDOW_S,
    limit: int = fv.RATE_LIMIT_REQUESTS,
    key: str | None = None,
    late_s: int = 86_400,
    part_rows: int = 200_000,
) -> StreamingQuery:
    """Admission of ``requests(request_id, ts)`` per key, continuously: (request_id, key, admitted) and late requests.

    A request older than one of its key that is already decided is late. The state of a key is the time of its last
    decided request and the times admitted in the window before that, at most ``limit``; they go before the new
    requests into the batch operator, which admits them again, as they fit their windows. A key's state goes when
    whatever it could bear on would be late.
    """
    width = window_s * 1_000_000

    def step(batch, state, clock):
        asked = rates.stamped(batch, key, "_late")
        if state is not None:
            known = join_per_key(asked, state.select("key", "latest"), ["key"], "left")
            old = F.coalesce(F.col("us") < F.col("latest"), F.lit(False))
            asked = known.withColumn("_late", F.col("_late") | old).drop("latest")
        fresh = asked.where("NOT _late").select("request_id", "key", "us", F.lit(False).alias("carried"))
        if state is not None:
            carried = state.select(F.lit(None).cast("long").alias("request_id"), "key", F.explode("times").alias("us"))
            fresh = fresh.unionByName(carried.withColumn("carried", F.lit(True)))
        made = cut_lineage(rates.admitted(fresh, window_s, limit, part_rows))
        tops = made.select("key", "us").where("key is not null")
        if state is not None:
            tops = tops.unionByName(state.select("key", F.col("latest").alias("us")))
        tops = tops.groupBy("key").agg(F.max("us").alias("latest"))
        live = join_per_key(made.where("admitted").select("key", "us"), tops, ["key"]).where(F.col("us") >= F.col("latest") - width)
        live = live.groupBy("key").agg(F.sort_array(F.collect_list("us")).alias("times"))
        none = F.array().cast("array<long>")
        left = tops.join(live, "key", "left").withColumn("times", F.coalesce("times", none))
        if clock is not None:
            left = left.where(F.col("latest") >= clock - late_s * 1_000_000 - width)
        late = asked.where("_late").select("request_id", "key", F.timestamp_micros("us").alias("ts"))
        return made.where("NOT carried").select("request_id", "key", "admitted"), late, left

    return decide_batches(requests, path, checkpoint, step, "ts", late_s)


# --- history ---------------------------------------------------------------------


def stream_history(
    log: DataFrame,
    path: str,
    checkpoint: str,
    depth: int = fv.HISTORY_DEPTH,
    late_s: int = 86_400,
    ttl_h: int | None = fv.DOCUMENT_TTL_HOURS,
    chunk: int = 1_000_000,
) -> StreamingQuery:
    """Outcome of every edit, undo and redo of ``log(doc_id, seq, action, operation, ts)`` as it arrives, and late events.

    An event before one of its document that is already applied is late. The state of a document, its undo stack and
    last event, goes ``ttl_h`` hours of event time after that, as the document does (None: never).
    """
    columns = ["doc_id", "seq", "action", "operation", "ts"]

    def step(batch, state, clock):
        events = batch.select(*columns, "_late")
        if state is not None:
            known = join_per_key(events, state.select("doc_id", "latest"), ["doc_id"], "left")
            old = F.coalesce(F.col("seq") <= F.col("latest"), F.lit(False))
            events = known.withColumn("_late", F.col("_late") | old).drop("latest")
        events = cut_lineage(events)
        fresh = events.where("NOT _late")
        made = cut_lineage(history.replayed(fresh, depth, chunk, state))
        ends = made.where("seq is null").groupBy("doc_id").agg(F.max_by(F.struct("done", "seqs", "names"), "chunk_no").alias("x"))
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        tops = fresh.groupBy("doc_id").agg(F.max("seq").alias("latest"), F.max(us).alias("at"))
        left = ends.select("doc_id", "x.*").join(tops, "doc_id")
        if state is not None:
            left = left.unionByName(state.join(tops.select("doc_id"), "doc_id", "left_anti"))
        if ttl_h is not None and clock is not None:
            left = left.where(F.col("at") >= clock - ttl_h * 3_600_000_000)
        out = made.where("seq is not null").drop("chunk_no", "done", "seqs", "names")
        return out, events.where("_late").select(*columns), left

    return decide_batches(log, path, checkpoint, step, "ts", late_s)


# --- annotations -------------------------------------------------------------------


def annotation_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, ["doc_id", "page"], buckets)


def stream_annotations(log: DataFrame, path: str, checkpoint: str, buckets: int = 64, compact_every: int = 16) -> StreamingQuery:
    """Keep the last save per (doc_id, page) of ``log(doc_id, page, saved_at, seq, items)`` in a store.

    Each micro-batch rewrites the buckets of the store that it touches, under its own number; a batch that runs again
    changes nothing. Read with ``saved_annotations``.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct("saved_at", "seq", "items"), F.struct("saved_at", "seq")).alias("x")
        last = batch.groupBy("doc_id", "page").agg(newest).select("doc_id", "page", "x.*")
        store = annotation_store(spark, path, buckets)
        store.change(last, newest=["saved_at", "seq"], version=batch_id)
        if batch_id % compact_every == compact_every - 1:
            store.compact(keep=2)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved_annotations(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = 64) -> DataFrame:
    """The saved list of each wanted (doc_id, page), ``[]`` where none was saved: one scan of the store, no aggregation."""
    stored = annotation_store(spark, path, buckets).read()
    none = F.lit("[]")
    if stored is None:
        return wanted.withColumn("items", none)
    saved = stored.select("doc_id", "page", "items")
    return wanted.join(saved, ["doc_id", "page"], "left").withColumn("items", F.coalesce("items", none))


# --- expiry ------------------------------------------------------------------------


class _Expirer(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        latest = max(int(pdf["ms"].max()) for pdf in rows) + self.ttl_ms
        known = self.due.get()
        if known is None or latest > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.due.update((latest,))
            self.handle.registerTimer(latest)
        yield pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "expired_at_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield pd.DataFrame({"doc_id": [key[0]], "expired_at_ms": [at]})

    def close(self) -> None:
        pass


def stream_expiry(touches: DataFrame, ttl_h: int = fv.DOCUMENT_TTL_HOURS, late_after: str = "0 seconds") -> DataFrame:
    """Documents of ``touches(doc_id, ts)`` not touched for ``ttl_h`` hours of event time."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("expired_at_ms", T.LongType())])
    use_rocksdb(touches.sparkSession)
    return (
        touches.withWatermark("ts", late_after)
        .select("doc_id", "ts", F.unix_millis("ts").alias("ms"))
        .groupBy("doc_id")
        .transformWithStateInPandas(_Expirer(ttl_h * 3_600_000), schema, "Append", "EventTime")
    )
