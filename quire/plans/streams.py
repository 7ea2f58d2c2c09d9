"""Queries that run a stream over several deliveries of a table, some of them late, and read back what it wrote."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import analysis, ingest
from quire.plans import parts as P
from quire.plans.governance import WALK, _limit_walk
from quire.plans.registry import query
from quire.session import shared_dir, tune
from quire.sources import corpus
from quire.streaming import jobs

# Events arrive in four deliveries of eight days each, a few of them one or two deliveries later.
DELIVERIES = 4
LATE_S = 86_400
DELIVERED = f"""dl AS (SELECT *, least({DELIVERIES - 1}, (day(ts) - 1) // 8 + (event_id % 17 = 0)::INTEGER + 2 * (event_id % 29 = 0)::INTEGER) AS b
  FROM events)"""


def _delivery(events: DataFrame) -> DataFrame:
    days = F.floor((F.dayofmonth("ts") - 1) / 8)
    more = (F.col("event_id") % 17 == 0).cast("int") + 2 * (F.col("event_id") % 29 == 0).cast("int")
    return events.withColumn("b", F.least(F.lit(DELIVERIES - 1), days + more))


def _late(key: str, order: str) -> str:
    """dl with late: behind the stream of earlier deliveries by more than allowed, or before a row of its key in them."""
    return f"""kb AS (SELECT key, b, max(max(o)) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM (SELECT *, {key} AS key, {order} AS o FROM dl) GROUP BY key, b),
gb AS (SELECT b, max(max(epoch_us(ts))) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM dl GROUP BY b),
lt AS (SELECT d.*, coalesce({order} < known, false) OR coalesce(epoch_us(ts) < clock - {LATE_S * 1_000_000}, false) AS late
  FROM (SELECT *, {key} AS key FROM dl) d JOIN kb USING (key, b) JOIN gb USING (b))"""


def _run(spark: SparkSession, table: DataFrame, start) -> str:
    """Hand ``table`` over in the order of its column b, and after each delivery run ``start(stream, path, checkpoint)``.

    Every run goes on from the checkpoint of the one before, as scheduled runs of a job do. Returns the path.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    schema = table.drop("b").schema
    for b in range(DELIVERIES):
        table.where(F.col("b") == b).drop("b").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_folder(spark, f"{folder}/in", schema, files_per_trigger=None)
        start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _delivery(tune(spark).read.parquet(f"{sf}/events.parquet"))


def _both(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Decided and late rows in one table."""
    made = jobs.decided(spark, path).select(*columns).withColumn("late", F.lit(False))
    return made.unionByName(jobs.too_late(spark, path).withColumn("late", F.lit(True)), allowMissingColumns=True).select(*columns, "late")


for _name, _key, _expr, _window, _limit in (
    ("stream_rate_limit", "user_id", "user_id::VARCHAR", 86_400, 2),
    ("stream_rate_limit_global", None, "'all'", 3_600, 10),
):

    @query(
        _name,
        f"""WITH RECURSIVE {DELIVERED}, {_late(_expr, "epoch_us(ts)")},
        rq AS (SELECT event_id AS request_id, key, epoch_us(ts) AS us FROM lt WHERE NOT late),{_limit_walk(_window, _limit)}
        SELECT request_id, key, admitted, false AS late FROM walk JOIN nr USING (key, i)
        UNION ALL SELECT event_id, key, NULL, true FROM lt WHERE late""",
    )
    def _(spark, sf, key=_key, window=_window, limit=_limit):
        def start(events, path, checkpoint):
            requests = events.select(F.col("event_id").alias("request_id"), "ts", "user_id")
            return jobs.stream_rate_limit(requests, path, checkpoint, window, limit, key, LATE_S, part_rows=200)

        return _both(spark, _run(spark, _events(spark, sf), start), ["request_id", "key", "admitted"])


@query(
    "stream_history",
    f"""WITH RECURSIVE {DELIVERED}, {_late("user_id", "event_id")}, {P.EL.replace("FROM events", "FROM lt WHERE NOT late")},
    {WALK.replace("ev.action,", "ev.action, false AS late,")}
    UNION ALL SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END, true,
      NULL, NULL, NULL, NULL, NULL, NULL FROM lt WHERE late""",
)
def _(spark, sf):
    def start(events, path, checkpoint):
        return jobs.stream_history(corpus.as_edit_log(events), path, checkpoint, late_s=LATE_S, ttl_h=None)

    path = _run(spark, _events(spark, sf), start)
    columns = ["doc_id", "seq", "action", "status", "versions", "current", "can_undo", "can_redo", "target_operation"]
    return _both(spark, path, columns)


@query(
    "stream_annotations",
    """WITH al AS (SELECT user_id AS doc_id, (event_id % 4)::INTEGER AS page, event_id, '[' || props || ']' AS items FROM events)
    SELECT doc_id, page, coalesce(items, '[]') AS items
    FROM (SELECT DISTINCT user_id AS doc_id, p::INTEGER AS page FROM events, range(0, 6) AS t(p))
    LEFT JOIN (SELECT doc_id, page, arg_max(items, event_id) AS items FROM al GROUP BY ALL) USING (doc_id, page)""",
)
def _(spark, sf):
    def start(events, path, checkpoint):
        return jobs.stream_annotations(corpus.as_annotation_log(events), path, checkpoint, buckets=16, compact_every=2)

    path = _run(spark, _events(spark, sf), start)
    users = corpus.table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    wanted = users.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page"))
    return jobs.saved_annotations(spark, path, wanted, buckets=16)


# Documents arrive twice, the second time one delivery later; some one or two deliveries late. Their times span 10^6
# seconds, a quarter of that per delivery, and 300,000 are allowed.
@query(
    "stream_ingest",
    P.sql([P.PG, P.MF, """
    td AS (SELECT *, doc_id * 1000000 // (SELECT max(doc_id) + 1 FROM documents) AS s FROM documents),
    dl AS (SELECT *, least(3, s // 250000 + again + (doc_id % 13 = 0)::INTEGER + 2 * (doc_id % 31 = 0)::INTEGER) AS b
      FROM td, (VALUES (0), (1)) AS t(again)),
    gb AS (SELECT b, max(max(s)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM dl GROUP BY b),
    lt AS (SELECT dl.*, coalesce(s < clock - 300000, false) AS late FROM dl JOIN gb USING (b))"""], f"""
    SELECT doc_id, (SELECT count(*) FROM pg WHERE pg.doc_id = d.doc_id)::INTEGER AS page_count, false AS late,
           (length(text) + 1)::INTEGER AS character_count, len({P.words("text")})::INTEGER AS word_count
    FROM (SELECT DISTINCT doc_id, text FROM lt WHERE NOT late) d JOIN mf USING (doc_id)
    WHERE ends_with(lower(filename), '.pdf') AND n_bytes <= 50 * 1024 * 1024
    UNION ALL SELECT doc_id, NULL, true, NULL, NULL FROM lt WHERE late"""),
)
def _(spark, sf):
    documents = tune(spark).read.parquet(f"{sf}/documents.parquet")
    ids = documents.agg(F.max("doc_id") + 1).first()[0]
    at = F.expr(f"doc_id * 1000000 div {ids}")
    more = (F.col("doc_id") % 13 == 0).cast("int") + 2 * (F.col("doc_id") % 31 == 0).cast("int")
    docs = corpus.with_upload(documents).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    docs = docs.withColumn("ts", F.timestamp_seconds(at + 1_700_000_000))
    docs = docs.withColumn("b", F.least(F.lit(DELIVERIES - 1), F.floor(at / 250_000) + F.col("again") + more)).drop("again")

    def accept(batch):
        return ingest.ingest_validate(batch).where("accepted")

    def start(stream, path, checkpoint):
        return jobs.stream_ingest(stream, path, checkpoint, accept, analysis.profile, late_s=300_000)

    path = _run(spark, docs, start)
    return _both(spark, path, ["doc_id", "page_count", "character_count", "word_count"])


@query(
    "stream_expiry",
    """WITH g AS (SELECT user_id AS doc_id, max(ts) AS last FROM events GROUP BY 1)
    SELECT doc_id, epoch_us(last) // 1000 + 3600000 AS expired_at_ms FROM g
    WHERE epoch_us(last) // 1000 + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
)
def _(spark, sf):
    schema = tune(spark).read.parquet(f"{sf}/events.parquet").schema
    stream = jobs.read_folder(spark, sf, schema, glob="events.parquet")
    touches = stream.select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.stream_expiry(touches, ttl_h=1)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    jobs.write_batches(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")
