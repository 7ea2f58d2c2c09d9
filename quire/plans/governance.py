"""Queries over annotations, history, rates, expiry and conversations."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import history, rates
from quire.plans import parts as P
from quire.plans.registry import query
from quire.sources import corpus


@query(
    "annotations_latest",
    """WITH al AS (SELECT user_id AS doc_id, (event_id % 4)::INTEGER AS page, ts, event_id, '[' || props || ']' AS items FROM events)
    SELECT doc_id, page, coalesce(items, '[]') AS items
    FROM (SELECT DISTINCT user_id AS doc_id, p::INTEGER AS page FROM events, range(0, 6) AS t(p))
    LEFT JOIN (SELECT doc_id, page, arg_max(items, event_id) AS items FROM al GROUP BY ALL) USING (doc_id, page)""",
)
def _(spark, sf):
    log = corpus.annotation_log(spark, sf)
    wanted = log.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page"))
    return history.annotations_latest(log, wanted)


@query(
    "annotation_items",
    """SELECT event_id AS request_id, 'highlight' AS kind, i::INTEGER AS idx, value + i AS a, value + i + 10 AS b, 4 AS n,
           CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS r, CASE WHEN event_id % 3 = 1 THEN 0.8 ELSE 0.35 END::DOUBLE AS weight
    FROM events, range(0, 3) AS t(i) WHERE event_type NOT IN ('view', 'signup') AND i < event_id % 4
    UNION ALL
    SELECT event_id, 'ink', i::INTEGER, value, value + n - 1, n::INTEGER, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::DOUBLE,
           CASE WHEN event_id % 5 = 0 THEN 4 ELSE 2 END::DOUBLE
    FROM (SELECT *, CASE i WHEN 0 THEN event_id % 4 ELSE event_id % 5 END AS n FROM events, range(0, 2) AS t(i)
          WHERE event_type IN ('view', 'signup')) WHERE n >= 2""",
)
def _(spark, sf):
    items = history.annotation_items(corpus.highlight_requests(spark, sf), corpus.ink_requests(spark, sf))
    ink = F.col("kind") == "ink"
    return items.select(
        "request_id",
        "kind",
        "idx",
        F.when(ink, F.col("points")[0][0]).otherwise(F.col("rect")[0]).alias("a"),
        F.when(ink, F.element_at("points", -1)[0]).otherwise(F.col("rect")[2]).alias("b"),
        F.when(ink, F.size("points")).otherwise(F.size("rect")).alias("n"),
        F.col("color")[0].alias("r"),
        F.coalesce("opacity", "width").alias("weight"),
    )


def _edits(spark, sf):
    return corpus.edit_log(spark, sf).where("action = 'edit'")


RET = "rt AS (SELECT * FROM el WHERE action = 'edit' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) <= 20)"


@query("history_retention", P.sql([P.EL, RET], "SELECT doc_id, seq, operation FROM rt"))
def _(spark, sf):
    return history.history_retention(_edits(spark, sf)).select("doc_id", "seq", "operation")


@query(
    "history_versions",
    P.sql([P.EL, RET], """
    SELECT doc_id, seq, operation, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved,
           (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1)::INTEGER AS index,
           row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1 AS is_current FROM rt"""),
)
def _(spark, sf):
    return history.history_versions(_edits(spark, sf)).select(
        "doc_id", "seq", "operation", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("saved"), "index", "is_current"
    )


# one event a step; st holds the versions, d how many of them are in effect
WALK = f"""
    ev AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM el),
    walk AS (
      SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS st, 0::BIGINT AS d, true AS ok, NULL::BIGINT AS target
      FROM (SELECT DISTINCT doc_id FROM el)
      UNION ALL
      SELECT doc_id, i, st, CASE WHEN action = 'edit' THEN len(st) ELSE d END, ok, target FROM (
        SELECT ev.doc_id, ev.i, action,
          CASE WHEN action <> 'edit' THEN w.st
               WHEN w.d = {fv.HISTORY_DEPTH} THEN list_append(w.st[2:], ev.seq) ELSE list_append(w.st[1:w.d], ev.seq) END AS st,
          CASE WHEN action = 'undo' AND w.d > 0 THEN w.d - 1 WHEN action = 'redo' AND w.d < len(w.st) THEN w.d + 1 ELSE w.d END AS d,
          CASE action WHEN 'undo' THEN w.d > 0 WHEN 'redo' THEN w.d < len(w.st) ELSE true END AS ok,
          CASE WHEN action = 'undo' AND w.d > 0 THEN w.st[w.d]
               WHEN action = 'redo' AND w.d < len(w.st) THEN CASE WHEN w.d + 2 <= len(w.st) THEN w.st[w.d + 2] ELSE -1 END END AS target
        FROM walk w JOIN ev ON ev.doc_id = w.doc_id AND ev.i = w.i + 1))
    SELECT ev.doc_id, ev.seq, ev.action, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status,
           (len(st) + CASE WHEN d < len(st) THEN 1 ELSE 0 END)::INTEGER AS versions, (d - 1)::INTEGER AS current,
           d > 0 AS can_undo, d < len(st) AS can_redo,
           CASE WHEN target = -1 THEN '{fv.UNDO_MARKER}' ELSE o.operation END AS target_operation
    FROM walk JOIN ev USING (doc_id, i) LEFT JOIN el o ON o.doc_id = ev.doc_id AND o.seq = target"""
REPLAY = f"WITH RECURSIVE {P.EL}, {WALK}"


@query("history_replay", REPLAY)
def _(spark, sf):
    # small chunks, so that most documents go through several
    return history.history_replay(corpus.edit_log(spark, sf), chunk=40)


def _limit_walk(window_s, limit):
    """One request of rq (request_id, key, us) a step; live holds the admitted times of the window."""
    width = window_s * 1_000_000
    return f"""
    nr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, request_id) AS i FROM rq),
    walk AS (
      SELECT key, 0::BIGINT AS i, []::BIGINT[] AS live, false AS admitted FROM (SELECT DISTINCT key FROM nr)
      UNION ALL
      SELECT key, i, CASE WHEN len(kept) < {limit} THEN list_append(kept, us) ELSE kept END, len(kept) < {limit}
      FROM (SELECT nr.key, nr.i, nr.us, list_filter(w.live, lambda t: t >= nr.us - {width}) AS kept
            FROM walk w JOIN nr ON nr.key = w.key AND nr.i = w.i + 1))"""


def _limit_sql(key, window_s, limit):
    return f"""WITH RECURSIVE
    rq AS (SELECT event_id AS request_id, {key} AS key, epoch_us(ts) AS us FROM events),{_limit_walk(window_s, limit)}
    SELECT request_id, key, admitted FROM walk JOIN nr USING (key, i)"""


@query("rate_limit", _limit_sql("user_id::VARCHAR", 86400, 2))
def _(spark, sf):
    return rates.rate_limit(corpus.requests(spark, sf), 86400, 2, "user_id", part_rows=40)


@query("rate_limit_global", _limit_sql("'all'", 3600, 10))
def _(spark, sf):
    return rates.rate_limit(corpus.requests(spark, sf), 3600, 10, part_rows=200)


for _key, _col, _expr, _w in (("request_rate", None, "'all'", 3600), ("request_rate_keyed", "user_id", "user_id::VARCHAR", 86400)):

    @query(
        _key,
        f"""SELECT request_id, key, us, (count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN {_w * 1_000_000} PRECEDING
               AND CURRENT ROW))::BIGINT AS load
        FROM (SELECT event_id AS request_id, {_expr} AS key, epoch_us(ts) AS us FROM events)""",
    )
    def _(spark, sf, col=_col, w=_w):
        return rates.request_rate(corpus.requests(spark, sf), w, col)


@query(
    "expire_documents",
    """SELECT o_orderkey AS doc_id, o_custkey FROM orders WHERE NOT o_orderdate < TIMESTAMP '1998-06-01 12:00:00' - INTERVAL 8760 HOUR""",
)
def _(spark, sf):
    docs = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("mtime")
    )
    return history.expire_documents(docs, "1998-06-01 12:00:00", 8760).select("doc_id", "o_custkey")


@query(
    "recent_turns",
    """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
       FROM conversations) WHERE rn <= 4 AND role IN ('user', 'assistant')""",
)
def _(spark, sf):
    return history.recent_turns(corpus.table(spark, sf, "conversations"), 4)
