"""Queries over page-set operations."""

from pyspark.sql import functions as F

from quire.operators import pageset
from quire.plans import parts as P
from quire.plans.registry import query
from quire.sources import corpus

PC = "pc AS (SELECT doc_id, count(*)::INTEGER AS n FROM pg GROUP BY 1)"


def _rotations(spark, sf):
    d = F.col("doc_id")
    return corpus.docs(spark, sf).select(
        "doc_id", (d % 3).cast("int").alias("page"), F.when(d % 2 == 0, 180).alias("new_rotation")
    )


@query(
    "rotate_pages",
    P.sql(P.PG, """
    SELECT doc_id, page, CASE WHEN page <> doc_id % 3 THEN rotation WHEN doc_id % 2 = 0 THEN 180
           ELSE (rotation + 90) % 360 END AS rotation FROM pg"""),
)
def _(spark, sf):
    return pageset.rotate_pages(corpus.pages(spark, sf), _rotations(spark, sf)).select("doc_id", "page", "rotation")


@query(
    "rotate_pages_invalid",
    P.sql(P.PG, """
    SELECT doc_id, (doc_id % 3)::INTEGER AS page, CASE WHEN doc_id % 2 = 0 THEN 180 END AS new_rotation FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_id = d.doc_id AND pg.page = d.doc_id % 3)"""),
)
def _(spark, sf):
    return pageset.invalid_pages(corpus.pages(spark, sf), _rotations(spark, sf))


def _ranges(spark, sf):
    d = F.col("doc_id")
    return corpus.docs(spark, sf).select(
        "doc_id", (d % 3 - (d % 17 == 5).cast("int")).cast("int").alias("start"), (d % 3 + d % 2).cast("int").alias("end")
    )


RNG = """dr AS (SELECT doc_id, (doc_id % 3 - (doc_id % 17 = 5)::INTEGER)::INTEGER AS s, (doc_id % 3 + doc_id % 2)::INTEGER AS e
  FROM documents)"""


@query(
    "delete_pages",
    P.sql([P.PG, PC, RNG], """,
    ok AS (SELECT doc_id, s, e FROM dr JOIN pc USING (doc_id) WHERE s >= 0 AND e < n AND s <= e AND e - s + 1 < n)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1)::INTEGER AS page, text
    FROM pg LEFT JOIN ok USING (doc_id) WHERE s IS NULL OR page NOT BETWEEN s AND e""".lstrip()),
)
def _(spark, sf):
    return pageset.delete_pages(corpus.pages(spark, sf), _ranges(spark, sf)).select("doc_id", "page", "text")


@query(
    "delete_pages_status",
    P.sql([P.PG, PC, RNG], """
    SELECT doc_id, s AS start, e AS "end", n AS page_count, CASE WHEN s < 0 OR e >= n OR s > e THEN 'invalid_range'
           WHEN e - s + 1 >= n THEN 'would_delete_all' ELSE 'ok' END AS status FROM dr JOIN pc USING (doc_id)"""),
)
def _(spark, sf):
    return pageset.deletion_status(corpus.pages(spark, sf), _ranges(spark, sf))


def _orders(spark, sf):
    """Reversed page order per document; every seventh order repeats a page."""
    pages_in = F.floor((F.size(F.split("text", "\n", -1)) + 7) / 8).cast("int")
    back = F.transform(F.sequence(F.lit(0), pages_in - 1), lambda i: pages_in - 1 - i)
    return corpus.docs(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(back, F.array(F.lit(0)))).otherwise(back).alias("page_order")
    )


@query(
    "reorder_pages",
    P.sql([P.PG, PC], """
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN page ELSE n - 1 - page END AS page, text FROM pg JOIN pc USING (doc_id)"""),
)
def _(spark, sf):
    return pageset.reorder_pages(corpus.pages(spark, sf), _orders(spark, sf)).select("doc_id", "page", "text")


@query(
    "move_page",
    P.sql([P.PG, PC], """,
    m AS (SELECT doc_id, doc_id % 4 AS src, (doc_id // 4) % 4 AS dst FROM documents)
    SELECT doc_id, (CASE WHEN NOT (src < n AND dst < n) THEN page ELSE
             (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page = src THEN dst + (CASE WHEN src < dst THEN 0.5 ELSE -0.5 END)
              ELSE page END) - 1) END)::INTEGER AS page, text
    FROM pg JOIN pc USING (doc_id) JOIN m USING (doc_id)""".lstrip()),
)
def _(spark, sf):
    d = F.col("doc_id")
    moves = corpus.docs(spark, sf).select(
        "doc_id", (d % 4).cast("int").alias("src"), (F.floor(d / 4) % 4).cast("int").alias("dst")
    )
    return pageset.move_page(corpus.pages(spark, sf), moves).select("doc_id", "page", "text")


def _split_ranges(spark, sf):
    return corpus.docs(spark, sf).select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
                F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")),
                F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")),
            )
        ).alias("r"),
    ).select("doc_id", "r.start", "r.end")


SR = "sr AS (SELECT doc_id, s, e FROM documents, (VALUES (0, 0), (1, 2), (0, 3)) AS t(s, e))"


@query(
    "split_documents",
    P.sql([P.PG, PC, SR], """
    SELECT md5(doc_id || ':' || s || ':' || e) AS new_doc_id, doc_id AS source_doc_id, (page - s)::INTEGER AS page, text
    FROM sr JOIN pc USING (doc_id) JOIN pg USING (doc_id) WHERE e < n AND page BETWEEN s AND e"""),
)
def _(spark, sf):
    return pageset.split_documents(corpus.pages(spark, sf), _split_ranges(spark, sf)).select(
        "new_doc_id", "source_doc_id", "page", "text"
    )


@query(
    "split_documents_status",
    P.sql([P.PG, PC, SR], """
    SELECT doc_id, s AS start, e AS "end", n AS page_count, CASE WHEN e >= n THEN 'invalid_range' ELSE 'ok' END AS status
    FROM sr JOIN pc USING (doc_id)"""),
)
def _(spark, sf):
    return pageset.split_status(corpus.pages(spark, sf), _split_ranges(spark, sf))


@query(
    "merge_documents",
    P.sql([P.PG, PC], """,
    pt AS (SELECT doc_id AS merged_id, u.seq, CASE u.seq WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 WHEN 2 THEN doc_id * 2 ELSE doc_id END
             AS doc_id FROM documents, range(0, 4) AS u(seq))
    SELECT merged_id, pg.doc_id AS source_doc_id,
           (row_number() OVER (PARTITION BY merged_id ORDER BY seq, page) - 1)::INTEGER AS page, text
    FROM pt JOIN pg USING (doc_id)""".lstrip()),
)
def _(spark, sf):
    d = F.col("doc_id")
    plans = corpus.docs(spark, sf).select("doc_id", F.array(d + 1, d * 2, d).alias("doc_ids"))
    return pageset.merge_documents(corpus.pages(spark, sf), plans).select("merged_id", "source_doc_id", "page", "text")
