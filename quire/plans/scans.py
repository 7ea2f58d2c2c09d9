"""Queries over scans, document views and sinks."""

import uuid

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import analysis, ingest, tables
from quire.plans import parts as P
from quire.plans.registry import query
from quire.session import shared_dir
from quire.sources import corpus
from quire.sources.store import read_if_there


@query(
    "ingest_validate",
    P.sql(P.MF, f"""
    SELECT doc_id, filename, n_bytes, reason, reason IS NULL AS accepted,
           {P.strip("split_part(filename, '/', -1)")} AS safe_name
    FROM (SELECT *, CASE WHEN NOT ends_with(lower(filename), '.pdf') THEN 'wrong_type'
                         WHEN n_bytes > 50 * 1024 * 1024 THEN 'too_large' END AS reason FROM mf)"""),
)
def _(spark, sf):
    return ingest.ingest_validate(corpus.manifest(spark, sf))


_UUID_SQL = """CASE WHEN doc_id % 3 = 1 THEN upper(u) WHEN doc_id % 5 = 2 THEN u || 'f' ELSE u END"""


@query(
    "doc_id_valid",
    f"""
    SELECT doc_id, id FROM (
      SELECT doc_id, {_UUID_SQL} AS id FROM (
        SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u
        FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)))
    WHERE regexp_full_match(id, '{fv.DOC_ID_PATTERN}')""",
)
def _(spark, sf):
    h = F.md5(F.col("doc_id").cast("string"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    d = F.col("doc_id")
    ids = corpus.docs(spark, sf).select(
        "doc_id",
        F.when(d % 3 == 1, F.upper(u)).when(d % 5 == 2, F.concat(u, F.lit("f"))).otherwise(u).alias("id"),
    )
    return ingest.valid_doc_ids(ids, "id")


@query(
    "doc_info",
    P.sql(P.PG, """
    SELECT pg.doc_id, page AS index, width, height, rotation, page_count, lang, source
    FROM pg JOIN (SELECT doc_id, count(*)::INTEGER AS page_count FROM pg GROUP BY 1) USING (doc_id)
    JOIN documents USING (doc_id)"""),
)
def _(spark, sf):
    meta = corpus.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return ingest.doc_info(meta, corpus.pages(spark, sf))


@query(
    "text_spans",
    P.sql(P.SP, f"""
    SELECT doc_id, page, block, line, text, font, size, color, flags, x0, y0, x1, y1
    FROM sp WHERE {P.strip("text")} <> ''"""),
)
def _(spark, sf):
    return ingest.text_spans(corpus.spans(spark, sf)).select(
        "doc_id", "page", "block", "line", "text", "font", "size", "color", "flags", "x0", "y0", "x1", "y1"
    )


@query(
    "doc_text",
    P.sql(P.PG, """
    SELECT doc_id, string_agg(text, chr(10) ORDER BY page) || chr(10) AS text FROM pg GROUP BY doc_id"""),
)
def _(spark, sf):
    return ingest.doc_text(corpus.pages(spark, sf), "\n", trailing=True)


@query(
    "page_lookup",
    P.sql(P.PG, f"""
    SELECT d.doc_id, (d.doc_id % 4)::INTEGER AS page, pg.text,
           CASE WHEN pg.text IS NULL THEN 'out_of_range' WHEN {P.strip("pg.text")} = '' THEN 'no_text'
                ELSE 'ok' END AS status
    FROM documents d LEFT JOIN pg ON pg.doc_id = d.doc_id AND pg.page = d.doc_id % 4"""),
)
def _(spark, sf):
    refs = corpus.docs(spark, sf).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("page"))
    return ingest.page_lookup(corpus.pages(spark, sf), refs)


# Header and body rows side by side; later queries on tables reuse these parts.
HB = """hd AS (
  SELECT doc_id, page, table_index, list(CASE WHEN coalesce(cell, '') = '' THEN 'col_' || c ELSE cell END ORDER BY c) AS h
  FROM cl WHERE r = 0 GROUP BY ALL),
kv AS (
  SELECT cl.doc_id, cl.page, cl.table_index, r, c, CASE WHEN c < len(h) THEN h[c + 1] ELSE 'col_' || c END AS key,
         coalesce(cell, '') AS value
  FROM cl JOIN hd USING (doc_id, page, table_index) WHERE r > 0)"""


@query(
    "tables_from_cells",
    P.sql([P.CELLS, HB], """
    SELECT doc_id, page, table_index, r, key, arg_max(value, c) AS value FROM kv GROUP BY ALL"""),
)
def _(spark, sf):
    return tables.table_values(tables.tables_from_cells(corpus.cells(spark, sf)))


@query(
    "tables_csv",
    P.sql([P.CELLS, HB], """,
    vals AS (SELECT doc_id, page, table_index, r, key, arg_max(value, c) AS value FROM kv GROUP BY ALL),
    rws AS (SELECT DISTINCT doc_id, page, table_index, r FROM kv),
    body AS (
      SELECT rws.doc_id, rws.page, rws.table_index, rws.r,
             string_agg('"' || coalesce(value, '') || '"', ',' ORDER BY i) AS line
      FROM rws JOIN (SELECT doc_id, page, table_index, unnest(h) AS key, unnest(range(len(h))) AS i FROM hd)
             USING (doc_id, page, table_index)
           LEFT JOIN vals USING (doc_id, page, table_index, r, key) GROUP BY ALL)
    SELECT doc_id, page, table_index, -1 AS r, '# Table on page ' || (page + 1) || ' (index ' || table_index || ')' AS line
    FROM hd SEMI JOIN rws USING (doc_id, page, table_index)
    UNION ALL
    SELECT doc_id, page, table_index, 0, '"' || array_to_string(h, '","') || '"' FROM hd
    SEMI JOIN rws USING (doc_id, page, table_index)
    UNION ALL SELECT * FROM body""".lstrip()),
)
def _(spark, sf):
    return tables.tables_csv(tables.tables_from_cells(corpus.cells(spark, sf)))


@query(
    "analysis_incremental",
    """SELECT doc_id, n_chars, sha256(text) AS content_hash FROM documents ANTI JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    stored = corpus.table(spark, sf, "labels").select("doc_id")
    todo = ingest.pending(corpus.table(spark, sf, "documents"), stored)
    return todo.select("doc_id", "n_chars", ingest.content_hash(F.col("text")).alias("content_hash"))


# The corpus is analysed, then changes: some texts grow, some documents go. What is stored after the second run and a
# compaction is compared; run tells which rows were made by which run.
@query(
    "analysis_stored",
    f"""SELECT doc_id, run, (length(t) + 1)::INTEGER AS character_count, len({P.words("t")})::INTEGER AS word_count, sha256(t) AS content_hash,
           false AS stale_files
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' More words.' ELSE text END AS t,
                 CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS run FROM documents WHERE doc_id % 7 <> 2)""",
)
def _(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    longer = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" More words."))).otherwise(F.col("text"))
    changed = docs.withColumn("text", longer).where("doc_id % 7 <> 2")
    path = f"{shared_dir(spark)}/analyses-{uuid.uuid4()}"
    for run, now in ((1, docs), (2, changed)):
        ingest.refresh(now, path, lambda d, run=run: analysis.profile(d, ("content_hash",)).withColumn("run", F.lit(run)), buckets=16)
    store = ingest.analyses(spark, path, buckets=16)
    store.compact()
    kept = read_if_there(spark, f"{path}/data").select("doc_id", "content_hash", F.lit(True).alias("_file"))
    now = store.read().join(kept, ["doc_id", "content_hash"], "full")
    return now.select(
        "doc_id", "run", "character_count", "word_count", "content_hash", F.col("run").isNull().alias("stale_files")
    )


@query(
    "delete_documents",
    P.sql(P.PG, """SELECT doc_id, page, text FROM pg ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)"""),
)
def _(spark, sf):
    gone = corpus.table(spark, sf, "labels").where("toxic = 1")
    return ingest.delete_documents(corpus.pages(spark, sf), gone).select("doc_id", "page", "text")
