"""Queries over whole documents: the full analysis and batches of operations."""

from quire import fixed_values as fv
from quire.operators import analysis, batch
from quire.plans import parts as P
from quire.plans.intelligence import TW, language_ctes, summary_sql
from quire.plans.layout import AV, HG
from quire.plans.registry import query
from quire.plans.scans import HB
from quire.sources import corpus

FIELDS_SQL = f"""SELECT doc_id, sum(len(regexp_extract_all(text, {P.lit(fv.UNDERLINE_FIELD)}))
    + len(regexp_extract_all(text, {P.lit(fv.CHECKBOX_FIELD)})))::INTEGER AS n FROM pg GROUP BY 1"""


@query(
    "full_analysis",
    P.sql([P.PG, P.SP[len(P.LN) + 2:], AV, HG, TW, language_ctes("documents"), P.CELLS, HB], f"""
    SELECT d.doc_id, pc AS page_count, (length(text) + 1)::INTEGER AS character_count, len({P.words("text")})::INTEGER AS word_count,
           summary, coalesce(en.n, 0)::INTEGER AS entity_count, ff.n AS form_field_count, language, confidence, top_topic,
           round(avg_size, 1) AS avg_size, coalesce(hc.n, 0) AS heading_count, coalesce(tb.n, 0) AS table_count
    FROM documents d JOIN (SELECT doc_id, count(*)::INTEGER AS pc FROM pg GROUP BY 1) USING (doc_id)
    JOIN ({summary_sql("text", "analysis")}) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(DISTINCT (entity_type, value)) AS n FROM ({P.entity_rows("pg")}) GROUP BY 1) en USING (doc_id)
    JOIN ({FIELDS_SQL}) ff USING (doc_id) JOIN lg USING (doc_id)
    LEFT JOIN (SELECT doc_id, word AS top_topic FROM tw
               QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first_pos) = 1) USING (doc_id)
    JOIN av USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM hg GROUP BY 1) hc USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(DISTINCT (page, table_index)) AS n FROM kv GROUP BY 1) tb USING (doc_id)"""),
)
def _(spark, sf):
    return analysis.full_analysis(corpus.docs(spark, sf), corpus.spans(spark, sf), corpus.cells(spark, sf))


OPS = [
    {"type": "replace", "find": "the", "replace": "THAT"},
    {"type": "replace", "find": "THAT", "replace": "x", "page": 0},
    {"type": "redact_pattern", "kind": "email", "mask": "[mail]"},
    {"type": "extract_data", "kind": "emails"},
    {"type": "delete_text", "text": "and"},
    {"type": "search_text", "query": "and"},
    {"type": "flatten"},
    {"type": "redact_pattern", "kind": "iban"},
    {"type": "stamp", "text": "{n}/{total}", "position": "top-left", "pages": [0, 2]},
    {"type": "watermark", "size": 30, "rotation": 0},
    {"type": "get_page_count"},
    {"type": "get_word_count"},
]


@query(
    "batch_operations",
    P.sql([P.PG, P.SP[len(P.LN) + 2:],
           "s1 AS (SELECT page, replace(text, 'the', 'THAT') AS text FROM sp)",
           f"p1 AS (SELECT text, regexp_replace(text, {P.lit(fv.EMAIL)}, '[mail]', 'g') AS t FROM pg)",
           "p2 AS (SELECT t, regexp_replace(t, '(?i)and', '', 'g') AS u FROM p1)"], f"""
    SELECT *, NULL::VARCHAR AS reason FROM (
      SELECT 0 AS step, 'replace' AS type, 'ok' AS status, count(*) AS n FROM sp WHERE contains(text, 'the')
      UNION ALL SELECT 1, 'replace', 'ok', count(*) FROM s1 WHERE contains(text, 'THAT') AND page = 0
      UNION ALL SELECT 2, 'redact_pattern', 'ok', sum(len(regexp_extract_all(text, {P.lit(fv.EMAIL)})))::BIGINT FROM pg
      UNION ALL SELECT 3, 'extract_data', 'ok', 0
      UNION ALL SELECT 4, 'delete_text', 'ok', sum((length(t) - length(u)) // 3)::BIGINT FROM p2
      UNION ALL SELECT 5, 'search_text', 'ok', coalesce(sum(len(regexp_extract_all(lower(u), 'and'))), 0)::BIGINT FROM p2
      UNION ALL SELECT 8, 'stamp', 'ok', count(*) FROM pg WHERE page IN (0, 2) UNION ALL SELECT 9, 'watermark', 'ok', count(*) FROM pg
      UNION ALL SELECT 10, 'get_page_count', 'ok', count(*) FROM pg
      UNION ALL SELECT 11, 'get_word_count', 'ok', sum(len({P.words("u")}))::BIGINT FROM p2)
    UNION ALL SELECT 6, 'flatten', 'skipped', 0, 'unknown operation type: flatten'
    UNION ALL SELECT 7, 'redact_pattern', 'error', 0, 'ValueError: unknown pattern type: iban'"""),
)
def _(spark, sf):
    tables = {"pages": corpus.pages(spark, sf), "spans": corpus.spans(spark, sf), "glyphs": corpus.glyphs(spark, sf)}
    return batch.batch_operations(tables, OPS)[1]


