"""Queries over search, replacement and redaction."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import entities, search, tables
from quire.plans import parts as P
from quire.plans.registry import query
from quire.plans.scans import HB
from quire.sources import corpus

TERM = "the"


def _count(e, term):
    return f"((length({e}) - length(replace({e}, {P.lit(term)}, ''))) // {len(term)})"


@query(
    "term_counts",
    P.sql(P.PG, f"""
    SELECT doc_id, page, sum(n)::BIGINT AS occurrences FROM (
      SELECT doc_id, page, {_count("lower(text)", TERM)} AS n FROM pg) WHERE n > 0
    GROUP BY GROUPING SETS ((doc_id, page), (doc_id))"""),
)
def _(spark, sf):
    return search.term_counts(corpus.pages(spark, sf), TERM)


@query(
    "find_matches",
    P.sql(P.SP, f"""
    SELECT doc_id, page, block, line, start, round(x0 + w * start, 6) AS match_x0,
           round(x0 + w * (start + {len(TERM)}), 6) AS match_x1 FROM (
      SELECT *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {len(TERM)})::INTEGER AS start FROM (
        SELECT *, (x1 - x0) / length(text) AS w, unnest(range(1, len(parts))) AS i FROM (
          SELECT *, string_split(lower(text), '{TERM}') AS parts FROM sp)))"""),
)
def _(spark, sf):
    found = search.find_matches(corpus.spans(spark, sf), TERM)
    return found.select(
        "doc_id", "page", "block", "line", "start",
        F.round("match_x0", 6).alias("match_x0"), F.round("match_x1", 6).alias("match_x1"),
    )


@query(
    "replace_text",
    P.sql(P.SP, """
    SELECT doc_id, page + 1 AS page_number, count(*) AS replaced FROM sp WHERE contains(text, 'the') GROUP BY ALL"""),
)
def _(spark, sf):
    return search.replace_text(corpus.spans(spark, sf), "the", "THAT")


@query(
    "replaced_spans",
    P.sql(P.SP, """
    SELECT doc_id, page, block, line, contains(text, 'the') AS changed, replace(text, 'the', 'THAT') AS text FROM sp"""),
)
def _(spark, sf):
    return search.replaced_spans(corpus.spans(spark, sf), "the", "THAT").select(
        "doc_id", "page", "block", "line", "changed", "text"
    )


@query(
    "delete_text",
    P.sql(P.PG, f"""
    SELECT doc_id, page, {_count("lower(text)", "and")}::INTEGER AS deleted, regexp_replace(text, '(?i)and', '', 'g') AS text
    FROM pg"""),
)
def _(spark, sf):
    return search.delete_text(corpus.pages(spark, sf), "and").select("doc_id", "page", "deleted", "text")


def _redact_sql(kind, mask):
    # digits and separators only, so masking other characters changes no match;
    # e-mail has no word boundary and runs over the text itself
    pattern = fv.REDACT_PATTERNS[kind]
    return P.sql([P.PG, P.OP, P.EP], f"""
    SELECT doc_id, page, len({P.found("text", pattern)})::INTEGER AS redacted,
           regexp_replace(text, {P.lit(pattern)}, '{mask}', 'g') AS text FROM ep""")


for _kind, _mask in (("email", ""), ("phone", "[phone]"), ("ssn", "###"), ("date", "")):

    @query(f"redact_pattern_{_kind}", _redact_sql(_kind, _mask))
    def _(spark, sf, kind=_kind, mask=_mask):
        return search.redact_pattern(corpus.entity_pages(spark, sf), kind, mask)


def _questions(spark, sf):
    """One question per document: its own first line."""
    return corpus.docs(spark, sf).select(
        F.col("doc_id").alias("query_id"), "doc_id", F.substring_index("text", "\n", 1).alias("question")
    )


QW = f"list_distinct({P.words('lower(question)')})"


@query(
    "section_search",
    P.sql(P.BL, f"""
    SELECT query_id, doc_id, page, block, rank::INTEGER AS rank, relevance, left({P.strip("text")}, 500) AS text FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY relevance DESC, page, block) AS rank FROM (
        SELECT *, hits / len(qw)::DOUBLE AS relevance FROM (
          SELECT bl.*, q.query_id, qw, len(list_filter(qw, lambda w: contains(lower(bl.text), w))) AS hits
          FROM bl JOIN (SELECT doc_id AS query_id, doc_id, {QW} AS qw FROM
                          (SELECT doc_id, split_part(text, chr(10), 1) AS question FROM documents)) q USING (doc_id))
        WHERE hits > 0)) WHERE rank <= 20"""),
)
def _(spark, sf):
    return search.section_search(corpus.blocks(spark, sf), _questions(spark, sf))


ASK = ("what is the total amount", "which person or company of the", "where is the and", "list the data row of")


@query(
    "question_bundle",
    P.sql([P.BL, P.LN.replace("ln AS", "ln2 AS"), P.PG[len(P.LN) + 2:], P.CELLS, HB], f""",
    q AS (SELECT doc_id AS query_id, doc_id, {P.lits(ASK)}[doc_id % 4 + 1] AS question FROM documents),
    ents AS (SELECT doc_id, count(DISTINCT (entity_type, value)) AS n FROM ({P.entity_rows("pg")}) GROUP BY 1),
    tabs AS (SELECT doc_id, count(DISTINCT (page, table_index)) AS n FROM kv GROUP BY 1),
    sec AS (
      SELECT query_id, doc_id, rank, page AS section_page, left({P.strip("text")}, 500) AS section, relevance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY relevance DESC, page, block)::INTEGER AS rank
        FROM (SELECT *, hits / len(qw)::DOUBLE AS relevance FROM (
          SELECT bl.*, query_id, qw, len(list_filter(qw, lambda w: contains(lower(bl.text), w))) AS hits
          FROM bl JOIN (SELECT query_id, doc_id, {QW} AS qw FROM q) USING (doc_id)) WHERE hits > 0)) WHERE rank <= 10)
    SELECT q.query_id, q.doc_id, question, regexp_matches(question, '{fv.ASKS_ENTITIES}') AS wants_entities,
           regexp_matches(question, '{fv.ASKS_TABLES}') AS wants_tables,
           CASE WHEN regexp_matches(question, '{fv.ASKS_ENTITIES}') THEN coalesce(ents.n, 0) END AS n_entities,
           CASE WHEN regexp_matches(question, '{fv.ASKS_TABLES}') AND tabs.n > 0 THEN tabs.n END AS n_tables,
           (length(text) + 1)::INTEGER AS full_text_length, left(text || chr(10), 5000) AS context_snippet,
           rank, section_page, section, relevance
    FROM q JOIN documents USING (doc_id) LEFT JOIN ents USING (doc_id) LEFT JOIN tabs USING (doc_id)
    LEFT JOIN sec USING (query_id, doc_id)""".lstrip()),
)
def _(spark, sf):
    d = corpus.docs(spark, sf)
    q = d.select(F.col("doc_id").alias("query_id"), "doc_id", corpus._pick(ASK, F.col("doc_id") % 4).alias("question"))
    full = F.concat("text", F.lit("\n"))
    lengths = d.select("doc_id", F.length(full).alias("full_text_length"), F.substring(full, 1, 5000).alias("context_snippet"))
    ents = entities.entities(corpus.pages(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"))
    tabs = (
        tables.table_catalog(tables.tables_from_cells(corpus.cells(spark, sf)))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_tables"))
    )
    return search.question_bundle(corpus.blocks(spark, sf), q, lengths, ents, tabs)


@query(
    "question_answers",
    P.sql([P.PG, P.CELLS, HB], f""",
    q AS (SELECT doc_id, {P.lits(ASK)}[doc_id % 4 + 1] AS question FROM documents),
    ents AS (SELECT DISTINCT doc_id, entity_type, value FROM ({P.entity_rows("pg")}))
    SELECT doc_id AS query_id, doc_id, 'entity' AS kind, entity_type AS name, value FROM q JOIN ents USING (doc_id)
    WHERE regexp_matches(question, '{fv.ASKS_ENTITIES}')
    UNION ALL
    SELECT doc_id, doc_id, 'table', 'page ' || (page + 1) || ', table ' || table_index, n::VARCHAR
    FROM q JOIN (SELECT doc_id, page, table_index, count(DISTINCT r) AS n FROM kv GROUP BY ALL) USING (doc_id)
    WHERE regexp_matches(question, '{fv.ASKS_TABLES}')""".lstrip()),
)
def _(spark, sf):
    d = corpus.docs(spark, sf)
    q = d.select(F.col("doc_id").alias("query_id"), "doc_id", corpus._pick(ASK, F.col("doc_id") % 4).alias("question"))
    found = entities.entities(corpus.pages(spark, sf)).select("doc_id", "entity_type", "value")
    return search.question_answers(q, found, tables.table_catalog(tables.tables_from_cells(corpus.cells(spark, sf))))


@query(
    "validate_replacement",
    P.sql(P.SP, f""",
    ed AS (
      SELECT doc_id AS edit_id, doc_id, 0 AS page, 72 AS bx0, 72 AS by0, 192 AS bx1, 97 AS by1,
             CASE WHEN doc_id % 3 = 1 THEN 'zzz' ELSE split_part(text, ' ', 1) END AS expected FROM documents)
    SELECT edit_id, doc_id, page, expected, extracted_text, issues, issues = '' AS valid FROM (
      SELECT *, concat_ws('|', CASE WHEN NOT contains(extracted_text, expected) THEN 'replacement_text_not_found_in_region' END,
                          CASE WHEN wide THEN 'text_extends_beyond_original_bounds' END) AS issues FROM (
        SELECT edit_id, ed.doc_id, ed.page, expected,
          {P.strip("coalesce(string_agg(CASE WHEN x0 < bx1 AND x1 > bx0 AND y0 < by1 AND y1 > by0 THEN text END, chr(10) ORDER BY block, line), '')")} AS extracted_text,
          coalesce(bool_or(contains(text, expected) AND x1 > bx1 + 2), false) AS wide
        FROM ed LEFT JOIN sp ON sp.doc_id = ed.doc_id AND sp.page = ed.page GROUP BY ALL))""".lstrip()),
)
def _(spark, sf):
    edits = corpus.docs(spark, sf).select(
        F.col("doc_id").alias("edit_id"),
        "doc_id",
        F.lit(0).alias("page"),
        *[F.lit(float(v)).alias(n) for n, v in (("bx0", 72), ("by0", 72), ("bx1", 192), ("by1", 97))],
        F.when(F.col("doc_id") % 3 == 1, "zzz").otherwise(F.substring_index("text", " ", 1)).alias("expected"),
    )
    out = search.validate_replacement(corpus.spans(spark, sf), edits)
    return out.withColumn("issues", F.array_join("issues", "|"))
