"""Queries over extracted tables and forms."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import forms, tables
from quire.plans import parts as P
from quire.plans.registry import query
from quire.plans.scans import HB
from quire.sources import corpus


def _tables(spark, sf):
    return tables.tables_from_cells(corpus.cells(spark, sf))


@query(
    "table_catalog",
    P.sql([P.CELLS, HB], """
    SELECT doc_id, page, table_index, page + 1 AS page_number, n AS row_count, len(h)::INTEGER AS col_count,
           array_to_string(h, '|') AS headers
    FROM hd JOIN (SELECT doc_id, page, table_index, count(DISTINCT r)::INTEGER AS n FROM kv GROUP BY ALL)
         USING (doc_id, page, table_index)"""),
)
def _(spark, sf):
    return tables.table_catalog(_tables(spark, sf))


KW = "kw AS (SELECT doc_id, page, table_index, r, key, arg_max(value, c) AS value FROM kv GROUP BY ALL)"


@query(
    "table_column_sum",
    P.sql([P.CELLS, HB, KW], f"""
    SELECT doc_id, header, round(total, 2) AS total, n_values, page + 1 AS page_number FROM (
      SELECT doc_id, page, table_index, i, key AS header, sum(v) AS total, count(*) AS n_values FROM (
        SELECT kw.*, i, try_cast(trim(translate(value, '{fv.CURRENCY_CHARS}', '')) AS DOUBLE) AS v
        FROM kw JOIN (SELECT doc_id, page, table_index, unnest(h) AS key, unnest(range(len(h))) AS i FROM hd)
             USING (doc_id, page, table_index, key) WHERE contains(lower(key), 'price'))
      WHERE v IS NOT NULL GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, table_index, i) = 1"""),
)
def _(spark, sf):
    return tables.table_column_sum(_tables(spark, sf), "Price")


@query(
    "table_lookup",
    P.sql([P.CELLS, HB], """
    SELECT doc_id, page + 1 AS page_number, table_index, r, row FROM (
      SELECT doc_id, page, table_index, r, string_agg(key || '=' || value, '; ' ORDER BY c) AS row,
             bool_or(contains(lower(key), 'urgent') OR contains(lower(value), 'urgent')) AS hit FROM kv GROUP BY ALL)
    WHERE hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, table_index, r) = 1"""),
)
def _(spark, sf):
    return tables.table_lookup(_tables(spark, sf), "URGENT")


FF = f"""ul AS (SELECT doc_id, page, regexp_extract_all(text, {P.lit(fv.UNDERLINE_FIELD)}, 1) AS v FROM fp),
cb AS (SELECT doc_id, page, regexp_extract_all(text, {P.lit(fv.CHECKBOX_FIELD)}, 1) AS m,
              regexp_extract_all(text, {P.lit(fv.CHECKBOX_FIELD)}, 2) AS v FROM fp),
ff AS (
  SELECT doc_id, page, 0 AS part, pos, field_name, field_type, field_value,
         CASE WHEN field_type = 'checkbox' THEN field_value = 'Yes' END AS checked FROM wi
  UNION ALL
  SELECT doc_id, page, 1, (i - 1)::INTEGER, {P.strip("v[i]")}, 'text_underline', '', NULL
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ul)
  UNION ALL
  SELECT doc_id, page, 2, (i - 1)::INTEGER, {P.strip("v[i]")}, 'checkbox_text', NULL, lower(m[i]) = 'x'
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM cb))"""


def _fields(spark, sf):
    """Combo boxes offer two segments; the names of every third page are read-only."""
    segments = F.array(F.col("field_value"), F.lit("OTHER"))
    widgets = corpus.widgets(spark, sf).withColumns(
        {
            "options": F.when(F.col("field_type") == "combobox", segments),
            "is_read_only": (F.col("field_type") == "text") & (F.col("page") % 3 == 0),
        }
    )
    return forms.form_fields(corpus.form_pages(spark, sf), widgets)


@query(
    "form_fields",
    P.sql([P.FP, P.WI, FF], """
    SELECT *, CASE WHEN field_type = 'combobox' THEN field_value || '|OTHER' END AS options,
           part = 0 AND field_type = 'text' AND page % 3 = 0 AS is_read_only, part > 0 AS detected FROM ff"""),
)
def _(spark, sf):
    return _fields(spark, sf).withColumn("options", F.array_join("options", "|"))


@query(
    "form_data",
    P.sql([P.FP, P.WI, FF], """
    SELECT doc_id, field_name, arg_max(coalesce(field_value, checked::VARCHAR, ''), page * 10000 + part * 1000 + pos) AS value
    FROM ff WHERE field_name <> '' GROUP BY ALL"""),
)
def _(spark, sf):
    return forms.form_data(_fields(spark, sf))


@query(
    "form_summary",
    P.sql([P.FP, P.WI, FF], """
    SELECT doc_id, coalesce(n, 0) AS field_count, coalesce(n, 0) > 0 AS has_forms
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ff GROUP BY 1) USING (doc_id)"""),
)
def _(spark, sf):
    return forms.form_summary(corpus.docs(spark, sf), _fields(spark, sf))


def _updates(spark, sf):
    """One update per nation's customers: some name no field."""
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, "name").when(key % 3 == 1, "active").otherwise("missing")
    return corpus.table(spark, sf, "supplier").select(
        key.alias("doc_id"), name.alias("field_name"), F.col("s_name").alias("value")
    )


UP = """up AS (SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'active' ELSE 'missing' END
  AS field_name, s_name AS value FROM supplier)"""


@query(
    "fill_forms",
    P.sql([P.WI, UP], """
    SELECT doc_id, page, pos, field_name, field_type, coalesce(value, field_value) AS field_value, value IS NOT NULL AS filled
    FROM wi LEFT JOIN up USING (doc_id, field_name)"""),
)
def _(spark, sf):
    return forms.fill_forms(corpus.widgets(spark, sf), _updates(spark, sf))


@query(
    "fill_forms_unknown",
    P.sql([P.WI, UP], """
    SELECT doc_id, field_name, value, 'Field ''' || field_name || ''' not found' AS error
    FROM up ANTI JOIN wi USING (doc_id, field_name)"""),
)
def _(spark, sf):
    return forms.unknown_fields(corpus.widgets(spark, sf), _updates(spark, sf))
