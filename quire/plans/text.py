"""Queries over scalar text operators."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import text
from quire.plans import parts as P
from quire.plans.registry import query
from quire.sources import corpus


@query(
    "doc_stats",
    P.sql(P.PG, f"""
    SELECT doc_id, count(*)::INTEGER AS page_count, (sum(length(text)) + count(*))::BIGINT AS character_count,
           sum(len({P.words("text")}))::BIGINT AS word_count
    FROM pg GROUP BY doc_id"""),
)
def _(spark, sf):
    return text.doc_stats(corpus.pages(spark, sf), "\n", trailing=True)


@query(
    "text_counts",
    f"""SELECT conv_id, turn, len({P.words("text")})::INTEGER AS words, length(text)::INTEGER AS characters,
        (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines FROM conversations""",
)
def _(spark, sf):
    return text.text_counts(corpus.table(spark, sf, "conversations")).select(
        "conv_id", "turn", "words", "characters", "lines"
    )


@query(
    "fix_grammar",
    r"""SELECT doc_id, array_to_string(list_transform(
          string_split(regexp_replace(regexp_replace(text, '  +', ' ', 'g'), '\.\s+([a-z])', '.' || chr(1) || '\1', 'g'),
                       '.' || chr(1)),
          lambda x: replace(upper(x[1:1]), 'ẞ', 'SS') || x[2:]), '. ') AS text
        FROM documents""",
)
def _(spark, sf):
    return corpus.docs(spark, sf).select("doc_id", text.fix_grammar(F.col("text")).alias("text"))


@query(
    "normalize_lines",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
          lambda x: {P.strip("x")}), lambda x: x <> ''), ' ') AS text FROM documents""",
)
def _(spark, sf):
    return corpus.docs(spark, sf).select("doc_id", text.normalize_lines(F.col("text")).alias("text"))


@query(
    "color_rgb",
    P.sql(P.SP, """
    SELECT doc_id, page, block, line, round(((color >> 16) & 255) / 255.0::DOUBLE, 6) AS r,
           round(((color >> 8) & 255) / 255.0::DOUBLE, 6) AS g, round((color & 255) / 255.0::DOUBLE, 6) AS b
    FROM sp"""),
)
def _(spark, sf):
    s = corpus.spans(spark, sf).select("doc_id", "page", "block", "line", text.color_rgb(F.col("color")).alias("c"))
    return s.select("doc_id", "page", "block", "line", *[F.round(f"c.{x}", 6).alias(x) for x in "rgb"])


def _variant_sql(names):
    r, b, i, bi = names
    return f"CASE WHEN bold AND italic THEN '{bi}' WHEN bold THEN '{b}' WHEN italic THEN '{i}' ELSE '{r}' END"


def _any_sql(hints):
    return "(" + " OR ".join(f"contains(n, '{h}')" for h in hints) + ")"


FONT_SQL = """(SELECT *, (flags & 16) <> 0 AS bold, (flags & 2) <> 0 AS italic,
    regexp_replace(font, '^[^+]*\\+', '') AS clean FROM sp)"""
FONT_CODE_SQL = (
    "CASE "
    + " ".join(f"WHEN n = '{k}' THEN '{v}'" for k, v in fv.FONT_CODES.items())
    + f" WHEN (flags & 8) <> 0 THEN {_variant_sql(fv.FONT_VARIANTS['cour'])}"
    + f" WHEN {_any_sql(fv.SERIF_HINTS)} THEN {_variant_sql(fv.FONT_VARIANTS['tiro'])}"
    + f" WHEN {_any_sql(fv.MONO_HINTS)} THEN {_variant_sql(fv.FONT_VARIANTS['cour'])}"
    + f" ELSE {_variant_sql(fv.FONT_VARIANTS['helv'])} END"
)
# spans with their font code, for the layout queries
FC = f"""fc AS (SELECT * EXCLUDE (n, clean), {FONT_CODE_SQL} AS font_code
  FROM (SELECT *, regexp_replace(lower(clean), '[\\s\\-_]+', '', 'g') AS n FROM {FONT_SQL}))"""


@query("font_code", P.sql([P.SP, FC], "SELECT doc_id, page, block, line, font, flags, font_code FROM fc"))
def _(spark, sf):
    return corpus.spans(spark, sf).select(
        "doc_id", "page", "block", "line", "font", "flags", text.font_code(F.col("font"), F.col("flags")).alias("font_code")
    )


@query(
    "font_display_name",
    P.sql(P.SP, f"""
    SELECT doc_id, page, block, line, font,
           CASE WHEN {_any_sql(fv.DISPLAY_MONO_HINTS)} THEN {_variant_sql(fv.DISPLAY_NAMES["mono"])}
                WHEN {_any_sql(fv.DISPLAY_SERIF_HINTS)} THEN {_variant_sql(fv.DISPLAY_NAMES["serif"])}
                ELSE {_variant_sql(fv.DISPLAY_NAMES["sans"])} END AS display_name
    FROM (SELECT *, lower(clean) AS n FROM {FONT_SQL})"""),
)
def _(spark, sf):
    flags = F.col("flags")
    return corpus.spans(spark, sf).select(
        "doc_id",
        "page",
        "block",
        "line",
        "font",
        text.font_display_name(F.col("font"), text.is_bold(flags), text.is_italic(flags)).alias("display_name"),
    )


STAMP = "Page {n} of {total} | {filename} | {date}"


@query(
    "stamp_text",
    P.sql([P.PG, P.MF], f"""
    SELECT doc_id, page, replace(replace(replace(replace('{STAMP}', '{{n}}', (page + 1)::VARCHAR),
           '{{total}}', page_count::VARCHAR), '{{date}}', '2024-05-01'),
           '{{filename}}', coalesce(filename, 'document.pdf')) AS stamp
    FROM pg JOIN (SELECT doc_id, count(*) AS page_count FROM pg GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, {P.strip("split_part(filename, '/', -1)")} AS filename FROM mf
               WHERE ends_with(lower(filename), '.pdf')) USING (doc_id)"""),
)
def _(spark, sf):
    from quire.operators.ingest import ingest_validate

    named = ingest_validate(corpus.manifest(spark, sf), max_mb=1 << 30).where("accepted")
    names = named.select("doc_id", F.col("safe_name").alias("filename"))
    return text.stamp_text(corpus.pages(spark, sf), names, STAMP, "2024-05-01").select("doc_id", "page", "stamp")


@query(
    "preview",
    f"""SELECT doc_id, left({P.strip("text")}, 500) AS preview_500, left(text, 5000) AS preview_5000,
        left(split_part({P.strip("text")}, chr(10), 1), 100) AS first_line FROM documents""",
)
def _(spark, sf):
    c = F.col("text")
    return corpus.docs(spark, sf).select(
        "doc_id",
        text.preview(text.strip(c), 500).alias("preview_500"),
        text.preview(c, 5000).alias("preview_5000"),
        text.first_line(c).alias("first_line"),
    )
