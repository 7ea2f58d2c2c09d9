"""Queries over layout, regions and placement."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import layout, text
from quire.plans import parts as P
from quire.plans.registry import query
from quire.plans.text import FC, STAMP
from quire.sources import corpus

AV = f"""av AS (SELECT doc_id, coalesce(avg(CASE WHEN {P.strip("text")} <> '' THEN size END), 12)::DOUBLE AS avg_size
  FROM sp GROUP BY 1)"""
HG = f"""hg AS (
  SELECT * FROM (
    SELECT doc_id, page, block, line, span, t AS text, size, bold, x0, y0,
           CASE WHEN lg AND bold THEN 1 WHEN lg THEN 2 WHEN bold AND caps THEN 2 WHEN bold THEN 3 WHEN caps THEN 4
                ELSE 0 END AS level FROM (
      SELECT *, size >= avg_size + 2 AS lg, (flags & 16) <> 0 AS bold,
             upper(t) = t AND length(t) > 3 AND regexp_full_match(t, '\\p{{L}}+') AS caps
      FROM (SELECT *, {P.strip("text")} AS t FROM sp) JOIN av USING (doc_id) WHERE t <> ''))
  WHERE level > 0)"""


@query("avg_font_size", P.sql([P.SP, AV], "SELECT doc_id, round(avg_size, 1) AS avg_size FROM av"))
def _(spark, sf):
    return layout.avg_font_size(corpus.spans(spark, sf)).select("doc_id", F.round("avg_size", 1).alias("avg_size"))


def _upper_some(spans):
    """Every third line shouted, so that all-capitals lines occur."""
    return spans.withColumn("text", F.when(F.col("line") + F.col("block") == 2, F.upper("text")).otherwise(F.col("text")))


SU = """su AS (SELECT * REPLACE (CASE WHEN line + block = 2 THEN replace(upper(text), 'ẞ', 'SS') ELSE text END AS text) FROM sp)"""


@query(
    "headings",
    P.sql([P.SP, SU, AV.replace("FROM sp", "FROM su"), HG.replace("FROM sp", "FROM su")],
          "SELECT doc_id, page, block, line, text, level, size, bold, x0, y0 FROM hg"),
)
def _(spark, sf):
    return layout.headings(_upper_some(corpus.spans(spark, sf))).select(
        "doc_id", "page", "block", "line", "text", "level", "size", "bold", "x0", "y0"
    )


@query(
    "sections",
    P.sql([P.SP, AV, HG], "SELECT doc_id, page, block, line, span, text AS title, level, 'heading' AS origin FROM hg"),
)
def _(spark, sf):
    return layout.sections(corpus.spans(spark, sf))


def _bulleted(spans):
    """The first line of every second page's blocks as a list item."""
    mark = F.element_at(F.array(F.lit("• "), F.lit("12. "), F.lit("b) "), F.lit("- ")), F.col("block") + 1)
    listed = (F.col("page") % 2 == 1) & (F.col("line") == 0)
    return spans.withColumn("text", F.when(listed, F.concat(mark, F.col("text"))).otherwise(F.col("text")))


@query(
    "classify_blocks",
    P.sql([P.SP, """sb AS (SELECT * REPLACE (CASE WHEN page % 2 = 1 AND line = 0
             THEN ['• ', '12. ', 'b) ', '- '][block + 1] || text ELSE text END AS text) FROM sp)""",
           AV.replace("FROM sp", "FROM sb"), P.IM], f"""
    SELECT doc_id, page, block, text, font_size, bold, x0, y0, x1, y1,
           CASE WHEN font_size >= avg_size + 2 OR (bold AND length(text) < 100) THEN 'heading'
                WHEN regexp_matches(text, {P.lit(fv.LIST_ITEM)}) THEN 'list_item' ELSE 'paragraph' END AS kind
    FROM (SELECT doc_id, page, block, {P.strip("string_agg(text, '' ORDER BY line)")} AS text, max(size) AS font_size,
                 bool_or((flags & 16) <> 0) AS bold, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
          FROM sb GROUP BY ALL) JOIN av USING (doc_id) WHERE text <> ''
    UNION ALL SELECT doc_id, page, idx, NULL, NULL, NULL, x0, y0, x1, y1, 'image' FROM im"""),
)
def _(spark, sf):
    return layout.classify_blocks(_bulleted(corpus.spans(spark, sf)), corpus.images(spark, sf))


@query(
    "page_inventory",
    P.sql([P.IM, P.LK, "wp AS (SELECT page_id AS doc_id, p::INTEGER AS page FROM pages, range(0, 4) AS t(p))"], """,
    x AS (SELECT doc_id, page, coalesce(i, 0) AS image_count, coalesce(l, 0) AS link_count FROM wp
          LEFT JOIN (SELECT doc_id, page, count(*) AS i FROM im GROUP BY ALL) USING (doc_id, page)
          LEFT JOIN (SELECT doc_id, page, count(*) AS l FROM lk GROUP BY ALL) USING (doc_id, page))
    SELECT *, (sum(image_count) OVER (PARTITION BY doc_id))::BIGINT AS doc_images,
           (sum(link_count) OVER (PARTITION BY doc_id))::BIGINT AS doc_links FROM x""".lstrip()),
)
def _(spark, sf):
    web = corpus.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page"))
    return layout.page_inventory(web, corpus.images(spark, sf), corpus.links(spark, sf))


@query(
    "list_images",
    P.sql(P.IM, "SELECT *, x1 - x0 AS width, y1 - y0 AS height, count(*) OVER (PARTITION BY doc_id) AS count FROM im"),
)
def _(spark, sf):
    return layout.list_images(corpus.images(spark, sf))


def _regions(spark, sf):
    """One box per page, moving with the document."""
    d = F.col("doc_id")
    x, y = (d % 7) * 40.0 + 60.0, (d % 5) * 20.0 + 60.0
    return corpus.pages(spark, sf).select(
        F.format_string("%d/%d", d, F.col("page")).alias("region_id"), "doc_id", "page",
        x.alias("rx0"), y.alias("ry0"), (x + 200.0).alias("rx1"), (y + 30.0).alias("ry1"),
    )


RG = """rg AS (SELECT doc_id || '/' || page AS region_id, doc_id, page, ((doc_id % 7) * 40 + 60)::DOUBLE AS rx0,
  ((doc_id % 5) * 20 + 60)::DOUBLE AS ry0, ((doc_id % 7) * 40 + 260)::DOUBLE AS rx1, ((doc_id % 5) * 20 + 90)::DOUBLE AS ry1
  FROM (SELECT DISTINCT doc_id, page FROM sp))"""
HIT = f"x0 < rx1 AND x1 > rx0 AND y0 < ry1 AND y1 > ry0 AND {P.strip('text')} <> ''"


@query(
    "region_spans",
    P.sql([P.SP, RG], f"SELECT region_id, doc_id, page, block, line, text FROM rg JOIN sp USING (doc_id, page) WHERE {HIT}"),
)
def _(spark, sf):
    return layout.region_spans(corpus.spans(spark, sf), _regions(spark, sf)).select(
        "region_id", "doc_id", "page", "block", "line", "text"
    )


RT = f"""rt AS (SELECT region_id, rg.doc_id, rg.page, coalesce(t, '') AS text FROM rg LEFT JOIN (
  SELECT region_id, {P.strip("string_agg(text, chr(10) ORDER BY block, line)")} AS t
  FROM rg JOIN sp USING (doc_id, page) WHERE {HIT} GROUP BY 1) USING (region_id))"""


@query("region_text", P.sql([P.SP, RG, RT], "SELECT region_id, doc_id, page, text, text <> '' AS has_text FROM rt"))
def _(spark, sf):
    return layout.region_text(corpus.spans(spark, sf), _regions(spark, sf)).select(
        "region_id", "doc_id", "page", "text", "has_text"
    )


# anchors: a span is its own anchor unless an earlier anchor takes it; walked one span a step
GROUPS_SQL = P.sql([P.SP, P.FR], """,
    os AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block, line, span) - 1 AS i FROM fr),
    walk AS (
      SELECT doc_id, page, 0::BIGINT AS i, 0::BIGINT AS anchor, [{'i': 0::BIGINT, 'y0': y0, 'x1': x1, 'size': size}] AS an
      FROM os WHERE i = 0
      UNION ALL
      SELECT doc_id, page, i, coalesce(near.i, i),
             CASE WHEN near IS NULL THEN list_append(an, {'i': i, 'y0': y0, 'x1': x1, 'size': size}) ELSE an END
      FROM (SELECT os.doc_id, os.page, os.i, os.y0, os.x1, os.size, w.an,
                   list_filter(w.an, lambda a: abs(os.y0 - a.y0) < a.size * 0.5 AND os.x0 - a.x1 < a.size * 2)[1] AS near
            FROM walk w JOIN os ON os.doc_id = w.doc_id AND os.page = w.page AND os.i = w.i + 1))
    SELECT doc_id, page, anchor::INTEGER AS anchor, string_agg(text, ' ' ORDER BY i) AS text, min(x0) AS x0, min(y0) AS y0,
           max(x1) AS x1, max(y1) AS y1, arg_min(font, i) AS font, arg_min(size, i) AS size, arg_min(color, i) AS color
    FROM walk JOIN os USING (doc_id, page, i) GROUP BY ALL""".lstrip()).replace("WITH ", "WITH RECURSIVE ", 1)


@query("span_groups", GROUPS_SQL)
def _(spark, sf):
    return layout.span_groups(corpus.fragments(spark, sf))


@query(
    "text_width",
    P.sql([P.SP, FC, P.glyph_cte(), P.width_cte("w", "fc", "doc_id, page, block, line", "text")], """
    SELECT doc_id, page, block, line, font_code, round(coalesce(units, 0) * size, 4) AS width
    FROM fc LEFT JOIN w USING (doc_id, page, block, line, font_code)"""),
)
def _(spark, sf):
    s = corpus.spans(spark, sf).withColumn("font_code", text.font_code(F.col("font"), F.col("flags")))
    wide = layout.text_width(s, corpus.glyphs(spark, sf), "text", "size", "width")
    return wide.select("doc_id", "page", "block", "line", "font_code", F.round("width", 4).alias("width"))


def fit_sql(text_, size, old, new):
    keep = f"({text_} = '' OR {new} <= {old} * 1.05::DOUBLE)"
    floor = f"greatest({size} * 0.7::DOUBLE, 6)"
    return (
        f"CASE WHEN {keep} THEN {size} ELSE greatest({size} * {old} / {new}, {floor}) END",
        f"CASE WHEN {keep} THEN false ELSE {size} * {old} / {new} < {floor} END",
    )


_FIT = fit_sql("l_returnflag", "size", "old_width", "new_width")


@query(
    "fit_font_size",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_FIT[0]}, 6) AS adjusted_size, {_FIT[1]} AS size_warning
    FROM (SELECT *, l_quantity / 2 AS size, l_extendedprice / 1000 AS old_width, l_partkey / 10.0::DOUBLE + 1 AS new_width
          FROM lineitem)""",
)
def _(spark, sf):
    li = corpus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        (F.col("l_quantity") / 2).alias("size"), (F.col("l_extendedprice") / 1000).alias("old_width"),
        (F.col("l_partkey") / 10.0 + 1).alias("new_width"),
    )
    fitted, floored = layout.fit_font_size(F.col("l_returnflag"), F.col("size"), F.col("old_width"), F.col("new_width"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(fitted, 6).alias("adjusted_size"), floored.alias("size_warning"),
    )


def _edits(spark, sf):
    """Per document: its first word replaced, by a longer or shorter one, on all pages or one."""
    word = F.substring_index(F.substring_index("text", "\n", 1), " ", 1)
    d = F.col("doc_id")
    return corpus.docs(spark, sf).select(
        d.alias("edit_id"), "doc_id", F.when(d % 4 == 3, 0).alias("scope"), word.alias("find"),
        F.when(d % 3 == 0, F.concat(word, F.lit(" and "), word)).when(d % 3 == 1, F.lit("x")).otherwise(F.repeat(word, 12)).alias("repl"),
    ).where("find <> ''")


ED = """ed AS (SELECT doc_id AS edit_id, doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 END AS scope, w AS find,
  CASE WHEN doc_id % 3 = 0 THEN w || ' and ' || w WHEN doc_id % 3 = 1 THEN 'x' ELSE repeat(w, 12) END AS repl
  FROM (SELECT doc_id, split_part(split_part(text, chr(10), 1), ' ', 1) AS w FROM documents) WHERE w <> '')"""
_FIT = fit_sql("replacement", "size", "(x1 - x0)", "new_width")


@query(
    "replacement_plan",
    P.sql([P.SP, FC, ED, """pl AS (SELECT fc.*, edit_id, replace(text, find, repl) AS replacement FROM fc JOIN ed USING (doc_id)
             WHERE contains(text, find) AND (scope IS NULL OR scope = page))""",
           P.glyph_cte(), P.width_cte("w", "pl", "edit_id, page, block, line", "replacement")], f"""
    SELECT edit_id, doc_id, page, block, line, text AS original, replacement, font_code, size AS original_size,
           round(adj, 6) AS adjusted_size, adj <> size AS was_scaled, x0 AS insert_x,
           round(coalesce(origin_y, y1 - adj * 0.15::DOUBLE), 6) AS insert_y, size_warning,
           round(((color >> 16) & 255) / 255.0::DOUBLE, 6) AS r
    FROM (SELECT *, {_FIT[0]} AS adj, {_FIT[1]} AS size_warning FROM (
      SELECT pl.*, coalesce(units, 0) * size AS new_width FROM pl LEFT JOIN w USING (edit_id, page, block, line, font_code)))"""),
)
def _(spark, sf):
    plan = layout.replacement_plan(corpus.spans(spark, sf), _edits(spark, sf), corpus.glyphs(spark, sf))
    return plan.select(
        "edit_id", "doc_id", "page", "block", "line", "original", "replacement", "font_code", "original_size",
        F.round("adjusted_size", 6).alias("adjusted_size"), "was_scaled", "insert_x",
        F.round("insert_y", 6).alias("insert_y"), "size_warning", F.round("rgb.r", 6).alias("r"),
    )


def _box_edits(spark, sf):
    d = F.col("doc_id")
    x, y = (d % 7) * 40.0 + 60.0, (d % 5) * 20.0 + 60.0
    return corpus.docs(spark, sf).select(
        d.alias("edit_id"), "doc_id", (d % 3).cast("int").alias("page"),
        x.alias("rx0"), y.alias("ry0"), (x + 200.0).alias("rx1"), (y + 30.0).alias("ry1"),
        F.substring_index("text", "\n", 1).alias("new_text"),
        F.when(d % 4 == 1, 14.0).when(d % 4 == 2, 0.0).alias("new_size"),
        F.when(d % 5 == 2, 255).alias("new_color"),
    )


BE = """be AS (SELECT doc_id AS edit_id, doc_id, (doc_id % 3)::INTEGER AS page, ((doc_id % 7) * 40 + 60)::DOUBLE AS rx0,
  ((doc_id % 5) * 20 + 60)::DOUBLE AS ry0, ((doc_id % 7) * 40 + 260)::DOUBLE AS rx1, ((doc_id % 5) * 20 + 90)::DOUBLE AS ry1,
  split_part(text, chr(10), 1) AS new_text, CASE doc_id % 4 WHEN 1 THEN 14::DOUBLE WHEN 2 THEN 0::DOUBLE END AS new_size,
  CASE WHEN doc_id % 5 = 2 THEN 255 END AS new_color FROM documents)"""
_FIT = fit_sql("new_text", "size", "(rx1 - rx0)", "new_width")


@query(
    "edit_region",
    P.sql([P.SP, FC, BE, f"""fs AS (SELECT edit_id, arg_min({{'font_code': font_code, 'size': size, 'color': color,
             'baseline': coalesce(origin_y, y1)}}, block * 10 + line) AS st
             FROM be JOIN fc USING (doc_id, page) WHERE {HIT} GROUP BY 1)""",
           """en AS (SELECT be.*, coalesce(st.font_code, 'helv') AS font_code, st.baseline AS baseline,
             coalesce(CASE WHEN new_size <> 0 THEN new_size END, st.size, 11) AS size, coalesce(new_color, st.color, 0) AS color
             FROM be LEFT JOIN fs USING (edit_id))""",
           P.glyph_cte(), P.width_cte("w", "en", "edit_id", "new_text")], f"""
    SELECT edit_id, doc_id, page, font_code, size, color, round(adj, 6) AS adjusted_size, size_warning, rx0 AS insert_x,
           round(coalesce(baseline, ry1 - adj * 0.15::DOUBLE), 6) AS insert_y,
           CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = z.doc_id AND sp.page = z.page) THEN 'ok' ELSE 'invalid_page' END AS status
    FROM (SELECT *, {_FIT[0]} AS adj, {_FIT[1]} AS size_warning FROM (
      SELECT en.*, coalesce(units, 0) * size AS new_width FROM en LEFT JOIN w USING (edit_id, font_code))) z"""),
)
def _(spark, sf):
    out = layout.edit_region(corpus.spans(spark, sf), corpus.pages(spark, sf), _box_edits(spark, sf), corpus.glyphs(spark, sf))
    return out.select(
        "edit_id", "doc_id", "page", "font_code", "size", "color", F.round("adjusted_size", 6).alias("adjusted_size"),
        "size_warning", "insert_x", F.round("insert_y", 6).alias("insert_y"), "status",
    )


@query(
    "move_spans",
    P.sql([P.SP, FC, BE], f""",
    mv AS (SELECT edit_id AS move_id, doc_id, page, rx0, ry0, rx1, ry1, rx0 + 30 AS nx0, ry0 + 50 AS ny0,
                  rx1 + 30 + doc_id % 200 AS nx1, ry1 + 50 + (doc_id % 9) * 20 AS ny1 FROM be)
    SELECT move_id, mv.doc_id, mv.page, block, line, text, font_code,
           CASE WHEN block IS NULL THEN 'nothing' ELSE 'text' END AS status,
           round(nx0 + (x0 - rx0) / (rx1 - rx0) * (nx1 - nx0), 6) AS new_x, round(nsize, 6) AS new_size,
           round(ny0 + (y0 - ry0) / (ry1 - ry0) * (ny1 - ny0) + nsize, 6) AS new_y
    FROM (SELECT *, CASE WHEN block IS NOT NULL THEN
                 least(greatest(size * least((nx1 - nx0) / (rx1 - rx0), (ny1 - ny0) / (ry1 - ry0)), 4), 72) END AS nsize
          FROM mv LEFT JOIN (SELECT doc_id AS d2, page AS p2, * EXCLUDE (doc_id, page) FROM fc) f
          ON d2 = doc_id AND p2 = page AND {HIT}) mv""".lstrip()),
)
def _(spark, sf):
    d = F.col("doc_id")
    moves = _box_edits(spark, sf).select(
        F.col("edit_id").alias("move_id"), "doc_id", "page", "rx0", "ry0", "rx1", "ry1",
        (F.col("rx0") + 30).alias("nx0"), (F.col("ry0") + 50).alias("ny0"),
        (F.col("rx1") + 30 + d % 200).alias("nx1"), (F.col("ry1") + 50 + (d % 9) * 20).alias("ny1"),
    )
    out = layout.move_spans(corpus.spans(spark, sf), moves)
    return out.select(
        "move_id", "doc_id", "page", "block", "line", "text", "font_code", "status",
        F.round("new_x", 6).alias("new_x"), F.round("new_size", 6).alias("new_size"), F.round("new_y", 6).alias("new_y"),
    )


@query(
    "add_spans",
    P.sql(P.SP, """
    SELECT doc_id, page, block, line, text, size, color, origin_x, origin_y FROM sp
    UNION ALL
    SELECT doc_id, (doc_id % 3)::INTEGER, -1, 0, lang, s, CASE WHEN doc_id % 2 = 0 THEN 255 ELSE 0 END, 100, 200 + s
    FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 14 ELSE 12 END::DOUBLE AS s FROM documents) d
    WHERE EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = d.doc_id AND sp.page = d.doc_id % 3)"""),
)
def _(spark, sf):
    d = F.col("doc_id")
    additions = corpus.table(spark, sf, "documents").select(
        d.alias("add_id"), "doc_id", (d % 3).cast("int").alias("page"), F.lit(100.0).alias("x"), F.lit(200.0).alias("y"),
        F.col("lang").alias("text"), F.when(d % 4 == 0, 14.0).alias("font_size"), F.when(d % 2 == 0, 255).alias("color"),
    )
    out = layout.add_spans(corpus.spans(spark, sf), corpus.pages(spark, sf), additions)
    return out.select("doc_id", "page", "block", "line", "text", "size", "color", "origin_x", "origin_y")


@query(
    "stamp_layout",
    P.sql([P.PG, f"""st AS (SELECT doc_id, page, width, height, 'helv' AS font_code,
             replace(replace(replace(replace('{STAMP}', '{{n}}', (page + 1)::VARCHAR), '{{total}}', page_count::VARCHAR),
             '{{date}}', '2024-05-01'), '{{filename}}', 'document.pdf') AS stamp
             FROM pg JOIN (SELECT doc_id, count(*) AS page_count FROM pg GROUP BY 1) USING (doc_id))""",
           P.glyph_cte(), P.width_cte("w", "st", "doc_id, page", "stamp")], """
    SELECT doc_id, page, stamp, round(width - 36 - coalesce(units, 0) * 9, 6) AS x, 45::DOUBLE AS y
    FROM st LEFT JOIN w USING (doc_id, page)"""),
)
def _(spark, sf):
    out = layout.stamp_layout(
        corpus.pages(spark, sf), None, corpus.glyphs(spark, sf), STAMP, "top-right", 9.0, as_of="2024-05-01"
    )
    return out.select("doc_id", "page", "stamp", F.round("x", 6).alias("x"), "y")


@query(
    "watermark_layout",
    P.sql([P.PG, P.glyph_cte(), """wm AS (SELECT sum(unit_width) * 60 AS tw FROM (
             SELECT unnest(string_split('CONFIDENTIAL', '')) AS ch) JOIN gl USING (ch) WHERE font_code = 'helv')"""], """
    SELECT doc_id, page, round(306 - tw / 2 * cos(radians(-45)), 6) AS x, round(396 - tw / 2 * sin(radians(-45)) + 30, 6) AS y,
           0.3::DOUBLE AS opacity FROM pg, wm"""),
)
def _(spark, sf):
    out = layout.watermark_layout(corpus.pages(spark, sf), corpus.glyphs(spark, sf))
    return out.select("doc_id", "page", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "opacity")
