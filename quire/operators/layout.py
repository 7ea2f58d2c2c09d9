"""Layout: headings, blocks, regions, text widths, and placement of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.joins import join_per_key
from quire.functions.text import is_blank, let, strip
from quire.operators.text import color_rgb, font_code, is_bold, stamp_text

AT = ["doc_id", "page", "block", "line", "span"]


def overlaps(a: tuple[str, str, str, str], b: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Column:
    """Whether two boxes, given as column names, share an area."""
    ax0, ay0, ax1, ay1 = (F.col(c) for c in a)
    bx0, by0, bx1, by1 = (F.col(c) for c in b)
    return (bx0 < ax1) & (bx1 > ax0) & (by0 < ay1) & (by1 > ay0)


# --- structure ---------------------------------------------------------------


def avg_font_size(spans: DataFrame) -> DataFrame:
    """Mean size over the non-blank spans of each document, 12 where all are blank."""
    size = F.when(~is_blank(F.col("text")), F.col("size"))
    return spans.groupBy("doc_id").agg(F.coalesce(F.avg(size), F.lit(fv.DEFAULT_FONT_SIZE)).alias("avg_size"))


def all_caps(text: Column) -> Column:
    """Whether a text is all capitals: letters only, more than three."""
    # most texts have a character that is no letter, so few are raised to capitals
    return (F.length(text) > 3) & text.rlike(r"^\p{L}+$") & (F.upper(text) == text)


def heading_level(caps: Column, size: Column, flags: Column, avg_size: Column) -> Column:
    """1 to 4, or 0 for running text; ``caps`` tells the spans that are all capitals."""
    large = size >= avg_size + fv.HEADING_SIZE_STEP
    bold = is_bold(flags)
    return (
        F.when(large & bold, 1).when(large, 2).when(bold & caps, 2).when(bold, 3).when(caps, 4).otherwise(0)
    )


def headings(spans: DataFrame) -> DataFrame:
    """Spans that stand out, with their level; texts are judged before the join, so counts of headings shuffle no text."""
    filled = spans.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    return (
        join_per_key(filled.withColumn("_caps", all_caps(F.col("text"))), avg_font_size(spans), ["doc_id"])
        .withColumn("level", heading_level(F.col("_caps"), F.col("size"), F.col("flags"), F.col("avg_size")))
        .where("level > 0")
        .withColumn("bold", is_bold(F.col("flags")))
        .drop("_caps")
    )


def sections(spans: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Headings as a flat outline; (page, block, line, span) is the reading order.

    ``toc(doc_id, seq, level, title, page)`` rows are passed through, marked as such.
    """
    out = headings(spans).select(
        "doc_id", F.lit("heading").alias("origin"), F.col("text").alias("title"), "level", "page", "block", "line", "span"
    )
    if toc is None:
        return out
    listed = toc.select(
        "doc_id", F.lit("toc").alias("origin"), "title", "level", "page", F.col("seq").alias("block"),
        F.lit(0).alias("line"), F.lit(0).alias("span"),
    )
    return out.unionByName(listed)


def classify_blocks(spans: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Blocks as heading, list item, paragraph or image; blank text blocks are dropped."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("line", "span", "text"))), lambda p: p["text"])
    blocks = spans.groupBy("doc_id", "page", "block").agg(
        strip(F.array_join(pieces, "")).alias("text"),
        F.max("size").alias("font_size"),
        F.max(is_bold(F.col("flags"))).alias("bold"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    text = F.col("text")
    heading = (F.col("font_size") >= F.col("avg_size") + fv.HEADING_SIZE_STEP) | (
        F.col("bold") & (F.length(text) < fv.HEADING_MAX_CHARS)
    )
    kind = F.when(heading, "heading").when(text.rlike("(?U)" + fv.LIST_ITEM), "list_item").otherwise("paragraph")
    sized = join_per_key(blocks.where(text != ""), avg_font_size(spans), ["doc_id"])
    out = sized.withColumn("kind", kind).drop("avg_size")
    if images is None:
        return out
    pictures = images.select(
        "doc_id",
        "page",
        F.col("idx").alias("block"),
        F.lit("image").alias("kind"),
        "x0",
        "y0",
        "x1",
        "y1",
    )
    return out.unionByName(pictures, allowMissingColumns=True)


def page_inventory(pages: DataFrame, images: DataFrame, links: DataFrame) -> DataFrame:
    """Images and links per page and per document.

    Both sides are counted per page before the join; the lists themselves stay
    rows in ``images`` and ``links``.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(name))

    per_page = (
        pages.select("doc_id", "page")
        .join(counted(images, "image_count"), ["doc_id", "page"], "left")
        .join(counted(links, "link_count"), ["doc_id", "page"], "left")
        .na.fill(0, ["image_count", "link_count"])
    )
    totals = per_page.groupBy("doc_id").agg(
        F.sum("image_count").alias("doc_images"), F.sum("link_count").alias("doc_links")
    )
    return join_per_key(per_page, totals, ["doc_id"])


def list_images(images: DataFrame) -> DataFrame:
    """One row per placement with its size, and the document's number of placements."""
    total = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"))
    sized = images.withColumn("width", F.col("x1") - F.col("x0")).withColumn("height", F.col("y1") - F.col("y0"))
    return join_per_key(sized, total, ["doc_id"])


# --- regions -----------------------------------------------------------------

REGION = ("rx0", "ry0", "rx1", "ry1")
BOX = ("x0", "y0", "x1", "y1")
CROWDED = 256  # spans on a page from which it is divided into cells
CELL_SPANS = 16  # spans a cell holds about
CELLS = 64  # cells along a page's side at most


def _grids(spans: DataFrame) -> DataFrame:
    """(doc_id, page, _k, _gx, _gy, _wx, _wy): cells a side, origin and cell size of each page with very many spans."""
    left, top, right, bottom = (F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    page = spans.groupBy("doc_id", "page").agg(
        F.count("*").alias("_n"),
        F.min(left).alias("_gx"),
        F.min(top).alias("_gy"),
        F.max(right).alias("_rx"),
        F.max(bottom).alias("_by"),
    )
    page = page.where(F.col("_n") >= CROWDED)
    page = page.withColumn("_k", F.least(F.lit(CELLS), F.ceil(F.sqrt(F.col("_n") / CELL_SPANS))).cast("int"))
    wide, high = (F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)) / F.col("_k") for hi, lo in (("_rx", "_gx"), ("_by", "_gy")))
    return page.select("doc_id", "page", "_k", "_gx", "_gy", wide.alias("_wx"), high.alias("_wy"))


def _dealt(df: DataFrame, grids: DataFrame, box: tuple[str, str, str, str], tag: str) -> DataFrame:
    """``df`` once for each cell its box touches, with its first column and row of cells; a page without a grid is one cell."""

    def place(at: Column, origin: str, size: str) -> Column:
        k = F.floor((at - F.col(origin)) / F.col(size))
        return F.coalesce(F.least(F.greatest(k, F.lit(0)), F.col("_k") - 1), F.lit(0)).cast("int")

    x0, y0, x1, y1 = (F.col(c) for c in box)
    cols = F.sequence(place(F.least(x0, x1), "_gx", "_wx"), place(F.greatest(x0, x1), "_gx", "_wx"))
    rows = F.sequence(place(F.least(y0, y1), "_gy", "_wy"), place(F.greatest(y0, y1), "_gy", "_wy"))
    cells = F.flatten(F.transform(cols, lambda c: F.transform(rows, lambda r: c * CELLS + r)))
    met = df.join(grids, ["doc_id", "page"], "left")
    met = met.withColumn(f"_c{tag}", cols[0]).withColumn(f"_r{tag}", rows[0]).withColumn("_cell", F.explode(cells))
    return met.drop("_k", "_gx", "_gy", "_wx", "_wy")


def touching(boxes: DataFrame, spans: DataFrame, box: tuple[str, str, str, str] = REGION) -> DataFrame:
    """Each row of ``boxes(doc_id, page, box)`` with each span that overlaps it.

    A page with very many spans is divided into cells. Boxes and spans are dealt to the cells they touch and meet by
    (doc_id, page, cell), so that few pairs are tested that do not overlap; a pair that shares several cells counts in
    the first. On other pages the page is the cell. The box test is the residual of an equi-join, never a product.
    """
    grids = _grids(spans)
    met = _dealt(boxes, grids, box, "a").join(_dealt(spans, grids, BOX, "b"), ["doc_id", "page", "_cell"])
    first = F.greatest("_ca", "_cb") * CELLS + F.greatest("_ra", "_rb")
    return met.where(overlaps(box) & (F.col("_cell") == first)).drop("_cell", "_ca", "_cb", "_ra", "_rb")


def region_spans(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Non-blank spans that overlap ``regions(region_id, doc_id, page, rx0, ry0, rx1, ry1)``."""
    return touching(regions, spans.where(~is_blank(F.col("text"))))


def region_text(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Text of each region, whole spans in reading order; ``has_text`` tells the empty ones."""
    joined = region_spans(spans, regions)
    pieces = F.sort_array(F.collect_list(F.struct("block", "line", "span", "text")))
    text = joined.groupBy("region_id").agg(
        strip(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")).alias("text")
    )
    return (
        regions.join(text, "region_id", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("has_text", F.col("text") != "")
    )


def _bands(spans: DataFrame) -> DataFrame:
    """Spans numbered ``i`` in the reading order of their page, and the band of the page they lie in.

    A span reaches half its size up and down from its y. Bands are the stretches that these reaches cover without a
    gap, found in one pass from top to bottom; what a span can be level with lies in its own band.
    """
    page = Window.partitionBy("doc_id", "page")
    half = F.coalesce("size", F.lit(0.0)) * 0.5
    reach = spans.withColumn("_top", F.col("y0") - half).withColumn("_end", F.col("y0") + half)
    reading = page.orderBy("block", "line", "span", "x0", "y0", "x1", "y1", "size", "font", "color", "text")
    down = page.orderBy("_top", "_end", "i")
    reach = reach.withColumn("i", F.row_number().over(reading) - 1)
    covered = F.max("_end").over(down.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("_top") > covered, 1).otherwise(0)
    reach = reach.withColumn("_begins", begins)
    return reach.withColumn("band", F.sum("_begins").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_top", "_end", "_begins")


def span_groups(spans: DataFrame) -> DataFrame:
    """Spans of a page gathered into lines around anchors, in reading order.

    Each span joins the first earlier anchor that is level with it (less than
    half the anchor's size apart) and near enough (starts less than twice the
    size after the anchor's end); otherwise it becomes an anchor. A page is cut
    into bands between which no two spans are level, so a fold over the spans of
    a band decides it and holds that band's anchors only.
    """
    span = F.struct("i", "x0", "y0", "x1", "y1", "size", "font", "color", "text")
    in_band = _bands(spans).groupBy("doc_id", "page", "band").agg(F.sort_array(F.collect_list(span)).alias("s"))
    anchor_type = "array<struct<i:int,y0:double,x1:double,size:double>>"
    start = F.struct(F.array().cast(anchor_type).alias("anchors"), F.array().cast("array<int>").alias("owner"))

    def step(acc: Column, s: Column) -> Column:
        near = F.filter(
            acc["anchors"],
            lambda a: (F.abs(s["y0"] - a["y0"]) < a["size"] * 0.5) & (s["x0"] - a["x1"] < a["size"] * 2),
        )
        owner = F.coalesce(F.get(near, F.lit(0))["i"], s["i"])
        new = F.struct(s["i"].alias("i"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["size"].alias("size"))
        return F.struct(
            F.when(owner == s["i"], F.concat(acc["anchors"], F.array(new))).otherwise(acc["anchors"]).alias("anchors"),
            F.concat(acc["owner"], F.array(owner)).alias("owner"),
        )

    owned = in_band.withColumn("owner", F.aggregate("s", start, step, lambda acc: acc["owner"]))
    rows = owned.select("doc_id", "page", F.explode(F.arrays_zip("s", "owner")).alias("z")).select(
        "doc_id", "page", F.col("z.owner").alias("anchor"), "z.s.*"
    )
    texts = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda p: p["text"])
    return rows.groupBy("doc_id", "page", "anchor").agg(
        F.array_join(texts, " ").alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.min_by("font", "i").alias("font"),
        F.min_by("size", "i").alias("size"),
        F.min_by("color", "i").alias("color"),
    )


# --- widths and sizes ----------------------------------------------------------

KNOWN_CODES = tuple(code for codes in fv.FONT_VARIANTS.values() for code in codes)


def glyph_classes(glyphs: DataFrame) -> DataFrame:
    """``glyphs(font_code, ch, unit_width)`` as one row per font: ``classes`` with its widths.

    ``widths`` holds each width with the last of its characters, which stands for all of them; ``others`` and ``stands``
    name the others and, place by place, what stands for them. A character of several widths counts with their sum. One
    row per font, whatever its code; a font with an unknown width has no ``widths``.
    """
    held = glyphs.select("font_code", "unit_width", F.explode_outer(F.split("ch", "")).alias("ch")).distinct()
    total, unknown = F.sum(F.col("unit_width").cast("double")), F.max(F.col("unit_width").isNull())
    held = held.groupBy("font_code", "ch").agg(total.alias("unit_width"), unknown.alias("unknown"))
    chars = F.sort_array(F.collect_set(F.when(F.col("ch") != "", F.col("ch")))).alias("chars")
    alike = held.groupBy("font_code", "unit_width").agg(chars, F.max("unknown").alias("unknown"))
    stand = F.try_element_at("chars", F.lit(-1))
    one = F.struct("unit_width", stand.alias("ch"), F.filter("chars", lambda x: x != stand).alias("others"))
    lists = F.sort_array(F.collect_list(F.when(stand.isNotNull(), one)))
    fonts = alike.groupBy("font_code").agg(lists.alias("_all"), F.max("unknown").alias("_unknown"))
    others = F.array_join(F.transform("_all", lambda g: F.array_join(g["others"], "")), "")
    stands = F.array_join(F.transform("_all", lambda g: F.repeat(g["ch"], F.size(g["others"]))), "")
    widths = F.when(~F.col("_unknown"), F.transform("_all", lambda g: F.struct(g["unit_width"], g["ch"])))
    return fonts.select("font_code", F.struct(widths.alias("widths"), others.alias("others"), stands.alias("stands")).alias("classes"))


def _width(text: str, size: str) -> Column:
    """Width of column ``text`` by the width classes in ``_classes``: one pass puts its stand-in for each character."""
    classes = F.col("_classes")
    alike = F.call_function("translate", F.col(text), classes["others"], classes["stands"])
    units = let(
        alike,
        lambda t: F.aggregate(
            classes["widths"],
            F.lit(0.0),
            lambda acc, g: acc + g["unit_width"] * (F.length(t) - F.length(F.replace(t, g["ch"], F.lit("")))),
        ),
    )
    return F.coalesce(units, F.lit(0.0)) * F.col(size)


def text_width(df: DataFrame, glyphs: DataFrame, text: str, size: str, out: str, code: str = "font_code") -> DataFrame:
    """Width of column ``text`` at ``size`` in the font of column ``code``.

    Characters are counted per width class (length before and after removing
    the one that stands for the class), so no row is exploded into characters.
    Characters without a glyph add nothing.
    """
    classes = glyph_classes(glyphs).withColumnsRenamed({"font_code": code, "classes": "_classes"})
    return join_per_key(df, classes, [code], "left").withColumn(out, _width(text, size)).drop("_classes")


def text_width_in(df: DataFrame, glyphs: DataFrame, text: str, size: str, out: str, font: str) -> DataFrame:
    """Width of column ``text`` at ``size`` in one font for all rows, whose classes are a scalar subquery and no join."""
    classes = glyph_classes(glyphs.where(F.col("font_code") == font)).select("classes").scalar()
    return df.withColumn("_classes", classes).withColumn(out, _width(text, size)).drop("_classes")


def fit_font_size(text: Column, size: Column, old_width: Column, new_width: Column) -> tuple[Column, Column]:
    """Size that makes ``text`` fit the old width, and whether the floor was hit.

    Up to 5 % over is kept. The floor is 70 % of the size but at least 6 points,
    so a size below 6 can grow.
    """
    keep = (text == "") | (new_width <= old_width * fv.WIDTH_TOLERANCE)
    floor = F.greatest(size * fv.MAX_SHRINK, F.lit(fv.MIN_FONT_SIZE))
    scaled = size * old_width / new_width
    return (
        F.when(keep, size).otherwise(F.greatest(scaled, floor)),
        F.when(keep, False).otherwise(scaled < floor),
    )


# --- edits -------------------------------------------------------------------


def _with_fit(df: DataFrame, glyphs: DataFrame, text: str, size: str, old_width: Column) -> DataFrame:
    wide = text_width(df, glyphs, text, size, "new_width")
    fitted, floored = fit_font_size(F.col(text), F.col(size), old_width, F.col("new_width"))
    return wide.withColumn("adjusted_size", fitted).withColumn("size_warning", floored)


def replacement_plan(spans: DataFrame, edits: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Every span an edit changes, with its new text, font, fitted size and insert point.

    ``edits(edit_id, doc_id, scope, find, repl)``; a null ``scope`` means all pages.
    """
    hit = F.col("text").contains(F.col("find")) & (F.col("scope").isNull() | (F.col("scope") == F.col("page")))
    planned = (
        join_per_key(spans, edits, ["doc_id"])
        .where(hit)
        .withColumn("replacement", F.replace("text", F.col("find"), F.col("repl")))
        .withColumn("font_code", font_code(F.col("font"), F.col("flags")))
    )
    fitted = _with_fit(planned, glyphs, "replacement", "size", F.col("x1") - F.col("x0"))
    return fitted.select(
        "edit_id",
        *AT,
        F.col("text").alias("original"),
        "replacement",
        "font_code",
        F.col("size").alias("original_size"),
        "adjusted_size",
        (F.col("adjusted_size") != F.col("size")).alias("was_scaled"),
        F.col("x0").alias("insert_x"),
        F.coalesce("origin_y", F.col("y1") - F.col("adjusted_size") * fv.BASELINE_DROP).alias("insert_y"),
        color_rgb(F.col("color")).alias("rgb"),
        "size_warning",
    )


def edit_region(spans: DataFrame, pages: DataFrame, edits: DataFrame, glyphs: DataFrame) -> DataFrame:
    """New text for a box, styled like the first span that overlaps it.

    ``edits(edit_id, doc_id, page, rx0, ry0, rx1, ry1, new_text, new_size,
    new_color)``; null or zero ``new_size`` and null ``new_color`` inherit.
    """
    style = spans.where(~is_blank(F.col("text"))).select(
        "doc_id",
        "page",
        F.struct("block", "line", "span").alias("_at"),
        F.struct(
            font_code(F.col("font"), F.col("flags")).alias("font_code"),
            "size",
            "color",
            F.coalesce("origin_y", "y1").alias("baseline"),
        ).alias("_style"),
        "x0",
        "y0",
        "x1",
        "y1",
    )
    first = (
        touching(edits.select("edit_id", "doc_id", "page", *REGION), style)
        .groupBy("edit_id")
        .agg(F.min_by("_style", "_at").alias("_style"))
    )
    known = pages.select("doc_id", "page", F.lit(True).alias("_known"))
    own_size = F.when(F.col("new_size") != 0, F.col("new_size"))
    planned = (
        edits.join(known, ["doc_id", "page"], "left")
        .join(first, "edit_id", "left")
        .withColumn("font_code", F.coalesce("_style.font_code", F.lit("helv")))
        .withColumn("size", F.coalesce(own_size, "_style.size", F.lit(fv.EDIT_FONT_SIZE)))
        .withColumn("color", F.coalesce("new_color", "_style.color", F.lit(0)))
    )
    fitted = _with_fit(planned, glyphs, "new_text", "size", F.col("rx1") - F.col("rx0"))
    return (
        fitted.withColumn("insert_x", F.col("rx0"))
        .withColumn(
            "insert_y",
            F.coalesce("_style.baseline", F.col("ry1") - F.col("adjusted_size") * fv.BASELINE_DROP),
        )
        .withColumn("status", F.when(F.col("_known"), "ok").otherwise("invalid_page"))
        .drop("_style", "_known", "new_width")
    )


def move_spans(spans: DataFrame, moves: DataFrame) -> DataFrame:
    """Spans of an old box carried to a new box, scaled by the smaller ratio.

    ``moves(move_id, doc_id, page, rx0..ry1, nx0..ny1)``, each id once. A move
    without spans keeps one row with status ``nothing``.
    """
    old_w = F.greatest(F.col("rx1") - F.col("rx0"), F.lit(1.0))
    old_h = F.greatest(F.col("ry1") - F.col("ry0"), F.lit(1.0))
    new_w, new_h = F.col("nx1") - F.col("nx0"), F.col("ny1") - F.col("ny0")
    size = F.col("size") * F.least(new_w / old_w, new_h / old_h)
    moved = F.col("span").isNotNull()
    found = touching(moves.select("move_id", "doc_id", "page", *REGION), spans.where(~is_blank(F.col("text"))))
    return (
        moves.join(found.drop("doc_id", "page", *REGION), "move_id", "left")
        .withColumn("new_x", F.col("nx0") + (F.col("x0") - F.col("rx0")) / old_w * new_w)
        .withColumn("new_size", F.when(moved, F.least(F.greatest(size, F.lit(fv.MOVE_MIN_SIZE)), F.lit(fv.MOVE_MAX_SIZE))))
        .withColumn("new_y", F.col("ny0") + (F.col("y0") - F.col("ry0")) / old_h * new_h + F.col("new_size"))
        .withColumn("font_code", F.when(moved, font_code(F.col("font"), F.col("flags"))))
        .withColumn("status", F.when(moved, "text").otherwise("nothing"))
    )


def addition_status(pages: DataFrame, additions: DataFrame) -> DataFrame:
    """``additions(add_id, doc_id, page, x, y, text, font_size, color)`` with defaults and a status."""
    known = pages.select("doc_id", "page", F.lit(True).alias("_known"))
    return (
        additions.join(known, ["doc_id", "page"], "left")
        .withColumn("font_size", F.coalesce("font_size", F.lit(fv.DEFAULT_FONT_SIZE)))
        .withColumn("color", F.coalesce("color", F.lit(0)))
        .withColumn("status", F.when(F.col("_known"), "ok").otherwise("invalid_page"))
        .drop("_known")
    )


def add_spans(spans: DataFrame, pages: DataFrame, additions: DataFrame) -> DataFrame:
    """All spans plus the accepted additions, which sit one font size below (x, y)."""
    placed = addition_status(pages, additions).where("status = 'ok'")
    baseline = F.col("y") + F.col("font_size")
    new = placed.select(
        "doc_id",
        "page",
        F.lit(-1).alias("block"),
        F.lit(0).alias("line"),
        F.lit(0).alias("span"),
        "text",
        F.lit("Helvetica").alias("font"),
        F.col("font_size").alias("size"),
        "color",
        F.lit(0).alias("flags"),
        F.col("x").alias("origin_x"),
        baseline.alias("origin_y"),
    )
    return spans.unionByName(new, allowMissingColumns=True)


# --- stamps ------------------------------------------------------------------


def _chosen(pages: DataFrame, only: list[int] | None) -> DataFrame:
    return pages if only is None else pages.where(F.col("page").isin(*only))


def stamp_layout(
    pages: DataFrame,
    names: DataFrame | None,
    glyphs: DataFrame,
    template: str = fv.STAMP_TEXT,
    position: str = "bottom-center",
    font_size: float = fv.STAMP_FONT_SIZE,
    margin: float = fv.STAMP_MARGIN,
    only: list[int] | None = None,
    as_of: str = "1970-01-01",
) -> DataFrame:
    """Where the stamp of every page goes; ``position`` names a side and top or bottom."""
    stamped = _chosen(stamp_text(pages, names, template, as_of), only)
    sized = stamped.withColumn("_size", F.lit(float(font_size)))
    measured = text_width_in(sized, glyphs, "stamp", "_size", "stamp_width", "helv")
    where = position.lower()
    if "left" in where:
        x = F.lit(float(margin))
    elif "right" in where:
        x = F.col("width") - margin - F.col("stamp_width")
    else:
        x = (F.col("width") - F.col("stamp_width")) / 2
    y = F.lit(float(margin + font_size)) if "top" in where else F.col("height") - margin
    return measured.withColumn("x", x).withColumn("y", y).drop("_size")


def watermark_layout(
    pages: DataFrame,
    glyphs: DataFrame,
    text: str = fv.WATERMARK_TEXT,
    font_size: float = fv.WATERMARK_FONT_SIZE,
    rotation: float = fv.WATERMARK_ROTATION,
    opacity: float = fv.WATERMARK_OPACITY,
    only: list[int] | None = None,
) -> DataFrame:
    """Start point of a watermark turned by ``rotation`` degrees about the page centre."""
    marked = _chosen(pages, only).withColumn("watermark", F.lit(text)).withColumn("_size", F.lit(float(font_size)))
    measured = text_width_in(marked, glyphs, "watermark", "_size", "watermark_width", "helv")
    angle = F.radians(F.lit(float(rotation)))
    half = F.col("watermark_width") / 2
    return (
        measured.withColumn("center_x", F.col("width") / 2)
        .withColumn("center_y", F.col("height") / 2)
        .withColumn("x", F.col("center_x") - half * F.cos(angle))
        .withColumn("y", F.col("center_y") - half * F.sin(angle) + font_size / 2)
        .withColumn("opacity", F.lit(float(opacity)))
        .drop("_size")
    )
