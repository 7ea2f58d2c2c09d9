"""Adapters: the raw tables seen as documents, pages, spans, cells and logs.

All of them are narrow projections (split, transform, explode) of one scan, so
Spark can push filters and columns through them and no adapter shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.session import tune

LINES_PER_PAGE = 8
PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0
FONTS = (
    "Helvetica",
    "BCDEEE+Helvetica-Light",
    "TimesNewRomanPSMT",
    "Times-Bold",
    "Courier New",
    "XYZABC+NimbusSans-Bold",
    "DejaVu Sans Mono",
    "Georgia",
    "Arial_Bold MT",
    "Menlo-Regular",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out over ``quire.scan.partitions`` tasks, where the session sets that.

    A file with one row group is one task however many cores there are. A session
    for a few such files sets it (``local_session`` does); without it scans stay
    as they are.
    """
    parts = df.sparkSession.conf.get("quire.scan.partitions", None)
    return df.repartition(int(parts)) if parts else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def page_texts(text: Column) -> Column:
    """The pages of one document text, as an array."""
    return let(F.split(text, "\n", -1), lambda lines: groups_of(lines, LINES_PER_PAGE))


def groups_of(lines: Column, n: int) -> Column:
    """An array of lines as an array of texts of ``n`` lines each."""
    last = F.floor((F.size(lines) - 1) / F.lit(n)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice(lines, p * n + 1, n), "\n")
    )


def pages_of(docs_df: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` cut into pages of eight lines."""
    return docs_df.select("doc_id", F.posexplode(page_texts(F.col("text"))).alias("page", "text")).select(
        "doc_id",
        "page",
        F.lit(PAGE_WIDTH).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height"),
        F.lit(0).alias("rotation"),
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(docs(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per line; two lines make a block, eight lines a page."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    on_page = F.col("i") % LINES_PER_PAGE
    y0 = F.lit(72.0) + on_page * F.lit(14.0)
    return lines.select(
        "doc_id",
        F.floor(F.col("i") / LINES_PER_PAGE).cast("int").alias("page"),
        F.floor(on_page / 2).cast("int").alias("block"),
        (F.col("i") % 2).alias("line"),
        F.lit(0).alias("span"),
        "text",
        _pick(FONTS, F.col("doc_id") % len(FONTS)).alias("font"),
        F.when(F.col("i") == 0, 18.0).otherwise(12.0).alias("size"),
        ((F.col("doc_id") * 7919) % 16777216).cast("int").alias("color"),
        F.when(F.col("i") == 0, 16)
        .when(F.col("i") % 5 == 4, 2)
        .when(F.col("i") % 7 == 3, 18)
        .when(F.col("i") % 11 == 6, 8)
        .otherwise(4)
        .alias("flags"),
        F.lit(72.0).alias("x0"),
        y0.alias("y0"),
        (F.lit(72.0) + F.lit(6.0) * F.length("text")).alias("x1"),
        (y0 + 12.0).alias("y1"),
        F.lit(72.0).alias("origin_x"),
        F.when(F.col("i") % 3 != 2, y0 + 10.0).alias("origin_y"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image placements taken from the web pages' ``ad`` boxes and list items."""
    html = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract_all("html", F.lit(r"<(div class=.ad.|li|b)>"), F.lit(1)).alias("tags"),
    )
    return html.select("doc_id", F.posexplode("tags").alias("i", "tag")).select(
        "doc_id",
        (F.col("i") % 3).alias("page"),
        F.floor(F.col("i") / 3).cast("int").alias("idx"),
        (F.col("i") + 1).cast("int").alias("xref"),
        F.lit(72.0).alias("x0"),
        (F.lit(100.0) + F.col("i") * 10.0).alias("y0"),
        (F.lit(72.0) + F.length("tag") * 20.0).alias("x1"),
        (F.lit(100.0) + F.col("i") * 10.0 + 40.0).alias("y1"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("uris"),
    )
    return html.select("doc_id", F.posexplode("uris").alias("i", "uri")).select(
        "doc_id",
        (F.col("i") % 3).alias("page"),
        F.when(F.col("uri").startswith("/"), 1).otherwise(2).alias("kind"),
        "uri",
    )


def with_upload(documents: DataFrame) -> DataFrame:
    """Documents with the file name and size they are uploaded under; a few files hold far more than their text."""
    ending = _pick((".PDF", ".pdf", ".txt", " .pdf ", ".pdf"), F.col("doc_id") % 5)
    name = F.concat(F.lit("in/"), F.col("source"), F.lit("/ doc_"), F.col("doc_id").cast("string"), ending)
    more = F.when(F.col("doc_id") % 97 == 5, 60 * 1024 * 1024).otherwise(0)
    size = F.octet_length("text") + more.cast("bigint")
    return documents.withColumn("filename", name).withColumn("n_bytes", size)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests: one file name and size per document."""
    return with_upload(table(spark, sf_dir, "documents")).select("doc_id", "filename", "n_bytes")


TABLE_HEADER = ("Order", "Customer", "Total Price", "Priority", "", "Order")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as extracted tables: five orders a table, four tables a document.

    The header row travels with the first order of its table. Some rows are
    ragged, some have a cell beyond the header, some tables have no body.
    """
    key = F.col("o_orderkey")
    r = (key % 5 + 1).cast("int")
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    body = F.array(
        key.cast("string"),
        F.when(key % 9 == 4, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))),
        F.when(key % 17 == 3, F.lit("n/a")).otherwise(money),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    ragged = F.when(key % 7 == 3, F.slice(body, 1, 4)).when(
        key % 11 == 5, F.concat(body, F.array(F.lit("extra")))
    ).otherwise(body)
    empty = F.array().cast("array<string>")
    has_body = (F.floor(key / 5) % 13) != 7
    header = F.array(*[F.lit(h) for h in TABLE_HEADER])
    rows = F.array(
        F.struct(F.lit(0).alias("r"), F.when(key % 5 == 0, header).otherwise(empty).alias("row")),
        F.struct(r.alias("r"), F.when(has_body, ragged).otherwise(empty).alias("row")),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate"
    )
    return (
        spread(orders)
        .select(
            F.floor(key / 20).alias("doc_id"),
            (F.floor(key / 5) % 4).cast("int").alias("page"),
            F.lit(0).alias("table_index"),
            F.explode(rows).alias("x"),
        )
        .select("doc_id", "page", "table_index", F.col("x.r").alias("r"), F.posexplode("x.row").alias("c", "cell"))
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of two lines, numbered inside their page."""
    pairs = let(F.split("text", "\n", -1), lambda lines: groups_of(lines, 2))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(pairs).alias("b", "text")).select(
        "doc_id",
        F.floor(F.col("b") / 4).cast("int").alias("page"),
        (F.col("b") % 4).alias("block"),
        "text",
    )


FIRST_NAMES = ("Ann", "Bob", "Carla", "Dmitri", "Eva")
LAST_NAMES = ("Smith", "Jones", "Garcia", "Miller", "Weber", "Rossi", "Novak")
ORGS = ("Acme Widgets Inc", "Northern Bank", "Delta Foundation", "Blue Sky Partners", "J&J-Data Corp.", "Tech University")


def other_id(doc_id: Column, kind: int) -> Column:
    """An id that no given document has (they are not negative), and no other ``kind`` (0 to 3) either."""
    return -(doc_id * 4 + kind + 1)


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written out as invoice pages: full of names, dates, amounts and addresses."""
    k, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    text = F.concat(
        F.lit("Invoice dated "),
        F.date_format(day, "MM/dd/yyyy"),
        F.lit(" for "),
        _pick(FIRST_NAMES, cust % 5),
        F.lit(" "),
        _pick(LAST_NAMES, cust % 7),
        F.lit(" of "),
        _pick(ORGS, cust % 6),
        F.lit(" in The White House.\nContact user"),
        cust.cast("string"),
        F.lit("@shop"),
        (cust % 50).cast("string"),
        F.lit(".example.com or +1 555-010-"),
        F.lpad((k % 10000).cast("string"), 4, "0"),
        F.lit(" now. Total $"),
        F.format_number("o_totalprice", 2),
        F.lit(", paid "),
        F.date_format(day, "MMMM d, yyyy"),
        F.lit(" or "),
        F.date_format(day, "MMM d yy"),
        F.lit(".\nSee https://shop.example.com/o/"),
        (k % 3).cast("string"),
        F.lit(" ref "),
        F.lpad((k % 900 + 100).cast("string"), 3, "0"),
        F.lit("-45-"),
        F.lpad((cust % 10000).cast("string"), 4, "0"),
        F.lit(" costs 12.50 USD"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return spread(orders).select(
        other_id(F.floor(k / 8), 0).alias("doc_id"), (k % 8).cast("int").alias("page"), text.alias("text")
    )


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir).select("doc_id", "page", "text")
    return own.unionByName(order_pages(spark, sf_dir))


def edited_copies(docs_df: DataFrame) -> DataFrame:
    """Every document once more, with words changed, lines moved and a line added."""
    lines = F.split(F.replace("text", F.lit(" the "), F.lit(" that ")), "\n", -1)
    kept = F.filter(lines, lambda x, i: (i % 11) != 9)
    return docs_df.select(
        other_id(F.col("doc_id"), 1).alias("doc_id"),
        F.array_join(F.concat(kept, F.array(F.lit("appended line"))), "\n").alias("text"),
    )


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph table: every character of the documents in every font code, with a made width."""
    from quire.operators.layout import KNOWN_CODES

    chars = docs(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct()
    codes = F.array(*[F.lit(c) for c in KNOWN_CODES])
    step = (F.ascii("ch") * 7 + F.col("code_no") * 3) % 13
    return chars.select("ch", F.posexplode(codes).alias("code_no", "font_code")).select(
        "font_code", "ch", ((F.lit(200) + step * 50) / 1000.0).alias("unit_width")
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at full stops into several spans side by side, a little uneven."""
    s = spans(spark, sf_dir)
    cut = s.select(
        "doc_id", "page", "block", "line", "font", "size", "color", "flags", "y0",
        F.posexplode(F.split("text", "[.]", -1)).alias("span", "text"),
    )
    y = F.col("y0") + (F.col("span") % 4) * 2.0
    x = F.lit(72.0) + F.col("span") * 90.0
    return cut.select(
        "doc_id", "page", "block", "line", "span", "text", "font", "size", "color", "flags",
        x.alias("x0"), y.alias("y0"), (x + F.length("text") * 6.0).alias("x1"), (y + 12.0).alias("y1"),
    )


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as printed form pages, ten customers to a document."""
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("Full Name: ____ "),
        F.col("c_name"),
        F.lit("\n[x] "),
        F.col("c_mktsegment"),
        F.lit("\n[ ] Send mail\nBalance due:   _____ and more\nHome\nAddress: ___\n[X]  Nation "),
        F.col("c_nationkey").cast("string"),
        F.lit(" \nno field: __\n[y] no box"),
    )
    return table(spark, sf_dir, "customer").select(
        F.floor(key / 10).alias("doc_id"), (key % 10).cast("int").alias("page"), text.alias("text")
    )


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three interactive fields per customer page."""
    key = F.col("c_custkey")
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("field_name"), F.lit(t).alias("field_type"), v.alias("field_value"))
            for n, t, v in (
                ("name", "text", F.col("c_name")),
                ("Send mail", "combobox", F.col("c_mktsegment")),
                ("active", "checkbox", F.when(F.col("c_acctbal") > 0, "Yes").otherwise("Off")),
            )
        ]
    )
    return (
        table(spark, sf_dir, "customer")
        .select(F.floor(key / 10).alias("doc_id"), (key % 10).cast("int").alias("page"), F.posexplode(fields).alias("pos", "f"))
        .select("doc_id", "page", "pos", "f.*")
    )


def as_edit_log(events: DataFrame) -> DataFrame:
    """User events as a document's edits, undos and redos; views and purchases are edits too."""
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        "ts",
        action.alias("action"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("operation"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_edit_log(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "ts", "user_id")


def as_annotation_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("doc_id"),
        (F.col("event_id") % 4).cast("int").alias("page"),
        F.col("ts").alias("saved_at"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("items"),
    )


def annotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_annotation_log(table(spark, sf_dir, "events"))


def highlight_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but views and signups as highlight requests of up to three rectangles."""
    k, v = F.col("event_id"), F.col("value")
    rect = lambda i: F.array(v + i, v + i * 2, v + i + 10, v + i * 2 + 5)
    rects = F.slice(F.transform(F.sequence(F.lit(0), F.lit(2)), rect), F.lit(1), (k % 4).cast("int"))
    return table(spark, sf_dir, "events").where("event_type NOT IN ('view', 'signup')").select(
        k.alias("request_id"),
        F.col("user_id").alias("doc_id"),
        (k % 3).cast("int").alias("page"),
        rects.alias("rects"),
        F.when(k % 2 == 0, F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0))).alias("color"),
        F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.8).alias("opacity"),
    )


def ink_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and signups as drawings of two paths with up to four points."""
    k, v = F.col("event_id"), F.col("value")

    def path(n: Column) -> Column:
        pts = F.slice(
            F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array(v + i, v * 2 + i)), F.lit(1), n.cast("int")
        )
        color = F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return F.struct(pts.alias("points"), color.alias("color"), F.when(k % 5 == 0, 4.0).alias("width"))

    return table(spark, sf_dir, "events").where("event_type IN ('view', 'signup')").select(
        k.alias("request_id"),
        F.col("user_id").alias("doc_id"),
        (k % 3).cast("int").alias("page"),
        F.array(path(k % 4), path(k % 5)).alias("paths"),
    )


# {1} and {2} stand for the first and second word of the conversation text, {n} for a page number
COMMANDS = (
    'replace "{1}" with "{2}"',
    "Change {1} to {2} everywhere",
    "swap the word {1} with {2}",
    "update {1} into {2} on page {n}",
    "how many times does {1} appear?",
    'count "{1}"',
    "How many pages does this document have?",
    'Delete all instances of "{1}" from the document',
    "remove {1}.",
    "delete page {n}",
    "remove pages {n} to 9",
    "rotate page {n}",
    "please rotate this one",
    "this needs to rotate",
    "Extract all emails",
    "find the phone numbers",
    "list dates",
    "send me the link",
    "redact all social security numbers",
    "Redact the email addresses",
    'add "{1}" to page {n}',
    "insert text '{2}' on top",
    "please summarize",
    "word count of {1}",
    "delete confidential {1}",
    "get all the urls",
    "  hello {1} and {2}  ",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation entry, and beside it a command made from its first words."""
    conv = table(spark, sf_dir, "conversations")
    word = F.split("text", "[ \n]", -1)
    command = _pick(COMMANDS, (F.col("conv_id") * 8 + F.col("turn")) % len(COMMANDS))
    for mark, value in (
        ("{1}", F.get(word, F.lit(0))),
        ("{2}", F.coalesce(F.get(word, F.lit(1)), F.lit("none"))),
        ("{n}", (F.col("turn") + 2).cast("string")),
    ):
        command = F.replace(command, F.lit(mark), value)
    both = F.array(
        F.struct(F.lit("said").alias("part"), F.col("text").alias("text")),
        F.struct(F.lit("command").alias("part"), command.alias("text")),
    )
    return conv.select(
        "conv_id", "turn", "role", F.explode(both).alias("m"), (F.col("turn") % 3).cast("int").alias("current_page")
    ).select("conv_id", "turn", "role", "m.part", "m.text", "current_page")
