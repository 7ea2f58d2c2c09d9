"""Scalar text operators: counts, clean-up, colours, fonts, stamps, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.joins import join_per_key
from quire.functions.text import UNICODE, let, strip, upper_first, word_count
from quire.operators.ingest import page_counts


def doc_stats(pages: DataFrame, sep: str = "\n", trailing: bool = True) -> DataFrame:
    """Pages, characters and words per document.

    Characters count the separators of the joined text. A white-space separator
    keeps words inside their page, so sums over pages are exact and are combined
    before the shuffle.
    """
    if not sep or not sep.isspace():
        raise ValueError("doc_stats needs a white-space separator")
    n = F.count(F.lit(1))
    seps = (n if trailing else n - 1) * len(sep)
    return pages.groupBy("doc_id").agg(
        n.cast("int").alias("page_count"),
        (F.sum(F.length("text")) + seps).alias("character_count"),
        F.sum(word_count(F.col("text"))).alias("word_count"),
    )


def text_counts(df: DataFrame, col: str = "text") -> DataFrame:
    c = F.col(col)
    return df.select(
        "*",
        word_count(c).alias("words"),
        F.length(c).alias("characters"),
        (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
    )


def fix_grammar(c: Column) -> Column:
    """Single spaces, and a capital after each full stop and at the start."""
    parts = F.split(F.regexp_replace(c, "  +", " "), UNICODE + r"\.\s+(?=[a-z])", -1)
    return F.array_join(
        F.transform(parts, lambda part, i: upper_first(part)),
        ". ",
    )


def normalize_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def color_rgb(c: Column) -> Column:
    """Packed 24-bit colour to a struct of red, green, blue in 0..1; black if null."""
    packed = F.coalesce(c, F.lit(0))
    return F.struct(
        *[
            (F.shiftright(packed, shift).bitwiseAND(255) / 255.0).alias(name)
            for name, shift in (("r", 16), ("g", 8), ("b", 0))
        ]
    )


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(1 << bit) != 0


def is_bold(flags: Column) -> Column:
    return has_bit(flags, fv.BOLD_BIT)


def is_italic(flags: Column) -> Column:
    return has_bit(flags, fv.ITALIC_BIT)


def _without_subset(font: Column) -> Column:
    return F.regexp_replace(font, r"^[^+]*\+", "")


def _hints(name: Column, hints) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(h) for h in hints])


def _variant(names, bold: Column, italic: Column) -> Column:
    regular, b, i, bi = names
    return F.when(bold & italic, bi).when(bold, b).when(italic, i).otherwise(regular)


def font_code(font: Column, flags: Column) -> Column:
    """Short code of a font; a known name wins over the style flags."""
    plain = F.regexp_replace(F.lower(_without_subset(font)), UNICODE + r"[\s\-_]+", "")
    names = F.create_map(*[F.lit(x) for kv in fv.FONT_CODES.items() for x in kv])
    bold, italic = is_bold(flags), is_italic(flags)
    serif = _variant(fv.FONT_VARIANTS["tiro"], bold, italic)
    mono = _variant(fv.FONT_VARIANTS["cour"], bold, italic)
    sans = _variant(fv.FONT_VARIANTS["helv"], bold, italic)

    def code(name: Column) -> Column:
        guessed = (
            F.when(has_bit(flags, fv.MONO_BIT), mono)
            .when(_hints(name, fv.SERIF_HINTS), serif)
            .when(_hints(name, fv.MONO_HINTS), mono)
            .otherwise(sans)
        )
        return F.coalesce(F.element_at(names, name), guessed)

    return let(plain, code)


def font_display_name(font: Column, bold: Column, italic: Column) -> Column:
    name = F.lower(_without_subset(font))
    return (
        F.when(_hints(name, fv.DISPLAY_MONO_HINTS), _variant(fv.DISPLAY_NAMES["mono"], bold, italic))
        .when(_hints(name, fv.DISPLAY_SERIF_HINTS), _variant(fv.DISPLAY_NAMES["serif"], bold, italic))
        .otherwise(_variant(fv.DISPLAY_NAMES["sans"], bold, italic))
    )


def stamp_text(
    pages: DataFrame,
    names: DataFrame | None,
    template: str = fv.STAMP_TEXT,
    as_of: str = "1970-01-01",
) -> DataFrame:
    """Fill {n}, {total}, {date} and {filename} for every page.

    ``names(doc_id, filename)`` may be absent; ``as_of`` is an argument so that
    a run can be repeated.
    """
    facts = page_counts(pages)
    if names is not None:
        facts = facts.join(names.select("doc_id", "filename"), "doc_id", "left")
        filename = F.coalesce(F.col("filename"), F.lit("document.pdf"))
    else:
        filename = F.lit("document.pdf")
    known = join_per_key(pages, facts, ["doc_id"])
    text = F.lit(template)
    for mark, value in (
        ("{n}", (F.col("page") + 1).cast("string")),
        ("{total}", F.col("page_count").cast("string")),
        ("{date}", F.lit(as_of)),
        ("{filename}", filename),
    ):
        text = F.replace(text, F.lit(mark), value)
    return known.withColumn("stamp", text)


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_line(c: Column, n: int = 100) -> Column:
    return F.substring(F.substring_index(strip(c), "\n", 1), 1, n)

