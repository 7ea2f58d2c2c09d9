"""Form fields: widgets and form-like text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import UNICODE, strip
from quire.operators.pageset import command_order

# order of the parts inside a page: widgets, underlined labels, check boxes
WIDGET, UNDERLINE, CHECKBOX = 0, 1, 2


def field_matches(text: Column) -> Column:
    """Fields written as ``label: ____`` or ``[x] label`` in one text, as an array."""
    underline = UNICODE + fv.UNDERLINE_FIELD
    # (?d): only a line feed ends a line
    checkbox = UNICODE + "(?d)" + fv.CHECKBOX_FIELD
    labels = F.transform(
        F.regexp_extract_all(text, F.lit(underline), F.lit(1)),
        lambda x, i: F.struct(
            F.lit(UNDERLINE).alias("part"),
            i.alias("pos"),
            strip(x).alias("field_name"),
            F.lit("text_underline").alias("field_type"),
            F.lit("").alias("field_value"),
            F.lit(None).cast("boolean").alias("checked"),
        ),
    )
    boxes = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(checkbox), F.lit(1)).alias("mark"),
            F.regexp_extract_all(text, F.lit(checkbox), F.lit(2)).alias("label"),
        ),
        lambda x, i: F.struct(
            F.lit(CHECKBOX).alias("part"),
            i.alias("pos"),
            strip(x["label"]).alias("field_name"),
            F.lit("checkbox_text").alias("field_type"),
            F.lit(None).cast("string").alias("field_value"),
            (F.lower(x["mark"]) == "x").alias("checked"),
        ),
    )
    # texts without an underline or a bracket skip the patterns
    return F.concat(
        F.coalesce(F.when(text.contains("___"), labels), F.array()),
        F.coalesce(F.when(text.contains("["), boxes), F.array()),
    )


def text_fields(pages: DataFrame) -> DataFrame:
    found = pages.select("doc_id", "page", F.explode(field_matches(F.col("text"))).alias("f"))
    return found.select("doc_id", "page", "f.*")


def form_fields(pages: DataFrame, widgets: DataFrame | None = None) -> DataFrame:
    """Widgets and text fields; (page, part, pos) is the field order of a document.

    ``widgets(doc_id, page, pos, field_name, field_type, field_value)``, and where the
    table has them ``options`` (array of string) and ``is_read_only``. Fields found in
    text are ``detected``; they have no options and can be written.
    """
    found = text_fields(pages).select(
        "*",
        F.lit(None).cast("array<string>").alias("options"),
        F.lit(False).alias("is_read_only"),
        F.lit(True).alias("detected"),
    )
    if widgets is None:
        return found
    options = F.col("options") if "options" in widgets.columns else F.lit(None).cast("array<string>")
    read_only = F.coalesce("is_read_only", F.lit(False)) if "is_read_only" in widgets.columns else F.lit(False)
    checked = F.when(F.col("field_type") == "checkbox", F.col("field_value") == "Yes")
    return widgets.select(
        "doc_id",
        "page",
        F.lit(WIDGET).alias("part"),
        "pos",
        F.coalesce("field_name", F.lit("")).alias("field_name"),
        "field_type",
        F.coalesce("field_value", F.lit("")).alias("field_value"),
        checked.alias("checked"),
        options.alias("options"),
        read_only.alias("is_read_only"),
        F.lit(False).alias("detected"),
    ).unionByName(found)


def form_data(fields: DataFrame) -> DataFrame:
    """Value of each named field per document (the last field of a name wins)."""
    value = F.coalesce("field_value", F.col("checked").cast("string"), F.lit(""))
    return (
        fields.where(F.col("field_name") != "")
        .groupBy("doc_id", "field_name")
        .agg(F.max_by(value, F.struct("page", "part", "pos")).alias("value"))
    )


def form_summary(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Whether each document has fields, and how many."""
    counts = fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("field_count"))
    return (
        docs.select("doc_id")
        .join(counts, "doc_id", "left")
        .na.fill(0, ["field_count"])
        .withColumn("has_forms", F.col("field_count") > 0)
    )


def fill_forms(widgets: DataFrame, updates: DataFrame) -> DataFrame:
    """Widgets with the values of ``updates(doc_id, field_name, value[, seq])`` where the name is equal; the last one holds."""
    given = updates.select("doc_id", "field_name", "value", command_order(updates).alias("_seq"))
    last = given.groupBy("doc_id", "field_name").agg(F.max_by("value", "_seq").alias("value"))
    return (
        widgets.join(last, ["doc_id", "field_name"], "left")
        .withColumn("filled", F.col("value").isNotNull())
        .withColumn("field_value", F.coalesce("value", "field_value"))
        .drop("value")
    )


def unknown_fields(widgets: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that name no widget of their document."""
    names = widgets.select("doc_id", "field_name")
    return updates.join(names, ["doc_id", "field_name"], "left_anti").withColumn(
        "error", F.concat(F.lit("Field '"), F.col("field_name"), F.lit("' not found"))
    )
