"""The full analysis of a document, from as few passes as its parts allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import word_count
from quire.operators.entities import entity_matches
from quire.operators.forms import field_matches
from quire.operators.language import language_of, language_words
from quire.operators.layout import avg_font_size, headings
from quire.operators.tables import TABLE, tables_from_cells
from quire.operators.topics import summary, top_topic_of
from quire.sources.corpus import page_texts


def profile(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What ``docs(doc_id, text)`` tells on its own, without a shuffle; the columns ``keep`` come along.

    A document is one row, so counts, summary, entities and form fields are
    worked out inside the row, page by page. Its words are found once, for topic
    and language.
    """
    text, words = F.col("text"), F.col("_words")
    pages = docs.select("doc_id", *keep, "text", page_texts(text).alias("_pages"), language_words(text).alias("_words"))
    found = F.flatten(F.transform("_pages", lambda p: entity_matches(p)))
    # as strings they are told apart by hash, as structs each by each
    distinct = F.array_distinct(F.transform(found, lambda e: F.concat(e["entity_type"], F.lit(":"), e["value"])))
    fields = F.aggregate("_pages", F.lit(0), lambda acc, p: acc + F.size(field_matches(p)))
    return pages.select(
        "doc_id",
        *keep,
        F.size("_pages").alias("page_count"),
        (F.length("text") + 1).alias("character_count"),
        word_count(text).alias("word_count"),
        summary(text, "analysis").alias("summary"),
        F.size(distinct).alias("entity_count"),
        fields.alias("form_field_count"),
        top_topic_of(text, words=words).alias("top_topic"),
        language_of(text, words).alias("_language"),
    ).select("*", "_language.*").drop("_language")


def full_analysis(docs: DataFrame, spans: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One row per document: counts, language, top topic, summary, entities, forms, headings, tables."""
    out = profile(docs)
    if spans is not None:
        levels = headings(spans).groupBy("doc_id").agg(F.count(F.lit(1)).alias("heading_count"))
        sizes = avg_font_size(spans).withColumn("avg_size", F.round("avg_size", 1))
        out = out.join(sizes, "doc_id", "left").join(levels, "doc_id", "left").na.fill(0, ["heading_count"])
    if cells is not None:
        tables = tables_from_cells(cells).select(*TABLE).distinct()
        counts = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("table_count"))
        out = out.join(counts, "doc_id", "left").na.fill(0, ["table_count"])
    return out
