"""Entity extraction and key information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import UNICODE, all_matches, strip


def entity_matches(text: Column, types=None) -> Column:
    """All matches in one text as an array of (entity_type, value, pos)."""
    chosen = [t for t in fv.ENTITY_PATTERNS if types is None or t in types]

    def of(kind: str) -> Column:
        pattern = fv.ENTITY_PATTERNS[kind]
        found = F.transform(
            all_matches(text, pattern, fv.NEEDED_BY.get(pattern)),
            lambda x, i: F.struct(F.lit(kind).alias("entity_type"), strip(x).alias("value"), i.alias("pos")),
        )
        if kind == "phones":
            return F.filter(found, lambda x: F.length(x["value"]) >= fv.MIN_PHONE_CHARS)
        if kind == "people":
            return F.filter(found, lambda x: ~x["value"].rlike(UNICODE + fv.NOT_A_PERSON))
        return found

    return F.concat(*[of(kind) for kind in chosen])


def entities(pages: DataFrame, types=None) -> DataFrame:
    """Distinct entities per document with the page and position of their first occurrence.

    One pass of the patterns over each page, then a (doc, type, value)
    aggregation that Spark combines before the shuffle.
    """
    found = pages.select("doc_id", "page", F.explode(entity_matches(F.col("text"), types)).alias("e")).select(
        "doc_id", "e.entity_type", "e.value", "page", "e.pos"
    )
    return (
        found.groupBy("doc_id", "entity_type", "value")
        # page and position in one number keep the aggregation a hash aggregation
        .agg(F.min(F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("pos")).alias("at"))
        .select(
            "doc_id",
            "entity_type",
            "value",
            F.shiftright("at", 32).cast("int").alias("page"),
            F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"),
        )
    )


def key_info(pages: DataFrame) -> DataFrame:
    """Distinct entities without social security numbers, and how many each type has."""
    return entities(pages, fv.KEY_INFO_TYPES)


def key_info_counts(pages: DataFrame) -> DataFrame:
    """One row per document, one count column per entity type."""
    return (
        key_info(pages)
        .groupBy("doc_id")
        .agg(*[F.count_if(F.col("entity_type") == t).alias(t) for t in fv.KEY_INFO_TYPES])
    )


def extract_data_list(text: Column, kind: str) -> Column:
    """Distinct values of one kind in a document text, in order of appearance."""
    if kind not in fv.EXTRACT_PATTERNS:
        return F.array().cast("array<string>")
    pattern = fv.EXTRACT_PATTERNS[kind]
    found = all_matches(text, pattern, fv.NEEDED_BY[pattern])
    if kind == "phones":
        found = F.filter(F.transform(found, strip), lambda x: F.length(x) >= fv.MIN_PHONE_CHARS)
    return F.array_distinct(found)


def extract_data(docs: DataFrame, kind: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(extract_data_list(F.col("text"), kind)).alias("pos", "value"))


def extract_data_raw(df: DataFrame, col: str = "text") -> DataFrame:
    """All four kinds at once over any text column, neither distinct nor filtered."""
    return df.select("*", *[all_matches(F.col(col), p, fv.NEEDED_BY[p]).alias(k) for k, p in fv.EXTRACT_PATTERNS.items()])
