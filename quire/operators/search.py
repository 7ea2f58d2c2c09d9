"""Search, replacement and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.joins import join_per_key
from quire.functions.text import UNICODE, literal_count, literal_pattern, quote, starts_of, strip, words


def term_counts(pages: DataFrame, term: str) -> DataFrame:
    """Occurrences of ``term`` (case ignored) per page with hits, and per document.

    The document total has a null ``page``. Pages without a hit are dropped
    before the roll-up, so the shuffle carries hits only.
    """
    n = literal_count(F.lower("text"), term.lower())
    hits = pages.select("doc_id", "page", n.alias("n")).where("n > 0")
    return (
        hits.rollup("doc_id", "page")
        .agg(F.sum("n").alias("occurrences"))
        .where(F.col("doc_id").isNotNull())
    )


def find_matches(spans: DataFrame, text: str, page: int | None = None, match_case: bool = False) -> DataFrame:
    """One row per match: its span, offset, and box cut from the span's by character share."""
    kept = spans if page is None else spans.where(F.col("page") == page)
    per_char = (F.col("x1") - F.col("x0")) / F.length("text")
    return (
        kept.where(F.col("text").rlike(literal_pattern(text, match_case)))
        .withColumn("start", F.explode(starts_of(F.col("text"), text, match_case)))
        .withColumn("match_x0", F.col("x0") + per_char * F.col("start"))
        .withColumn("match_x1", F.col("x0") + per_char * (F.col("start") + len(text)))
    )


def replaced_spans(spans: DataFrame, find: str, repl: str, scope: int | None = None) -> DataFrame:
    """All spans, with ``text`` replaced where it contains ``find`` (case matters) and a ``changed`` flag."""
    changed = F.col("text").contains(find)
    if scope is not None:
        changed = changed & (F.col("page") == scope)
    return spans.withColumn("changed", changed).withColumn(
        "text", F.when(F.col("changed"), F.replace("text", F.lit(find), F.lit(repl))).otherwise(F.col("text"))
    )


def replace_text(spans: DataFrame, find: str, repl: str, scope: int | None = None) -> DataFrame:
    """Per document and page, the number of spans a replacement changes (spans, not occurrences)."""
    changed = replaced_spans(spans, find, repl, scope).where("changed")
    return changed.groupBy("doc_id", (F.col("page") + 1).alias("page_number")).agg(
        F.count(F.lit(1)).alias("replaced")
    )


def delete_text(pages: DataFrame, text: str) -> DataFrame:
    """All pages without ``text`` (case ignored), and how often each page had it."""
    found = literal_pattern(text)
    return pages.withColumn("deleted", F.coalesce(F.regexp_count("text", F.lit(found)), F.lit(0))).withColumn(
        "text", F.when(F.col("deleted") > 0, F.regexp_replace("text", found, "")).otherwise(F.col("text"))
    )


def redact_pattern(pages: DataFrame, kind: str, mask: str = "") -> DataFrame:
    """All pages with every match of the pattern replaced by ``mask``, and the match count."""
    if kind not in fv.REDACT_PATTERNS:
        raise ValueError(f"unknown pattern type: {kind}")
    plain = fv.REDACT_PATTERNS[kind]
    pattern = UNICODE + plain
    literal_mask = mask.replace("\\", "\\\\").replace("$", "\\$")
    possible = F.col("text").rlike(fv.NEEDED_BY[plain])
    counted = pages.withColumn(
        "redacted", F.when(possible, F.regexp_count("text", F.lit(pattern))).otherwise(0)
    )
    changed = F.when(F.col("redacted") > 0, F.regexp_replace("text", pattern, literal_mask))
    return counted.withColumn("text", changed.otherwise(F.col("text")))


def query_words(question: Column) -> Column:
    return F.array_distinct(words(F.lower(question)))


def section_scores(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks joined to the queries of their document, with the share of query words they contain.

    ``queries(query_id, doc_id, question)``. A query word counts when it is a
    substring of the block text; blocks without any are dropped.
    """
    asked = queries.select("query_id", "doc_id", query_words(F.col("question")).alias("_words"))
    hits = F.size(F.filter("_words", lambda w: F.col("_hay").contains(w)))
    # lowered before the join, so once per block and not once per word
    lowered = blocks.withColumn("_hay", F.lower("text"))
    return (
        join_per_key(lowered, asked, ["doc_id"])
        .withColumn("_hits", hits)
        .where("_hits > 0")
        .withColumn("relevance", F.col("_hits") / F.size("_words"))
        .drop("_words", "_hits", "_hay")
    )


def section_search(blocks: DataFrame, queries: DataFrame, k: int = fv.SECTION_RESULTS) -> DataFrame:
    """The ``k`` best blocks per query, ties in page and block order."""
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("relevance"), "page", "block")
    return (
        section_scores(blocks, queries)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("text", F.substring(strip(F.col("text")), 1, 500))
    )


def routing_flags(question: Column) -> tuple[Column, Column]:
    """Whether a question asks for entities, and whether it asks for tables."""
    q = F.lower(question)
    return q.rlike(fv.ASKS_ENTITIES), q.rlike(fv.ASKS_TABLES)


def question_bundle(
    blocks: DataFrame,
    questions: DataFrame,
    lengths: DataFrame,
    entity_counts: DataFrame,
    table_counts: DataFrame,
) -> DataFrame:
    """Per question: routing flags, what they route to, text length and the best sections.

    ``lengths(doc_id, full_text_length, context_snippet)``,
    ``entity_counts(doc_id, n_entities)``, ``table_counts(doc_id, n_tables)``.
    One row per section; a question without any section keeps one row.
    """
    wants_entities, wants_tables = routing_flags(F.col("question"))
    sections = section_search(blocks, questions, fv.ANSWER_SECTIONS).select(
        "query_id", "doc_id", "rank", F.col("page").alias("section_page"), F.col("text").alias("section"), "relevance"
    )
    return (
        questions.withColumn("wants_entities", wants_entities)
        .withColumn("wants_tables", wants_tables)
        .join(lengths, "doc_id", "left")
        .join(entity_counts, "doc_id", "left")
        .join(table_counts, "doc_id", "left")
        .withColumn("n_entities", F.when(F.col("wants_entities"), F.coalesce("n_entities", F.lit(0))))
        .withColumn("n_tables", F.when(F.col("wants_tables") & (F.col("n_tables") > 0), F.col("n_tables")))
        .join(sections, ["query_id", "doc_id"], "left")
    )


def question_answers(questions: DataFrame, entities: DataFrame, tables: DataFrame) -> DataFrame:
    """What each question routes to, one row per answer: query_id, doc_id, kind, name, value.

    ``entities(doc_id, entity_type, value)`` answer questions that ask for
    entities, ``tables(doc_id, page, table_index, row_count)`` those that ask for tables.
    """
    wants_entities, wants_tables = routing_flags(F.col("question"))
    asked = questions.select("query_id", "doc_id", wants_entities.alias("_entities"), wants_tables.alias("_tables"))
    named = asked.where("_entities").join(entities, "doc_id")
    named = named.select("query_id", "doc_id", F.lit("entity").alias("kind"), F.col("entity_type").alias("name"), "value")
    place = F.format_string("page %d, table %d", F.col("page") + 1, F.col("table_index"))
    found = asked.where("_tables").join(tables, "doc_id")
    found = found.select(
        "query_id", "doc_id", F.lit("table").alias("kind"), place.alias("name"), F.col("row_count").cast("string").alias("value")
    )
    return named.unionByName(found)


def validate_replacement(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Check that the new text is in each edited region and does not run past it.

    ``edits(edit_id, doc_id, page, bx0, by0, bx1, by1, expected)``. The overlap
    test is a residual filter on an equi-join by (doc_id, page).
    """
    inside = (
        (F.col("x0") < F.col("bx1")) & (F.col("x1") > F.col("bx0")) & (F.col("y0") < F.col("by1")) & (F.col("y1") > F.col("by0"))
    )
    joined = edits.join(
        spans.select("doc_id", "page", "block", "line", "span", "text", "x0", "y0", "x1", "y1"),
        ["doc_id", "page"],
        "left",
    )
    piece = F.when(F.coalesce(inside, F.lit(False)), F.struct("block", "line", "span", "text"))
    too_wide = F.col("text").contains(F.col("expected")) & (F.col("x1") > F.col("bx1") + 2)
    found = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), "\n")
    checked = joined.groupBy("edit_id", "doc_id", "page", "expected").agg(
        strip(found).alias("extracted_text"), F.coalesce(F.max(too_wide), F.lit(False)).alias("_wide")
    )
    missing = ~F.col("extracted_text").contains(F.col("expected"))
    issues = F.array_compact(
        F.array(
            F.when(missing, "replacement_text_not_found_in_region"),
            F.when(F.col("_wide"), "text_extends_beyond_original_bounds"),
        )
    )
    return checked.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0).drop("_wide")
