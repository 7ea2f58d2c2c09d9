"""Page-set operations: rotate, delete, reorder, move, split and merge.

New page numbers come from arithmetic on counts and ranges and from equi-joins,
never from ranking all pages of a document in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.joins import join_per_key
from quire.functions.ranking import running_sum
from quire.operators.ingest import page_counts


def command_order(commands: DataFrame) -> Column:
    """The order commands were given in: their ``seq``, or their place in the table."""
    return F.col("seq").cast("long") if "seq" in commands.columns else F.monotonically_increasing_id()


def rotate_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``edits(doc_id, page, new_rotation[, seq])`` in order; a null rotation turns by another 90 degrees.

    Of several edits of a page the last given rotation holds, and the turns after it add up.
    """
    at = ["doc_id", "page"]
    given = edits.select(*at, "new_rotation", command_order(edits).alias("_seq"))
    last = F.max(F.when(F.col("new_rotation").isNotNull(), F.struct("_seq", "new_rotation"))).alias("_set")
    known = given.join(given.groupBy(*at).agg(last), at)
    after = F.col("new_rotation").isNull() & (F.col("_set").isNull() | (F.col("_seq") > F.col("_set._seq")))
    wanted = known.groupBy(*at).agg(
        F.first("_set").getField("new_rotation").alias("_to"), F.sum(F.when(after, 1).otherwise(0)).alias("_turns")
    )
    turned = F.when(F.col("_turns") > 0, F.pmod(F.coalesce("_to", "rotation") + F.col("_turns") * 90, F.lit(360))).otherwise(
        F.coalesce("_to", "rotation")
    )
    return pages.join(wanted, at, "left").withColumn("rotation", turned.cast("int")).drop("_to", "_turns")


def invalid_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that name a page their document does not have."""
    return edits.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def _range_status(start: Column, end: Column, total: Column) -> Column:
    return F.when(total.isNull() | (start < 0) | (end >= total) | (start > end), "invalid_range")


def deletion_status(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges(doc_id, start, end)`` with the verdict on each."""
    start, end, total = F.col("start"), F.col("end"), F.col("page_count")
    return ranges.join(page_counts(pages), "doc_id", "left").withColumn(
        "status",
        F.coalesce(
            _range_status(start, end, total),
            F.when(end - start + 1 >= total, "would_delete_all"),
            F.lit("ok"),
        ),
    )


def delete_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages left after deleting inclusive ranges, renumbered.

    Ranges of one document count together, overlaps once. A range that is invalid
    or would leave nothing changes nothing; nor do ranges that together would.
    """
    good = deletion_status(pages, ranges).where("status = 'ok'")
    gone = good.select("doc_id", "page_count", F.explode(F.sequence("start", "end")).alias("gone")).distinct()
    gone = gone.groupBy("doc_id").agg(F.first("page_count").alias("_n"), F.sort_array(F.collect_list("gone")).alias("_gone"))
    gone = gone.where(F.size("_gone") < F.col("_n")).drop("_n")
    page, listed = F.col("page"), F.coalesce("_gone", F.array().cast("array<int>"))
    return (
        join_per_key(pages, gone, ["doc_id"], "left")
        .where(~F.array_contains(listed, page))
        .withColumn("page", page - F.size(F.filter(listed, lambda g: g < page)))
        .drop("_gone")
    )


def order_status(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders(doc_id, page_order)`` with whether each is a permutation of the document's pages."""
    n = F.col("page_count")
    full = F.sort_array("page_order") == F.sequence(F.lit(0), n - 1)
    return orders.join(page_counts(pages), "doc_id", "left").withColumn(
        "status", F.when(n.isNotNull() & (F.size("page_order") == n) & full, "ok").otherwise("invalid_order")
    )


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Put page ``order[i]`` at position i; documents with an invalid order stay as they are."""
    places = (
        order_status(pages, orders)
        .where("status = 'ok'")
        .select("doc_id", F.posexplode("page_order").alias("_to", "page"))
    )
    return (
        pages.join(places, ["doc_id", "page"], "left")
        .withColumn("page", F.coalesce("_to", "page"))
        .drop("_to")
    )


def move_page(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Take page ``src`` out and put it back at ``dst``, per ``moves(doc_id, src, dst)``."""
    counted = moves.join(page_counts(pages), "doc_id")
    inside = F.col("src").between(0, F.col("page_count") - 1) & F.col("dst").between(0, F.col("page_count") - 1)
    page, src, dst = F.col("page"), F.col("src"), F.col("dst")
    moved = (
        F.when(page == src, dst)
        .when((src < dst) & (page > src) & (page <= dst), page - 1)
        .when((src > dst) & (page >= dst) & (page < src), page + 1)
        .otherwise(page)
    )
    return (
        join_per_key(pages, counted.where(inside).select("doc_id", "src", "dst"), ["doc_id"], "left")
        .withColumn("page", F.when(src.isNull(), page).otherwise(moved))
        .drop("src", "dst")
    )


def range_doc_id(doc_id: Column, start: Column, end: Column) -> Column:
    """Id of the document made from a range: the same input always gives the same id."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), start.cast("string"), end.cast("string")))


def split_status(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    return ranges.join(page_counts(pages), "doc_id", "left").withColumn(
        "status", F.coalesce(_range_status(F.col("start"), F.col("end"), F.col("page_count")), F.lit("ok"))
    )


def split_documents(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """One new document per valid ``ranges(doc_id, start, end)``; ranges may overlap.

    Ranges are spelled out into their pages (exactly the result's rows) and
    joined by (doc_id, page), so no page is compared with every range.
    """
    good = split_status(pages, ranges).where("status = 'ok'")
    wanted = good.select(
        "doc_id",
        "start",
        range_doc_id(F.col("doc_id"), F.col("start"), F.col("end")).alias("new_doc_id"),
        F.explode(F.sequence("start", "end")).alias("page"),
    )
    return (
        pages.join(wanted, ["doc_id", "page"])
        .withColumn("source_doc_id", F.col("doc_id"))
        .withColumn("page", F.col("page") - F.col("start"))
        .drop("start", "doc_id")
    )


def merge_documents(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """Pages of ``plans(doc_id, doc_ids)``: the document's own, then the listed ones in order.

    Each part's first page number is the running sum of the page counts before it.
    """
    parts = plans.select(
        F.col("doc_id").alias("merged_id"),
        F.posexplode(F.concat(F.array("doc_id"), F.col("doc_ids"))).alias("seq", "doc_id"),
    )
    sized = parts.join(page_counts(pages), "doc_id")
    placed = running_sum(sized, ["merged_id"], "seq", F.col("page_count"), "part_start")
    return (
        join_per_key(pages, placed.select("merged_id", "doc_id", "part_start"), ["doc_id"])
        .withColumn("source_doc_id", F.col("doc_id"))
        .withColumn("page", (F.col("page") + F.col("part_start")).cast("int"))
        .drop("part_start", "doc_id")
    )
