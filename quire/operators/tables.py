"""Extracted tables: from cells to keyed rows, sums, look-ups and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.joins import join_per_key

TABLE = ["doc_id", "page", "table_index"]


def _filled(c: Column, default) -> Column:
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def tables_from_cells(cells: DataFrame) -> DataFrame:
    """``cells(doc_id, page, table_index, r, c, cell)`` to one row per body row.

    Row 0 names the columns (``col_i`` where it is empty). Result columns:
    the table key, ``r``, ``headers`` and ``pairs`` (key, value in cell order).
    A header belongs to its column number, and a column without one is ``col_i``. A
    row is gathered from its own cells only, so a table of any length spreads over
    the tasks. Tables without a body give nothing.

    Headers are as many as tables, so they are not broadcast, and rows are not sorted for the join: each task hashes the
    headers of its share.
    """
    rows = cells.groupBy(*TABLE, "r").agg(F.sort_array(F.collect_list(F.struct("c", "cell"))).alias("row"))
    header = rows.where("r = 0").select(
        *TABLE,
        F.transform(
            F.sequence(F.lit(0), F.array_max("row")["c"]),
            lambda i: _filled(
                F.get(F.filter("row", lambda x: x["c"] == i), F.lit(0))["cell"], F.concat(F.lit("col_"), i.cast("string"))
            ),
        ).alias("headers"),
    )
    named = F.transform(
        "row",
        lambda x: F.struct(
            F.coalesce(
                F.get(F.col("headers"), x["c"]), F.concat(F.lit("col_"), x["c"].cast("string"))
            ).alias("key"),
            F.coalesce(x["cell"], F.lit("")).alias("value"),
            x["c"].alias("c"),
        ),
    )
    return join_per_key(rows.where("r > 0"), header.hint("shuffle_hash"), TABLE).select(*TABLE, "r", "headers", named.alias("pairs"))


def _last_value(pairs: Column, key: Column) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def table_values(tables: DataFrame) -> DataFrame:
    """Long form: one row per (table, r, key); the last cell of a key wins."""
    keys = F.array_distinct(F.transform("pairs", lambda p: p["key"]))
    return tables.select(*TABLE, "r", F.col("pairs"), F.explode(keys).alias("key")).select(
        *TABLE, "r", "key", _last_value(F.col("pairs"), F.col("key")).alias("value")
    )


def _first_headers(tables: DataFrame) -> DataFrame:
    """``headers`` of each table's first row, and its ``row_count``; equal headers are folded by hash, without a sort of all rows."""
    alike = tables.groupBy(*TABLE, "headers").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n"))
    return alike.groupBy(*TABLE).agg(F.sum("n").cast("int").alias("row_count"), F.min_by("headers", "r").alias("headers"))


def tables_csv(tables: DataFrame, page: int | None = None) -> DataFrame:
    """CSV lines (r = -1 comment, 0 header, then the body), every field quoted."""
    chosen = tables if page is None else tables.where(F.col("page") == page)

    def quoted(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ",")

    body = F.transform(
        "headers", lambda h: F.coalesce(_last_value(F.col("pairs"), h), F.lit(""))
    )
    comment = F.format_string(
        "# Table on page %d (index %d)", F.col("page") + 1, F.col("table_index")
    )
    # comment and header are emitted once per table, with the headers of its first body row
    first = _first_headers(chosen)
    top = first.select(
        *TABLE,
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("r"), comment.alias("line")),
                F.struct(F.lit(0).alias("r"), quoted(F.col("headers")).alias("line")),
            )
        ).alias("x"),
    ).select(*TABLE, "x.r", "x.line")
    return top.unionByName(chosen.select(*TABLE, "r", quoted(body).alias("line")))


def write_csv(lines: DataFrame, path: str) -> None:
    """Write CSV lines as text files, each table whole and in order inside one file."""
    (
        lines.repartitionByRange("doc_id", "page", "table_index")
        .sortWithinPartitions("doc_id", "page", "table_index", "r")
        .select(F.col("line").alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def table_catalog(tables: DataFrame) -> DataFrame:
    """One row per table with its size and headers."""
    return _first_headers(tables).select(
        *TABLE,
        (F.col("page") + 1).alias("page_number"),
        "row_count",
        F.size("headers").alias("col_count"),
        F.array_join("headers", "|").alias("headers"),
    )


def table_column_sum(tables: DataFrame, target: str) -> DataFrame:
    """Per document, the sum of the first column whose header contains ``target``.

    First means table order, then column order, among columns with at least one
    number once currency signs, commas and per cent are dropped.
    """
    cols = F.filter(
        F.transform("headers", lambda h, i: F.struct(i.alias("c"), h.alias("header"))),
        lambda x: F.lower(x["header"]).contains(target.lower()),
    )
    picked = tables.select(*TABLE, "pairs", F.explode(cols).alias("x")).select(
        *TABLE,
        F.col("x.c").alias("c"),
        F.col("x.header").alias("header"),
        _last_value(F.col("pairs"), F.col("x.header")).alias("value"),
    )
    cleaned = F.btrim(F.translate("value", fv.CURRENCY_CHARS, ""), F.lit(fv.WHITESPACE))
    numbers = picked.withColumn("number", cleaned.try_cast("double"))
    sums = (
        numbers.where(F.col("number").isNotNull())
        .groupBy(*TABLE, "c", "header")
        .agg(F.sum("number").alias("total"), F.count(F.lit(1)).alias("n_values"))
    )
    at = F.struct("page", "table_index", "c")
    return (
        sums.groupBy("doc_id")
        .agg(F.min_by(F.struct("header", "total", "n_values", "page"), at).alias("x"))
        .select(
            "doc_id",
            F.col("x.header").alias("header"),
            F.round("x.total", 2).alias("total"),
            F.col("x.n_values").alias("n_values"),
            (F.col("x.page") + 1).alias("page_number"),
        )
    )


def table_lookup(tables: DataFrame, query: str) -> DataFrame:
    """Per document, the first row with a key or value that contains ``query``."""
    needle = query.lower()
    hit = F.exists(
        "pairs", lambda p: F.lower(p["key"]).contains(needle) | F.lower(p["value"]).contains(needle)
    )
    shown = F.array_join(F.transform("pairs", lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; ")
    return (
        tables.where(hit)
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("page", "table_index", "r", shown.alias("row")), F.struct("page", "table_index", "r")).alias("x"))
        .select("doc_id", (F.col("x.page") + 1).alias("page_number"), "x.table_index", "x.r", "x.row")
    )
