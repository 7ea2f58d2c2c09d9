"""Scans, document views and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.joins import join_per_key
from quire.functions.text import is_blank, strip
from quire.sources.store import Store


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``manifest(filename, n_bytes, mtime)`` of the files below ``path``.

    Only the metadata columns of the binary reader are kept, so Spark lists the
    files and reads none of them.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("filename"),
            F.col("length").alias("n_bytes"),
            F.col("modificationTime").alias("mtime"),
        )
    )


def ingest_validate(manifest: DataFrame, suffix: str = ".pdf", max_mb: int = fv.MAX_UPLOAD_MB) -> DataFrame:
    """Mark each upload accepted or rejected, with the first reason that applies."""
    named = F.coalesce(F.lower("filename").endswith(suffix), F.lit(False))
    reason = F.when(~named, "wrong_type").when(F.col("n_bytes") > max_mb * 1024 * 1024, "too_large")
    return (
        manifest.withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("safe_name", strip(F.substring_index("filename", "/", -1)))
    )


def valid_doc_ids(df: DataFrame, col: str = "doc_id") -> DataFrame:
    return df.where(F.col(col).rlike(fv.DOC_ID_PATTERN))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))


def doc_info(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per page with its geometry and the document's metadata and page count.

    The pages stay rows: a document with very many of them is never collected.
    """
    geometry = pages.select("doc_id", F.col("page").alias("index"), "width", "height", "rotation")
    return join_per_key(geometry, page_counts(pages).join(docs, "doc_id"), ["doc_id"])


def text_spans(spans: DataFrame, page: int | None = None) -> DataFrame:
    """Non-blank spans, of one page if given; an absent page gives no rows."""
    kept = spans if page is None else spans.where(F.col("page") == page)
    return kept.where(~is_blank(F.col("text")))


def doc_text(pages: DataFrame, sep: str = "\n", trailing: bool = False) -> DataFrame:
    """The text of each document as one value, pages in order.

    The result is by nature one cell per document; operators that can work on
    pages take pages instead.
    """
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    joined = F.array_join(F.transform(F.col("_p"), lambda p: p["text"]), sep)
    return (
        pages.groupBy("doc_id")
        .agg(ordered.alias("_p"))
        .select("doc_id", (F.concat(joined, F.lit(sep)) if trailing else joined).alias("text"))
    )


def page_lookup(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Text of the requested (doc_id, page), with a status for blank and absent pages."""
    found = pages.select("doc_id", "page", "text")
    return refs.join(found, ["doc_id", "page"], "left").withColumn(
        "status",
        F.when(F.col("text").isNull(), "out_of_range").when(is_blank(F.col("text")), "no_text").otherwise("ok"),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def pending(docs: DataFrame, analysis: DataFrame, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents without a stored analysis.

    With ``on=('doc_id', 'content_hash')`` a changed text counts as pending again.
    """
    return docs.join(analysis.select(*on), list(on), "left_anti")


def analyses(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The store of analyses by ``doc_id`` under ``path``."""
    return Store(spark, path, ["doc_id"], buckets)


def refresh(docs: DataFrame, path: str, analyse, buckets: int = 64) -> DataFrame:
    """Bring the stored analyses of ``docs(doc_id, text, ...)`` up to date and return them.

    Only documents whose text is not the one analysed last are analysed: ``analyse(docs) -> DataFrame`` keeps ``doc_id``
    and ``content_hash``. Its rows take the place of older ones, and analyses of documents that are no longer there go.
    Ids are unique; a document without an id is not stored.
    """
    store = analyses(docs.sparkSession, path, buckets)
    hashed = docs.where("doc_id is not null").withColumn("content_hash", content_hash(F.col("text")))
    stored = store.read()
    if stored is None:
        store.change(analyse(hashed))
    else:
        todo = pending(hashed, stored, ("doc_id", "content_hash"))
        store.change(analyse(todo), gone=stored.select("doc_id").join(hashed, "doc_id", "left_anti"))
    return store.read()


def delete_documents(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop every row of the listed documents; use it on each table that has the key."""
    return df.join(ids.select(key), key, "left_anti")
