"""The corpus pipeline: poor documents, exact copies, near copies and repeated passages go; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet and hands it to the next one as docs. All stages but the last return
the columns of ``documents``.

Defined results: null text counts as empty throughout, and passes a filter as
the operators say; rows are found again by id and text, so rows without an id are
rows like any other; of exact copies exactly one row stays, one with an id before
one without; rows of one id and text stay or go together in the other stages;
where repeated bytes end inside a character, its other bytes go with them; a
document that is repeated bytes only stays with empty text; very long texts are
rows like any other; an empty table gives no rows; columns of other names are
carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import discriminant, minhash, naming, packing, suffixes
from quire.llm.queries import tokenizer_file
from quire.session import cut_lineage


ID, PRINT = "_corpus_id", "_corpus_print"
NO_ID = -(2**63)  # stands for a null id, which a join would not find


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with the id and the text's print by which its rows are found again; nothing is written for it."""
    return docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        PRINT, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    )


def _chosen(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in ``kept``, which is written first so that both sides are plain.

    The keys grow with the documents, so the join is a sorted one at any size.
    """
    return docs.join(cut_lineage(kept.select(*keys).distinct()).hint("merge"), keys, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A score depends on the text alone, so rows of one id and text stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = discriminant.quality_scores(_named(docs), labels, row=PRINT).where("predicted = 1")
    return _chosen(_named(docs), _ided(scored), [ID, PRINT]).select(*docs.columns)


def _ided(found: DataFrame) -> DataFrame:
    return found.withColumn(ID, F.coalesce("doc_id", F.lit(NO_ID)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = naming.exact_duplicates(_named(docs), keep=(PRINT,)).where("kept")
    return _chosen(_named(docs), _ided(kept), [ID, PRINT]).dropDuplicates([ID, PRINT]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays; a row without an id has its text's print, above all ids, for one."""
    beyond = F.col(PRINT).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    rows = _named(docs).withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), beyond))
    kept = minhash.near_duplicates(rows, key=ID).where("kept").select(F.col("doc_id").alias(ID))
    return _chosen(rows, kept, [ID]).select(*docs.columns)


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [k.decode("utf-8", "ignore") for k in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                ID: batch.column(0),
                PRINT: batch.column(1),
                "_text": pa.array(texts, pa.string()),
                "_size": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a row without any keeps its text as it is, null included."""
    cut = suffixes.without_repeats(docs, with_print=True).where("n_removed > 0")
    cut = _ided(cut).select(ID, F.col("print").alias(PRINT), "kept")
    cut = cut_lineage(cut.mapInArrow(_whole_characters, f"{ID} long, {PRINT} long, _text string, _size long"))
    joined = _named(docs).join(cut.dropDuplicates([ID, PRINT]), [ID, PRINT], "left")
    changed = {"text": F.coalesce("_text", "text"), "n_chars": F.coalesce("_size", "n_chars")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("repeated_passages", passages),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
