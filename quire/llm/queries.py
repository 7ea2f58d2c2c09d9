"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import alignment, bpe, contexttree, discriminant, forest, logtree, minhash, naming, packing, periods, sharding, suffixes, template

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return forest.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return suffixes.digests(documents(spark, sf_dir))


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    return template.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    return discriminant.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


@query(
    "op8_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS size,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    g AS (
        SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size
        FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
)
def op8_exact_dedup(spark, sf_dir):
    return naming.exact_duplicates(documents(spark, sf_dir))


@query("op9_line_dedup", logtree.ORACLE)
def op9_line_dedup(spark, sf_dir):
    return logtree.digests(documents(spark, sf_dir))


@query("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    return contexttree.score(documents(spark, sf_dir))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return periods.digests(documents(spark, sf_dir))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.digests(documents(spark, sf_dir), *files, public_tokenizers.PATTERN)


@query("op13_sharding")
def op13_sharding(spark, sf_dir):
    return sharding.balanced_shards(documents(spark, sf_dir))
