"""The pipeline's stages against brute force, and rows without ids."""

import hashlib

import public_tokenizers
from llm_rows import docs  # noqa: F401
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_repeats, normal

import corpus_pipeline
from quire.llm import bpe, contexttree, discriminant, forest, logtree, minhash, naming, packing, suffixes
from quire.llm.queries import tokenizer_file
from quire.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs_.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "repeated_passages", "packing"]

    def texts(df):
        return dict(df.select("doc_id", "text").collect())

    good = cut_lineage(stages["quality_classifier"](spark, docs_, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    left, before = texts(good), texts(docs_)
    assert left.items() <= before.items()
    wrong = [r for r in labels if r["doc_id"] in before and (r["doc_id"] in left) != (r["quality"] == 1)]
    assert len(wrong) <= 0.05 * len(labels)

    one = cut_lineage(stages["exact_dedup"](spark, good, SF))
    heads = {}
    for i, t in left.items():
        heads.setdefault(normal(t), []).append((-len(t), i))
    assert set(texts(one)) == {min(group)[1] for group in heads.values()}

    near = cut_lineage(stages["near_dedup"](spark, one, SF))
    ids = sorted(texts(one))
    groups = brute_components([left[i] for i in ids])
    assert set(texts(near)) == {ids[k] for k, (_, _, kept) in groups.items() if kept}

    cut = cut_lineage(stages["repeated_passages"](spark, near, SF))
    ids = sorted(texts(near))
    want = brute_repeats([left[i] for i in ids], 200)
    sizes = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    for k, (_, removed, _, sha) in want.items():
        text, n = sizes[ids[k]]
        assert n == len(text)
        assert removed == 0 or hashlib.sha256(text.encode()).hexdigest() == sha or len(text.encode()) >= len(left[ids[k]].encode()) - removed - 8
        assert removed > 0 or text == left[ids[k]]
    assert all(df.columns == columns for df in (good, one, near, cut))

    packed = stages["packing"](spark, cut, SF).collect()
    assert {r["doc_id"] for r in packed} == set(sizes)


def test_nulls_and_repeated_rows_pass_through(docs, spark):
    rows = docs((1, None), (1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two")).withColumn("kept", F.lit(True))
    exact = corpus_pipeline.exact(spark, rows, SF)
    assert sorted(r["doc_id"] for r in exact.collect()) == [1, 3]
    assert exact.columns == rows.columns
    near = corpus_pipeline.near(spark, rows, SF)
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 1, 2, 3, 3]
    cut = corpus_pipeline.passages(spark, rows, SF)
    assert sorted(map(repr, cut.select("doc_id", "text").collect())) == sorted(map(repr, rows.select("doc_id", "text").collect()))


def test_rows_without_ids(docs, spark):
    table = docs((None, "some words that stand alone here"), (2**60 + 1, "some words that stand alone here"), (None, None)).coalesce(1)
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    made = [
        minhash.near_duplicates(table),
        naming.exact_duplicates(table),
        suffixes.digests(table),
        logtree.digests(table),
        forest.quality_rules(table, labels),
        discriminant.quality_scores(table, labels),
        bpe.digests(table, path, public_tokenizers.PATTERN),
        packing.pack(table, tokenizer_file("word_bpe_49k.json")),
        contexttree.score(table),
    ]
    for df in made:
        got = [r["doc_id"] for r in df.collect()]
        assert len(got) == 3 and got.count(None) == 2 and 2**60 + 1 in got, df.columns


def test_clean_rows_without_ids_stay(docs, spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id")
    texts = [r["text"] for r in given.orderBy("doc_id").limit(40).collect()]
    texts = [t for k, t in enumerate(texts) if t not in texts[:k]]
    rows = docs(*[(None if k % 2 else k, t) for k, t in enumerate(texts)])
    good = corpus_pipeline.quality(spark, rows, SF).collect()
    assert sum(r["doc_id"] is None for r in good) >= 0.8 * len(texts) // 2
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        left = stage(spark, docs((None, "alpha beta gamma delta"), (1, "one two three four"), (1, "five six seven eight nine")), SF)
        assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == ["1", "1", "None"]


def test_empty_table_and_very_long_text(docs, spark):
    none, long = docs("x").where("false"), docs((1, "word " * 60000), (2, "other text"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    assert corpus_pipeline.exact(spark, long, SF).count() == 2 and corpus_pipeline.near(spark, long, SF).count() == 2
