"""Quality rules with an isolation forest over rule statistics.

Every text gets its rule statistics. Two plain rules fail a document outright
(too few words, too much repetition). Each further rule has a limit on a rate
(symbols, capitals, words without a letter, shouted words, words said twice
over, repeated passages); what a document has beyond each limit is its row. An
isolation forest finds the rows that are unlike the rest: a tree splits a sample
of rows by random features at random values, and a row that ends alone after few
splits is anomalous. The score is 2 ** (-mean path length / c), c being the mean
path of an unsuccessful search in a tree of the sample's size.

The cut on the score is the one that classes the labelled rows best, in the
middle of its range where several cuts do; with no labels, or labels of one kind
only, everything that passes the base rules is kept.

The forest is fitted on at most ``SAMPLE`` rows that pass the base rules, those
of the smallest id hash, as the method asks (each tree sees ``PER_TREE`` of
them); calibration uses all labelled rows, statistics and scores all rows.

Defined results: null or empty text has zero counts and fails; repeated rows are
scored alike; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, small_batches, text_of
from quire.llm.textstats import SCHEMA, statistics_batch
from quire.session import cut_lineage

TREES = 100
PER_TREE = 256
SAMPLE = 4096
BINS = 400
#: rule: (statistic, what it is a rate of, limit)
RULES = {
    "symbols": ("n_symbols", "n_words", 0.05),
    "capitals": ("n_upper", "n_letters", 0.1),
    "bare_words": ("n_bare_words", "n_words", 0.1),
    "marks": ("n_marks", "n_words", 0.05),
    "same_next": ("n_same_next", "n_words", 0.1),
    "repeats": ("n_repeat_words", "n_words", 0.3),
}


def features(stats: pd.DataFrame) -> np.ndarray:
    """What each rate has beyond its rule's limit, one column per rule."""
    columns = [
        np.maximum(stats[a].to_numpy(float) / np.maximum(stats[b].to_numpy(float), 1.0) - limit, 0.0)
        for a, b, limit in RULES.values()
    ]
    return np.stack(columns, axis=1)


def mean_path(n: float) -> float:
    """Mean path of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One isolation tree as arrays: feature (-1 at a leaf), value, left child (right is the next), path length."""
    feature, value, left, path = [-1], [0.0], [0], [0.0]
    todo = [(0, rows, 0)]
    while todo:
        node, part, depth = todo.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(open_):
            path[node] = depth + mean_path(len(part))
            continue
        k = int(rng.choice(open_))
        cut = rng.uniform(low[k], high[k])
        feature[node], value[node], left[node] = k, cut, len(feature)
        for child in (part[part[:, k] < cut], part[part[:, k] >= cut]):
            todo.append((len(feature), child, depth + 1))
            feature.append(-1)
            value.append(0.0)
            left.append(0)
            path.append(0.0)
    return {"feature": np.array(feature), "value": np.array(value), "left": np.array(left), "path": np.array(path)}


def fit(sample: np.ndarray, seed: int = 11) -> list[dict[str, np.ndarray]]:
    """``TREES`` trees, each over ``PER_TREE`` rows of the sample."""
    rng = np.random.default_rng(seed)
    size = min(PER_TREE, len(sample))
    limit = int(np.ceil(np.log2(max(size, 2))))
    return [grow(sample[rng.choice(len(sample), size, replace=False)], rng, limit) for _ in range(TREES if size else 0)]


def scores(forest: list[dict[str, np.ndarray]], rows: np.ndarray, size: int) -> np.ndarray:
    """Anomaly score of each row: near 1 isolated at once, below 0.5 ordinary."""
    total = np.zeros(len(rows))
    for tree in forest:
        node = np.zeros(len(rows), np.int64)
        while True:
            k = tree["feature"][node]
            inner = np.flatnonzero(k >= 0)
            if not len(inner):
                break
            go = tree["left"][node[inner]] + (rows[inner, k[inner]] >= tree["value"][node[inner]])
            node[inner] = go
        total += tree["path"][node]
    scale = mean_path(min(PER_TREE, size)) or 1.0
    return 2.0 ** (-(total / max(len(forest), 1)) / scale)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the rule statistics, base_failed, score (anomaly), kept."""
    small_batches(docs)
    stats = cut_lineage(map_texts(text_of(docs, key, text), ["doc_id"], "text", statistics_batch, SCHEMA))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    good = stats.where(~F.col("base_failed"))
    picked = good.withColumn("_at", F.xxhash64(F.col("doc_id"), F.lit(11))).orderBy("_at", "doc_id").limit(SAMPLE)
    sample = features(picked.toPandas())
    forest = fit(sample)
    size = len(sample)

    def score(batches):
        for pdf in batches:
            pdf["score"] = scores(forest, features(pdf), size)
            yield pdf

    names = [f for f in stats.columns if f not in ("doc_id", "base_failed")]
    # the id goes as text: beside a null, pandas would round a large number
    schema = "doc_id string, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double"
    scored = stats.select(F.col("doc_id").cast("string"), *names, "base_failed").mapInPandas(score, schema)
    scored = cut_lineage(scored.withColumn("doc_id", F.col("doc_id").cast("long")))
    cut = calibrate(scored, labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < cut))


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The score from which on a document is dropped.

    One histogram of ``BINS`` bins reaches the driver, whatever the size of the tables.
    """
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality is not null")
    counts = (
        scored.where(~F.col("base_failed"))
        .join(marks, "doc_id")
        .groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"))
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("n"))
        .toPandas()
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    good[counts["bin"].to_numpy(int)] = counts["good"].to_numpy(float)
    bad[counts["bin"].to_numpy(int)] = (counts["n"] - counts["good"]).to_numpy(float)
    if not good.any() or not bad.any():
        return 2.0
    # errors when everything from bin k on is dropped
    wrong = np.append(0.0, np.cumsum(bad)) + np.append(np.cumsum(good[::-1])[::-1], 0.0)
    best = np.flatnonzero(wrong == wrong.min())
    run = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]
    return float(run[len(run) // 2]) / BINS
