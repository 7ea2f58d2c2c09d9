"""Quality classifier: regularised quadratic discriminant over document statistics.

Rates of a document's statistics are transformed so that they spread (an arc
sine of the root for shares, a logarithm for sizes). Each class gets its mean
and a covariance shrunk in two steps, towards the covariance of both classes and
towards a round one; its Cholesky factor and log determinant are kept with the
model. A score is the logistic of the difference of the two Gaussian log
densities, with the Mahalanobis distances from triangular solves, plus the log
prior ratio.

The fit needs only counts, sums and sums of products per class, which every task
makes for its own rows; all labelled rows outside the held-out part count, and
what reaches the driver has the size of one matrix per class.

Defined results: null or empty text has zero statistics and gets a score like
any row; labels other than 0 and 1, or null, are not learned from; repeated rows
and repeated labels count as often as they stand; with labels of one class only
every score is that class's (1.0 or 0.0), with none 0.5; an empty table gives no
rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_remainder, map_texts, small_batches
from quire.llm.textstats import NAMES, SCHEMA, statistics_batch
from quire.session import cut_lineage

POOLED = 0.1  # share of the covariance of both classes in a class's own
ROUND = 0.05  # share of the round covariance of the same mean variance
THRESHOLD = 0.7


def features(stats: pd.DataFrame) -> np.ndarray:
    # a few neutral words and letters are added, so that a short text has no extreme rate
    words = stats["n_words"].to_numpy(float) + 10.0
    letters = stats["n_letters"].to_numpy(float) + 50.0

    def share(x, of):
        return np.arcsin(np.sqrt(np.clip(np.asarray(x, float) / of, 0.0, 1.0)))

    columns = [
        share(stats["n_symbols"], 4.0 * words),
        share(stats["n_upper"], letters),
        share(stats["n_bare_words"], words),
        share(stats["n_marks"], 2.0 * words),
        share(stats["n_same_next"], words),
        share(stats["n_repeat_words"], words),
        np.log1p((np.asarray(stats["word_chars"], float) + 50.0) / words),
    ]
    return np.stack(columns, axis=1)


class Discriminant:
    """The fitted model: per class a log prior, a mean, a Cholesky factor and half its log determinant."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.counts = counts
        if not (counts > 1).all():
            return
        p = sums.shape[1]
        means = sums / counts[:, None]
        within = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = within.sum(axis=0) / counts.sum()
        self.means, self.factors, self.halves = means, [], []
        self.priors = np.log(counts / counts.sum())
        for k in range(2):
            cov = (1.0 - POOLED) * within[k] / counts[k] + POOLED * pooled
            cov = (1.0 - ROUND) * cov + ROUND * (np.trace(cov) / p + 1e-9) * np.eye(p)
            factor = np.linalg.cholesky(cov)
            self.factors.append(factor)
            self.halves.append(float(np.log(np.diag(factor)).sum()))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not (self.counts > 1).all():
            total = self.counts.sum()
            return np.full(len(rows), 0.5 if total == 0 else float(self.counts[1] > self.counts[0]))
        logs = []
        for k in range(2):
            z = np.linalg.solve(self.factors[k], (rows - self.means[k]).T)
            logs.append(self.priors[k] - self.halves[k] - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700.0, 700.0)))


def fit(labelled: DataFrame) -> Discriminant:
    """``labelled``: the statistics and ``quality`` (0 or 1)."""

    def sums(batches):
        for pdf in batches:
            x, y = features(pdf), pdf["quality"].to_numpy(int)
            for k in (0, 1):
                rows = x[y == k]
                flat = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                yield pd.DataFrame({"label": k, "at": np.arange(len(flat)), "value": flat})

    parts = labelled.select(*NAMES, "quality").mapInPandas(sums, "label int, at int, value double")
    total = parts.groupBy("label", "at").agg(F.sum("value").alias("value")).toPandas()
    p = features(pd.DataFrame({n: [0.0] for n in NAMES})).shape[1]
    flat = np.zeros((2, 1 + p + p * p))
    flat[total["label"], total["at"]] = total["value"]
    return Discriminant(flat[:, 0], flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the number in column ``row`` if one is named."""
    small_batches(docs)
    number = F.lit(None) if row is None else F.col(row)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), number.cast("long").alias("row"), F.col(text).cast("string").alias("text"))

    def statistics(rows, data, at):
        return {"row": rows["row"]} | statistics_batch(rows, data, at)

    stats = cut_lineage(map_texts(texts, ["doc_id", "row"], "text", statistics, f"row long, {SCHEMA}"))
    stats = stats.withColumn("held_out", F.coalesce(held_remainder("doc_id", 4) == 2, F.lit(False)))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1)")
    model = fit(stats.where(~F.col("held_out")).join(marks, "doc_id"))

    def score(batches):
        for pdf in batches:
            s = model.score(features(pdf))
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "row": pdf["row"],
                    "held_out": pdf["held_out"],
                    "score": s,
                    "predicted": (s >= THRESHOLD).astype("int32"),
                }
            )

    # the numbers go as text: beside a null, pandas would round a large one
    schema = "doc_id string, row string, held_out boolean, score double, predicted int"
    as_text = [F.col(c).cast("string").alias(c) for c in ("doc_id", "row")]
    scored = stats.select(*as_text, "held_out", *NAMES).mapInPandas(score, schema)
    scored = scored.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "row")})
    return scored.drop("row") if row is None else scored.withColumnRenamed("row", row)
