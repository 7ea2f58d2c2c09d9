"""Language-model scores by context-tree weighting, beside a unigram base.

Model. A text, with A-Z in lower case, is its bytes and one end symbol. Every
byte is eight binary choices; a choice is seen under the ``DEPTH`` bytes before
it, the last ``DEPTH - 1``, and so on down to none. Each such node keeps how often
0 and 1 followed, with the Krichevsky-Trofimov estimate over them, and weights
between stopping there and trusting the nodes of one byte more of context:
log Pw = log(1/2 Pkt + 1/2 product of the Pw below). The counts are additive and
Pw needs only the sums of the level below, so the whole tree is ``DEPTH`` + 1
aggregations by node, over all training text. A prediction goes down the
contexts of a choice and mixes the estimates of all depths by these weights.

The table of grams holds every distinct gram (a symbol and the ``DEPTH`` before it)
of the texts to be scored, those of held-out texts with count 0: these change no
weight, and at a node without symbols the mixture ends with the estimate of the node
above, so all predictions sum to one. One pass down the whole tree gives every gram
its probability; the table grows with the corpus and no node is left out. Grams
with at least ``GRAM_SHARE`` of all symbols, so at most 1 / GRAM_SHARE of them
(34 MB), are sent to the tasks; all others meet their probabilities in a join.

The base is the add-0.1 unigram of words and one end per text. Words with at
least ``WORD_SHARE`` of the training tokens, so at most 1 / WORD_SHARE of them,
go to the tasks; all others meet their counts in a join.

Defined results: null is empty and has the end only; with no training rows the
base is that of an empty table (N = V = 0) and every choice has probability 1/2;
repeated rows are scored alike; an empty table gives no rows; other columns are
neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import (
    LOWER,
    column_bytes,
    held_remainder,
    prefix_hash,
    slices,
    small_batches,
    span_hash,
    text_of,
    word_spans,
)
from quire.session import cut_lineage

DEPTH = 4
GRAM_SHARE = 2.0**-21
WORD_SHARE = 2.0**-17
END = 0xFF  # no byte of UTF-8; also stands before a text begins
HELD = 1 << 21  # distinct keys a task gathers before it passes them on


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the ``DEPTH`` symbols before it as one number, text after text, and where texts begin."""
    n, pad = len(at) - 1, DEPTH + 1
    doc = np.repeat(np.arange(n), np.diff(at))
    flat = np.full(len(data) + n * pad, END, np.uint8)
    flat[np.arange(len(data)) + doc * pad + DEPTH] = LOWER[data]
    out = np.zeros(len(flat) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | flat[k : len(flat) - DEPTH + k]
    # a text's numbers begin where its padding ends; the next DEPTH would run into the padding after it
    starts = at[:-1] + np.arange(n) * pad
    keep = np.ones(len(out), bool)
    for k in range(1, DEPTH + 1):
        bad = starts[1:] - k
        keep[bad] = False
    return out[keep], at[:-1] + np.arange(n)


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batches):
    """(kind, key, n, seen) of texts (held_out, text): 0 words by hash, 1 grams, 2 texts; combined within the task.

    ``n`` counts training texts, ``seen`` all; words and texts are those of training only.
    """
    held = {(0, True): [], (1, True): [], (1, False): []}
    texts = 0

    def passed(kind, train):
        parts = held[kind, train]
        keys, counts = _add(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        held[kind, train] = []
        counts = counts.astype(np.int64)
        return pa.RecordBatch.from_pydict(
            {"kind": np.full(len(keys), kind, np.int32), "key": keys.view(np.int64), "n": counts * train, "seen": counts}
        )

    for batch in batches:
        out = batch.column(0)
        for train, mine in ((True, batch.filter(pc.invert(out))), (False, batch.filter(out))):
            if not mine.num_rows:
                continue
            data, at = column_bytes(mine.column(1))
            texts += (len(at) - 1) * train
            for i, j in slices(at):
                part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
                found = {1: grams(part, bounds)[0]}
                if train:
                    low = LOWER[part]
                    start, end, _ = word_spans(low, bounds)
                    found[0] = span_hash(prefix_hash(low), start, end)
                for kind, keys in found.items():
                    held[kind, train].append(np.unique(keys, return_counts=True))
                    parts = held[kind, train]
                    if sum(len(k) for k, _ in parts) > HELD:
                        keys, counts = _add(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                        held[kind, train] = [(keys, counts)]
                        if len(keys) > HELD // 2:
                            yield passed(kind, train)
    for kind, train in held:
        if held[kind, train]:
            yield passed(kind, train)
    ends = np.array([texts])
    yield pa.RecordBatch.from_pydict({"kind": np.array([2], np.int32), "key": np.array([0]), "n": ends, "seen": ends})


def _log_gamma(x):
    """Stirling's series eight steps up, as a column."""
    y = x + 8
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y**5)
    return series - F.log(steps)


def _log_kt(a, b):
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - 1.1447298858494002


def _choices(counts: DataFrame) -> DataFrame:
    """``counts`` with the eight choices of every gram ``key``: (ctx, node, one)."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    rows = counts.select("*", F.shiftright("key", 8).alias("ctx"), byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    node, one = F.expr("shiftleft(1L, bit) | shiftright(byte, 8 - bit)"), F.expr("shiftright(byte, 7 - bit) & 1")
    return rows.select(*counts.columns, "ctx", node.alias("node"), one.alias("one"))


def tree(counts: DataFrame) -> DataFrame:
    """(ctx, node, q0): the mixed probability of a 0 at every deepest node; ``counts`` (key, n) of grams, n may be 0."""
    a, b = (F.when(F.col("one") == k, F.col("n")).otherwise(0).alias(name) for k, name in enumerate("ab"))
    rows = _choices(counts).select("ctx", "node", a, b)
    sums = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    level = rows.groupBy("ctx", "node").agg(*sums, F.lit(None).cast("double").alias("below"))
    levels = {}
    for depth in range(DEPTH, -1, -1):
        kt = _log_kt(F.col("a").cast("double"), F.col("b").cast("double"))
        level = level.withColumn("kt", kt)
        gap = F.col("below") - F.col("kt")
        mixed = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(gap))) + F.lit(float(np.log(0.5)))
        level = level.select(
            "ctx",
            "node",
            "a",
            "b",
            F.coalesce(mixed, F.col("kt")).alias("pw"),
            F.coalesce(1 / (1 + F.exp(F.least(gap, F.lit(700.0)))), F.lit(1.0)).alias("stop"),
        )
        levels[depth] = level = cut_lineage(level)
        if depth:
            up = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)).alias("ctx")
            level = level.groupBy(up, "node").agg(*sums, F.sum("pw").alias("below"))
    total = F.col("a") + F.col("b")
    zero = (F.col("a") + 0.5) / (total + 1.0)
    above = None
    for depth in range(DEPTH + 1):
        here = levels[depth]
        if depth:
            up = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1))
            here = here.withColumn("up", up).join(above, ["up", "node"])
        else:
            here = here.withColumn("got", F.lit(0.0)).withColumn("rest", F.lit(1.0)).withColumn("q0", F.lit(0.5))
        here = here.withColumn("q0", F.when(total == 0, F.col("q0")).otherwise(F.col("got") + F.col("rest") * zero))
        above = here.select(
            F.col("ctx").alias("up"),
            "node",
            "q0",
            (F.col("got") + F.col("rest") * F.col("stop") * zero).alias("got"),
            (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
        )
    return above.select(F.col("up").alias("ctx"), "node", "q0")


def gram_scores(counts: DataFrame) -> DataFrame:
    """(key, seen, log): log10 probability of every gram of ``counts`` (key, n, seen)."""
    q0 = tree(counts.select("key", "n"))
    rows = _choices(counts.select("key", "seen")).join(q0, ["ctx", "node"])
    log = F.log10(F.when(F.col("one") == 1, 1 - F.col("q0")).otherwise(F.col("q0")))
    return rows.groupBy("key").agg(F.max("seen").alias("seen"), F.sum(log).alias("log"))


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` stand in the sorted ``table``, and which of them do."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _scorer(hot_grams: np.ndarray, gram_log: np.ndarray, hot: np.ndarray, hot_log: np.ndarray, end_log: float):
    """For ``mapInArrow``: what each text (doc_id, held_out, text) has by itself, its other words' hashes and other grams."""

    def run(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(2))
            for i, j in slices(at):
                part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
                n = j - i
                low = LOWER[part]
                start, end, doc = word_spans(low, bounds)
                h = span_hash(prefix_hash(low), start, end)
                pos, is_hot = _found(hot, h)
                words = np.bincount(doc, minlength=n)
                hot_n = np.bincount(doc[is_hot], minlength=n)
                base = np.bincount(doc[is_hot], hot_log[pos[is_hot]] if len(hot) else None, n) + end_log
                other = h[~is_hot].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(words - hot_n)]).astype(np.int32)
                g, starts = grams(part, bounds)
                unique, back = np.unique(g, return_inverse=True)
                pos, sent = _found(hot_grams, unique)
                value = np.zeros(len(unique))
                value[sent] = gram_log[pos[sent]]
                score = np.add.reduceat(value[back], starts)
                left = np.flatnonzero(~sent[back])
                owner = np.searchsorted(starts, left, "right") - 1
                pairs, times = np.unique(owner * len(unique) + back[left], return_counts=True)
                rare = unique[pairs % len(unique)].view(np.int64)
                ends = np.searchsorted(pairs, np.arange(n + 1) * len(unique)).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, n),
                        "held_out": batch.column(1).slice(i, n),
                        "n_tokens": pa.array(words + 1),
                        "n_hot": pa.array(hot_n),
                        "base": pa.array(base),
                        "sent": pa.array(score),
                        "other": pa.ListArray.from_arrays(pa.array(cuts), pa.array(other)),
                        "rare": pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)),
                        "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                    }
                )

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs)
    texts = text_of(docs, key, text)
    held = F.coalesce(held_remainder("doc_id", 10) == 0, F.lit(False))
    texts = texts.select("doc_id", held.alias("held_out"), "text")
    counted = texts.select("held_out", "text").mapInArrow(_counted, "kind int, key long, n long, seen long")
    counts = cut_lineage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.where("kind = 0").select("key", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    scale = float(np.log10(tokens + 0.1 * (kinds + 1)))

    hot = words.where(F.col("n") >= max(tokens * WORD_SHARE, 1.0)).toPandas()
    order = np.argsort(hot["key"].to_numpy(np.int64).view(np.uint64))
    hot_keys = hot["key"].to_numpy(np.int64).view(np.uint64)[order]
    hot_log = np.log10(hot["n"].to_numpy(float)[order] + 0.1)
    scored = cut_lineage(gram_scores(counts.where("kind = 1").drop("kind")))
    symbols = scored.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    sent_grams = scored.where(F.col("seen") >= max(symbols * GRAM_SHARE, 1.0)).select("key", "log").toPandas()
    gram_keys = sent_grams["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram_keys)
    gram_keys, gram_log = gram_keys[order], sent_grams["log"].to_numpy(float)[order]
    sent = docs.sparkSession.sparkContext.broadcast((gram_keys, gram_log, hot_keys, hot_log))
    end_log = float(np.log10(ends + 0.1))

    def run(batches):
        yield from _scorer(*sent.value, end_log)(batches)

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_hot long, base double, sent double, other array<long>, "
        "rare array<long>, times array<int>"
    )
    alone = cut_lineage(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    other = alone.select("row", F.explode("other").alias("key")).join(words, "key")
    other = other.select("row", F.lit(1).alias("known"), F.log10(F.col("n") + 0.1).alias("logs"), F.lit(0.0).alias("more"))
    rare = alone.select("row", F.explode(F.arrays_zip("rare", "times")).alias("gram")).select("row", "gram.*")
    rare = rare.join(scored.select(F.col("key").alias("rare"), "log"), "rare")
    rare = rare.select("row", F.lit(0).alias("known"), F.lit(0.0).alias("logs"), (F.col("log") * F.col("times")).alias("more"))
    other = other.unionByName(rare).groupBy("row").agg(F.sum("known").alias("n"), F.sum("logs").alias("logs"), F.sum("more").alias("more"))
    out = alone.join(cut_lineage(other), "row", "left")
    n, end_known = F.coalesce("n", F.lit(0)), F.lit(int(ends > 0))
    unknown = F.size("other") - n
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + n + end_known).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - unknown - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("sent") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
