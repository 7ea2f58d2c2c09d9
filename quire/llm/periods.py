"""Periodic runs of words, by Kruskal's order over longest common prefixes.

A run is a stretch of words that repeats with its smallest period, and that no
neighbouring word extends. The suffixes of a text stand in their sorted order,
and neighbours there are joined from the longest common prefix down. A class of
joined suffixes is an ordered set of positions; when two classes meet at a prefix
of L words, each position of the smaller one finds its neighbours in the larger.
Two positions that have newly become adjacent, q apart with q <= L, seed a run:
the words from the first on repeat with period q for q + L words, and no further,
because L is their whole common prefix. Positions of one class that are adjacent
have no smaller period between them, so q is the smallest. The seed whose left
neighbour breaks the period is the run's start; every run has exactly one.

A run of ``exponent`` periods needs L >= (exponent - 1) * q, so joining stops
below the least L that can seed a run of the shape asked for, and suffixes that
share no such prefix are never sorted further.

Suffixes of all texts of a slice are sorted together by prefix doubling in NumPy:
a suffix is compared within its document only, and leaves when nothing shares its
prefix. The classes are joined in Python, which sees only suffixes whose first
words recur in their own document. Words are told apart by their bytes, never by
a hash. A document is one row and stays in one task, whatever its length: it
takes n log n steps and some 100 bytes a word.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; very long texts are worked on alone and whole; of runs of equal
length the smallest start, then the smallest period is the longest; repeated rows
and null ids are rows like any other; an empty table gives no rows; other columns
are neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_bytes, slices, text_of

EXPONENT = 4
SHORTEST = 6
BLOCK = 1024  # positions of a class held together

RUN = "struct<start: long, length: long, period: long>"


class Positions:
    """An ordered set of positions in blocks of bounded size, so that an insertion moves few of them."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def _block(self, p: int) -> int:
        """The last block that begins before ``p``, else the first."""
        lo, hi = 0, len(self.blocks)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][0] < p:
                lo = mid + 1
            else:
                hi = mid
        return max(lo - 1, 0)

    def around(self, p: int) -> tuple[int, int]:
        """The neighbours of ``p``, which is not in the set; -1 where there is none."""
        b = self._block(p)
        block = self.blocks[b]
        k = bisect_left(block, p)
        before = block[k - 1] if k else -1
        if k < len(block):
            return before, block[k]
        return before, self.blocks[b + 1][0] if b + 1 < len(self.blocks) else -1

    def add(self, p: int) -> None:
        b = self._block(p)
        block = self.blocks[b]
        block.insert(bisect_left(block, p), p)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[b : b + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]


def seeds(positions: list[int], common: list[int], order: list[int]) -> list[tuple[int, int, int]]:
    """(first, second, L) of positions that become adjacent at a common prefix of L >= their distance.

    ``positions`` are suffixes in sorted order, ``common[r]`` the common prefix of
    suffixes r and r + 1, and ``order`` the r to join, by descending ``common``.
    """
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def class_of(r: int) -> int:
        if r not in parent:
            parent[r] = r
            classes[r] = Positions(positions[r])
            return r
        root = r
        while parent[root] != root:
            root = parent[root]
        while parent[r] != root:
            parent[r], r = root, parent[r]
        return root

    for r in order:
        large, small, length = class_of(r), class_of(r + 1), common[r]
        if classes[large].size < classes[small].size:
            large, small = small, large
        into, come = classes[large], list(classes.pop(small))
        parent[small] = large
        last = -1
        for k, p in enumerate(come):
            # neighbours of the larger class, unless one of the smaller class lies between
            before, after = into.around(p)
            if before > last and p - before <= length:
                found.append((before, p, length))
            if after >= 0 and after - p <= length and not (k + 1 < len(come) and come[k + 1] < after):
                found.append((p, after, length))
            last = p
        for p in come:
            into.add(p)
    return found


def _sort_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of ``key``, first place of each element's group in it, and whether the group has several."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = np.diff(np.append(first, len(s)))[group] > 1
    return order, first[group], several


def sorted_suffixes(names: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the common prefix of each with the next, for suffixes with a prefix met twice.

    ``names`` number the words, ``doc`` gives each word's document, ``end`` where that ends.
    A suffix that shares fewer than ``least`` words with any other of its document may be left out.
    """
    n = len(names)
    order, place, several = _sort_groups(doc.astype(np.int64) << np.int64(32) | names)
    rank = np.empty(n, np.int64)
    rank[order] = place
    ranks = [rank.copy()]  # by step: equal ranks mean equal first 2**step words
    live = order[several]
    kept, width = live, 1
    while len(live):
        # group members by the rank of what follows; a suffix that ends there comes first
        beyond = live + width
        ended = beyond >= end[live]
        follow = np.where(ended, 0, rank[np.minimum(beyond, n - 1)] + 1)
        order, place, several = _sort_groups(rank[live] * np.int64(n + 1) + follow)
        live = live[order]
        old = rank[live]
        start = np.ones(len(live), bool)
        np.not_equal(old[1:], old[:-1], out=start[1:])
        first = np.flatnonzero(start)
        group_first = first[np.cumsum(start) - 1]
        rank[live] = old + place - group_first
        width *= 2
        ranks.append(rank.copy())
        live = live[several]
        if width <= least:
            kept = live
    kept = kept[np.argsort(rank[kept], kind="stable")]
    a, b = kept[:-1], kept[1:]
    common = np.zeros(max(len(kept) - 1, 0), np.int64)
    for step in range(len(ranks) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < end[a]) & (j < end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        common += np.where(inside & (ranks[step][i] == ranks[step][j]), 1 << step, 0)
    return kept, common


def runs_of(names: np.ndarray, at: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted by text, start and period.

    ``names`` number the words of texts one after the other, the k-th from ``at[k]`` to ``at[k + 1]``.
    """
    none = np.empty((0, 4), np.int64)
    if not len(names):
        return none
    # the least common prefix of a seed: max(shortest - q, (exponent - 1) * q) over all periods q
    least = min(max(shortest - q, (exponent - 1) * q) for q in range(1, shortest + 1))
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(at[1:], sizes)
    positions, common = sorted_suffixes(names, doc, end, least)
    order = np.argsort(-common, kind="stable")
    order = order[common[order] >= max(least, 1)]
    if not len(order):
        return none
    pairs = np.array(seeds(positions.tolist(), common.tolist(), order.tolist()), np.int64).reshape(-1, 3)
    first, second, shared = pairs.T
    period = second - first
    length = period + shared
    begins = (first == at[doc[first]]) | (names[first - 1] != names[second - 1])
    good = begins & (length >= np.maximum(shortest, exponent * period))
    first, period, length = first[good], period[good], length[good]
    out = np.stack([doc[first], first - at[doc[first]], length, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _found(batches, exponent, shortest):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, at = column_bytes(batch.column(1))
        for i, j in slices(at):
            texts = [data[at[k] : at[k + 1]].tobytes().split() for k in range(i, j)]
            number = defaultdict()
            number.default_factory = number.__len__
            sizes = np.array([len(t) for t in texts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            names = np.fromiter((number[w] for t in texts for w in t), np.int64, int(bounds[-1]))
            found = runs_of(names, bounds, exponent, shortest)
            cuts = np.searchsorted(found[:, 0], np.arange(j - i + 1))
            # words beyond the first period of a run go
            edge = np.zeros(len(names) + 1, np.int64)
            base = bounds[found[:, 0]] + found[:, 1]
            np.add.at(edge, base + found[:, 3], 1)
            np.add.at(edge, base + found[:, 2], -1)
            stays = np.cumsum(edge)[:-1] == 0
            collapsed = []
            for k, words in enumerate(texts):
                if cuts[k] < cuts[k + 1]:
                    words = [w for w, ok in zip(words, stays[bounds[k] : bounds[k + 1]].tolist(), strict=True) if ok]
                collapsed.append(b" ".join(words).decode())
            fields = [pa.array(found[:, c]) for c in (1, 2, 3)]
            runs = pa.ListArray.from_arrays(
                pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).slice(i, j - i),
                    "n_words": pa.array(sizes),
                    "runs": runs.cast(run_type),
                    "collapsed": pa.array(collapsed, pa.string()),
                }
            )


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start), collapsed.

    Runs have at least ``exponent`` periods (2 or more) and ``shortest`` words.
    ``collapsed`` is the text without the words that follow a run's first period.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    return text_of(docs, key, text).mapInArrow(
        lambda batches: _found(batches, exponent, shortest),
        f"doc_id long, n_words long, runs array<{RUN}>, collapsed string",
    )


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by the crc32 of the id, repeats a passage from some word on.

    With h the crc32 of the decimal id, g = h div 10 and n words, texts with h % 10 = 0 have from word a = g % n on
    the p = 1 + (n - a) div (3 + g % 8) words that begin there, over and over. Rows without an id stay as they are.
    """
    rows = text_of(docs, key, text)
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = rows.withColumn("g", F.expr("h div 10")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    )
    chosen = chosen.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("if(n > 0, g % n, 0L)"))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs(with_planted_runs(docs, key, text))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.withColumn("best", best)
    period = -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
