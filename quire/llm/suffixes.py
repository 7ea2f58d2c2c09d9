"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else
in the corpus. The suffixes that could matter are found first. Every window of
``LENGTH`` bytes has an anchor: the ``GRAM`` bytes in it of the smallest hash.
Equal windows have equal anchors, so windows whose anchor is met once cannot
repeat, and the others fall into groups that do not concern one another. Windows
side by side with one anchor form a context; equal contexts are folded into one
with a count, and a context met twice repeats throughout.

In each remaining group the contexts are put one after the other and their
suffixes sorted by linear grouping (``suffix_array``): suffixes are grouped by
their Lyndon prefix, groups from the largest to the smallest handing their rank
to their members' previous smaller suffixes (where Lyndon prefixes are short in the
mean, the prefixes themselves tell the groups), and each group's order is emitted
in one pass in rank order. Windows of equal bytes stand side by side then.

A group of more than ``GROUP`` contexts is dealt out again by the windows
themselves, which are counted by 128-bit hashes, so no task holds more than
``GROUP`` contexts however often a passage occurs.

Defined results: null is empty; texts under ``LENGTH`` bytes lose nothing;
repeated rows are copies of each other, so any of at least ``LENGTH`` bytes
loses everything; rows without an id are rows like any other; a very long text
is worked on whole in one task; overlapping occurrences count; an empty table
gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_bytes, mix, prefix_hash, side_by_side, slices, small_batches, span_hash, text_of
from quire.session import cut_lineage

LENGTH = 200
GRAM = 100
REACH = LENGTH - GRAM + 1  # grams in a window
GROUP = 256
SHORT = 64  # bytes of a Lyndon prefix in the mean, up to which prefixes are compared themselves
TOGETHER = 64 << 10  # bytes of text hashed together; a longer text is hashed alone
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def eights(text: bytes, length: int) -> np.ndarray:
    """The eight bytes from each of the first ``length`` places on as numbers that compare like them; zeros follow the text."""
    padded = text + bytes(length + 8 - len(text))
    out = np.empty(length, ">u8")
    for k in range(8):
        part = np.frombuffer(padded, ">u8", (length + 7 - k) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    return out.astype(np.uint64)


def smaller_suffixes(text: bytes) -> tuple[list[int], list[int]]:
    """For each suffix the start of the nearest smaller one to its left (-1: none) and right (length: none)."""
    n = len(text)
    before, after = [-1] * n, [n] * n
    heads = eights(text, n).tolist()
    heads.append(-1)  # stands at -1 too: the bottom is smaller than any suffix
    for i, head in enumerate(heads[:n]):
        j = i - 1
        while (other := heads[j]) >= head:
            if other == head:
                one, two = text[j + 8 : j + 72], text[i + 8 : i + 72]
                if one < two or one == two and text[j:] < text[i:]:
                    break
            after[j] = i
            j = before[j]
        before[i] = j
    return before, after


def lyndon_groups(text: bytes, before: list[int]) -> tuple[list[int], list[int]]:
    """Group of each suffix, numbered in descending order of its Lyndon prefix, and the groups' sizes.

    A Lyndon prefix is its first byte and the Lyndon prefixes of the suffixes for
    which it is the previous smaller one, from left to right, never growing. Groups
    are taken from the largest on; when one is taken its prefix is final, and each
    member's previous smaller suffix has it as its next part. Those that get it
    leave their group for a new one directly above: they are larger than those that
    will get a smaller part or none. One with several members takes several steps.
    """
    members: dict[int, list[int]] = {}
    for i, b in enumerate(text):
        members.setdefault(b, []).append(i)
    groups, of = [], [0] * len(text)
    for b in sorted(members):
        for i in members[b]:
            of[i] = len(groups)
        groups.append(members[b])
    # neighbours in the order of the groups
    lower, upper = list(range(-1, len(groups) - 1)), list(range(1, len(groups) + 1))
    upper[-1:] = [-1]
    left = [len(g) for g in groups]  # members that have not moved up
    top, rank, sizes = len(groups) - 1, [0] * len(text), []
    while top >= 0:
        if left[top]:
            mine = groups[top]
            if left[top] < len(mine):
                mine = [i for i in mine if of[i] == top]
            r = len(sizes)
            sizes.append(len(mine))
            for i in mine:
                rank[i] = r
            parents = [before[i] for i in mine if before[i] >= 0]
            if len(parents) == 1:
                p = parents.pop()
                old = of[p]
                if left[old] > 1:
                    new = of[p] = len(groups)
                    above = upper[old]
                    groups.append([p])
                    left.append(1)
                    left[old] -= 1
                    lower.append(old)
                    upper.append(above)
                    upper[old] = lower[above] = new
            while parents:
                moved: dict[int, int] = {}
                again, seen = [], set()
                for p in parents:
                    if p in seen:
                        again.append(p)
                        continue
                    seen.add(p)
                    old = of[p]
                    new = moved.get(old)
                    if new is None:
                        if left[old] == 1:  # nobody stays behind, so the group is above itself already
                            continue
                        new = moved[old] = len(groups)
                        above = upper[old]
                        groups.append([])
                        left.append(0)
                        lower.append(old)
                        upper.append(above)
                        upper[old] = new
                        lower[above] = new
                    groups[new].append(p)
                    left[new] += 1
                    left[old] -= 1
                    of[p] = new
                parents = again
            groups[top] = ()
        top = lower[top]
    return rank, sizes


def prefix_groups(text: bytes, after: list[int]) -> tuple[list[int], list[int]]:
    """As ``lyndon_groups``: a Lyndon prefix ends where the next smaller suffix begins, so short ones are compared themselves."""
    prefixes = [text[i:j] for i, j in enumerate(after)]
    sizes = Counter(prefixes)
    ordered = sorted(sizes, reverse=True)
    ranks = {p: r for r, p in enumerate(ordered)}
    return [ranks[p] for p in prefixes], [sizes[p] for p in ordered]


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes in ascending order, in linear time once the smaller suffixes are known.

    A suffix is its Lyndon prefix and the next smaller suffix after it, so within a
    group the order is that of the next smaller suffixes: taking the suffixes in
    ascending order, each puts the ones it follows at the front of their groups.
    """
    n = len(text)
    before, after = smaller_suffixes(text)
    short = sum(after) - n * (n - 1) // 2 <= SHORT * n  # all Lyndon prefixes together
    rank, sizes = prefix_groups(text, after) if short else lyndon_groups(text, before)
    free, at = [], n
    for size in sizes:
        at -= size
        free.append(at)
    order = [0] * n
    i, k = n, -1
    while True:
        j = i - 1
        while j >= 0 and after[j] == i:
            r = rank[j]
            order[free[r]] = j
            free[r] += 1
            j = before[j]
        k += 1
        if k == n:
            return order
        i = order[k]


def repeated_windows(text: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which window starts hold ``LENGTH`` bytes found at another start; contexts lie at ``starts``, ``counts`` windows each."""
    valid = np.zeros(len(text) + 1, np.int64)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + counts, -1)
    valid = np.cumsum(valid)[: len(text)] > 0
    out = np.zeros(len(text), bool)
    order = np.array(suffix_array(text), np.int64)
    order = order[valid[order]]
    windows = np.ndarray((max(len(text) - LENGTH + 1, 0),), f"V{LENGTH}", text, strides=(1,))
    for k in range(0, len(order) - 1, 4096):
        one = order[k : k + 4097]
        there = windows[one].view(np.uint64).reshape(len(one), -1)
        same = (there[1:] == there[:-1]).all(axis=1)
        out[one[1:][same]] = out[one[:-1][same]] = True
    return out


def anchored(prefix: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts of at least ``LENGTH`` bytes, by the ``prefix_hash`` of them side by side and where each begins.

    Each context's text, anchor hash, first window in it, number of windows, whether the anchor's bytes recur in the text,
    and the first window's place among all.
    """
    reach = LENGTH - gram + 1
    starts = np.arange(len(prefix) - gram)
    h = span_hash(prefix, starts, starts + gram)
    # sliding minimum over twice as many grams each time, then over two stretches that overlap
    least, wide = h, 1
    while 2 * wide <= reach:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < reach:
        least = np.minimum(least[: wide - reach], least[reach - wide :])
    # windows lie within their text
    windows = np.diff(at) - (LENGTH - 1)
    end = at[:-1] + windows
    change = np.empty(len(least) + 1, bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    change[at[:-1]] = change[end] = True
    edge = np.flatnonzero(change)
    of = np.minimum(np.searchsorted(at, edge, "right") - 1, len(end) - 1)
    inside = edge < end[of]
    first, runs, of = edge[inside], np.diff(np.append(edge, len(change)))[inside], of[inside]
    # long runs of one anchor, as periodic text has, are cut; where does not matter
    if (runs > reach).any():
        parts = -(-runs // reach)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(first + runs, parts)
        first, of = np.repeat(first, parts) + nth * reach, np.repeat(of, parts)
        runs = np.minimum(stop - first, reach)
    key = least[first]
    # grams that recur: only hashes up to a text's greatest anchor can be anchors
    most = np.maximum.reduceat(key, np.flatnonzero(np.diff(of, prepend=-1)))
    low = np.flatnonzero(h <= np.repeat(most, np.diff(at))[: len(h)])
    text = np.searchsorted(at, low, "right") - 1
    within = low <= at[text + 1] - gram
    low, text = low[within], text[within]
    value = h[low]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    again = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    recurs = np.zeros(len(key), bool)
    if again.any():
        pairs = set(zip(text[1:][again].tolist(), value[1:][again].tolist(), strict=True))
        maybe = np.flatnonzero(np.isin(key, value[1:][again]))
        recurs[maybe] = [p in pairs for p in zip(of[maybe].tolist(), key[maybe].tolist(), strict=True)]
    return of, key, first - at[of], runs, recurs, first


def _contexts(batches):
    for batch in batches:
        data, at = column_bytes(batch.column(2))
        for i, j in slices(at):
            out = []
            long = i + np.flatnonzero(np.diff(at[i : j + 1]) >= LENGTH)
            ends = np.cumsum(np.append(0, np.diff(at)[long]))
            for a, b in slices(ends, TOGETHER):
                prefix, edges = side_by_side([prefix_hash(data[at[k] : at[k + 1]]) for k in long[a:b].tolist()])
                of, key, first, runs, recurs, place = anchored(prefix, edges, GRAM)
                ctx = span_hash(prefix, place, place + runs - 1 + LENGTH)
                out.append((long[a:b][of], key.view(np.int64), ctx.view(np.int64), first, runs, recurs))
            if out:
                row, key, ctx, first, runs, recurs = (np.concatenate(c) for c in zip(*out, strict=True))
                row = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(row),
                        "print": batch.column(1).take(row),
                        "key": pa.array(key),
                        "ctx": pa.array(ctx),
                        "first": pa.array(first.astype(np.int32)),
                        "n": pa.array(runs.astype(np.int32)),
                        "recurs": pa.array(recurs),
                    }
                )


def contexts(texts: DataFrame) -> DataFrame:
    """(doc_id, print, key, ctx, first, n, recurs) of every context of ``texts`` (doc_id, print, text)."""
    schema = "doc_id long, print long, key long, ctx long, first int, n int, recurs boolean"
    return texts.select("doc_id", "print", "text").mapInArrow(_contexts, schema)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_groups(batches):
    """Suffix arrays over rows (key, ctx, n, bytes) that come sorted by key; each context's runs of repeated windows."""

    def solve(rows):
        text = b"".join(r[3] for r in rows)
        starts = np.cumsum([0] + [len(r[3]) for r in rows])[:-1]
        flags = repeated_windows(text, starts, np.array([r[2] for r in rows]))
        for (key, ctx, n, _), s in zip(rows, starts, strict=True):
            lo, hi = _ranges(flags[s : s + n])
            if len(lo):
                yield key, ctx, n, [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    out, group = [], []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if group and group[0][0] != row[0]:
                out += solve(group)
                group = []
            group.append(row)
        if len(out) > 5000:
            yield _marks(out)
            out = []
    if group:
        out += solve(group)
    yield _marks(out)


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    names = ["key", "ctx", "n", "runs"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


MARKS = "key long, ctx long, n int, runs array<struct<lo: int, hi: int>>"


def _windows(batches):
    """Every window of the contexts (key, ctx, n, bytes, copies) with a 128-bit hash."""
    for batch in batches:
        for key, ctx, n, data, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            at = np.arange(n)
            one = np.frombuffer(data, np.uint8)
            a = span_hash(prefix_hash(one), at, at + LENGTH)
            b = span_hash(prefix_hash(one ^ np.uint8(0xA5)), at, at + LENGTH)
            same = {"key": key, "ctx": ctx, "n": np.int32(n), "copies": copies}
            columns = {k: np.full(n, v) for k, v in same.items()}
            yield pa.RecordBatch.from_pydict(
                columns | {"lo": at.astype(np.int32), "a": a.view(np.int64), "b": mix(b ^ _SECOND).view(np.int64)}
            )


def _without(batches):
    """(doc_id, print, n_bytes, n_removed, n_spans, kept bytes) from rows (doc_id, text, ranges, print)."""
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            for s in spans or ():
                edge[s["lo"]] += 1
                edge[s["hi"]] -= 1
            gone = np.cumsum(edge)[: len(data)] > 0
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(_ranges(gone)[0]))
            out["kept"].append(data[~gone].tobytes())
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0), "print": batch.column(3)} | {c: pa.array(v, types[c]) for c, v in out.items()}
        )


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, print, spans of lo and hi): byte ranges of ``texts`` (doc_id, print, text) to remove; they may overlap."""
    # found twice rather than written once: there are some dozen contexts a kilobyte, most of them met nowhere else
    met = contexts(texts).groupBy("key").agg(F.count("*").alias("c"), F.max("recurs").alias("recurs"))
    met = cut_lineage(met.where("c > 1 or recurs").select("key"))
    found = cut_lineage(contexts(texts).join(met, "key"))
    folded = found.groupBy("key", "ctx", "n").agg(
        F.count("*").alias("copies"),
        F.min(F.struct("doc_id", "print", "first")).alias("at"),
        F.max("recurs").alias("recurs"),
    )
    folded = cut_lineage(folded)
    groups = folded.groupBy("key").agg(
        F.count("*").alias("size"), F.min("copies").alias("least"), F.max("recurs").alias("recurs")
    )
    groups = groups.where("least = 1 and (size > 1 or recurs)").select("key", "size")
    open_ = cut_lineage(folded.drop("recurs").join(cut_lineage(groups), "key"))
    asked = open_.select("key", "ctx", "n", "copies", "size", "at.doc_id", "at.print", "at.first")
    size = (F.col("n") + (LENGTH - 1)).cast("int")
    data = asked.join(texts, ["doc_id", "print"]).select(
        "key", "ctx", "n", "copies", "size", F.substring(F.encode("text", "UTF-8"), F.col("first") + 1, size).alias("data")
    )
    data = cut_lineage(data.dropDuplicates(["key", "ctx", "n"]))

    # one row for each context, whatever the number of its windows and copies
    run = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    whole = folded.where("copies > 1").select("key", "ctx", "n", run.alias("runs"))
    single = data.where("copies = 1").select("key", "ctx", "n")
    small = data.where(F.col("size") <= GROUP).select("key", "ctx", "n", "data")
    small = small.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups, MARKS)
    large = data.where(F.col("size") > GROUP).select("key", "ctx", "n", "data", "copies")
    schema = "key long, ctx long, n int, copies long, lo int, a long, b long"
    large = cut_lineage(large.mapInArrow(_windows, schema))
    twice = cut_lineage(large.groupBy("a", "b").agg(F.sum("copies").alias("c")).where("c > 1").select("a", "b"))
    one = F.struct("lo", (F.col("lo") + 1).alias("hi"))
    large = large.where("copies = 1").join(twice, ["a", "b"]).groupBy("key", "ctx", "n").agg(F.collect_list(one).alias("runs"))
    small = cut_lineage(small).join(single, ["key", "ctx", "n"], "left_semi")
    marks = cut_lineage(whole.unionByName(small).unionByName(large))
    first = F.col("first").cast("long")
    spans = F.transform("runs", lambda r: F.struct((first + r["lo"]).alias("lo"), (first + r["hi"] + (LENGTH - 1)).alias("hi")))
    return found.join(marks, ["key", "ctx", "n"]).select("doc_id", "print", spans.alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_print: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay); print (xxhash64 of the text) if asked."""
    small_batches(docs)
    # the print tells rows of one id with different texts apart; rows without an id meet under a number of their own,
    # as a join finds no nulls
    rows = text_of(docs, key, text).withColumn("print", F.xxhash64(F.coalesce("text", F.lit("")))).withColumnRenamed("doc_id", "given")
    texts = rows.withColumn("doc_id", F.coalesce("given", F.lit(-(2**63))))
    spans = repeated_spans(texts).groupBy("doc_id", "print").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = texts.join(cut_lineage(spans), ["doc_id", "print"], "left").select("given", "text", "spans", "print")
    made = out.mapInArrow(_without, "doc_id long, print long, n_bytes long, n_removed long, n_spans long, kept binary")
    return made if with_print else made.drop("print")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, key, text).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
