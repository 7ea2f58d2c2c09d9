"""Packing of token sequences into rows of a fixed length, by exact-complement hashing.

Every document is its token ids and one end id. Only documents longer than a
sequence are cut. The rest of the work is on counts of lengths, of which there
are at most ``SEQUENCE``: lengths that are still to be had are indexed by value,
their pairs and triples by their sums. For the longest length left, a single,
pair or triple whose sum is exactly the gap is taken out, as many times over as
the counts allow. What no combination fills exactly is packed best-fit: the
longest that fits goes into the gap, again in bulk. So a plan has a few thousand
patterns however many documents there are; it is bounded by ``SEQUENCE`` and
goes to the tasks as arrays.

Pieces find their place without sorting: a task numbers its pieces of each length
as it writes them, sums of the counts of earlier tasks make that a number among
all pieces of the length, and the plan says which sequence and offset the number
has. No group is gathered anywhere.

Defined results: null text is empty and has the end id only; repeated rows are
packed as often as they stand; an empty table gives no rows; other columns are
neither read nor returned.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, coded, column_bytes, slices, small_batches, taken, text_of, word_spans, worker_store
from quire.session import cut_lineage

SEQUENCE = 4096
END_ID = 1
KEPT_WORDS = 150_000  # matches a worker remembers, and as many it has met before those
SLICE = 1 << 20  # bytes of text whose matches are looked up together
STEP = 50_000
LINES = 4_000  # new matches encoded at a time

LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 0


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point below U+0800 its class and its lower case; ``OTHER`` is left to the tokenizer.

    Told apart here are the printable ASCII characters and the precomposed Latin letters, whose composition and
    lower case are the same whatever stands beside them, where the lower case has as many bytes.
    """
    kind, lower = np.zeros(0x800, np.uint8), np.arange(0x800, dtype=np.uint16)
    plain = [*range(0x21, 0x7F), *range(0xC0, 0x130), *range(0x132, 0x250)]
    for c in plain:
        low = chr(c).lower()
        if len(low) == 1 and len(low.encode()) == len(chr(c).encode()):
            lower[c] = ord(low)
            kind[c] = LETTER if regex.match(r"\p{L}", low) else DIGIT if regex.match(r"\p{N}", low) else MARK
    return kind, lower


_KIND, _LOWER = _character_tables()


def matches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut as the tokenizer cuts them: lower-cased bytes, starts, ends, and whether a stretch is a whole word.

    A stretch is a match of the tokenizer's pattern, or a word of other characters
    as it stands, which the tokenizer has to cut itself. White space is in none.
    """
    n = len(data)
    start, end, _ = word_spans(data, at)
    kind, low = _KIND[data], _LOWER[data].astype(np.uint8)  # what is not ASCII is set below
    wide = np.flatnonzero(data >= 0x80)
    kind[wide] = OTHER
    low[wide] = data[wide]
    # two-byte characters; texts are valid UTF-8, so the byte after a leading one belongs to it
    lead = wide[(data[wide] >= 0xC2) & (data[wide] < 0xE0)]
    point = (data[lead].astype(np.int32) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
    kind[lead] = kind[lead + 1] = _KIND[point]
    low[lead], low[lead + 1] = 0xC0 | _LOWER[point] >> 6, 0x80 | _LOWER[point] & 0x3F
    odd = kind == OTHER
    odd &= ~SPACE[data]
    if n > 1:
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # "<|" may begin a special token
    odd = np.flatnonzero(odd)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[:n] |= kind == DIGIT
    edge[lead[_KIND[point] == DIGIT] + 1] = False
    edge[start] = edge[end] = True
    # "'s" and the like, where the apostrophe begins and ends a run of marks
    quote = np.flatnonzero(low[: n - 1] == 0x27) if n > 1 else np.empty(0, np.int64)
    quote = quote[edge[quote] & edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        quote = quote[~np.isin(quote + 1, start)]
        one, two = low[quote + 1], low[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        long &= ~edge[np.minimum(quote + 2, n)]
        edge[quote[short | long] + 1] = False
        edge[quote[short] + 2] = True
        edge[quote[long] + 3] = True
    whole = np.zeros(n, bool)
    if len(odd):
        words = np.unique(np.searchsorted(start, odd, "right") - 1)
        inside = np.zeros(n + 1, np.int8)
        inside[start[words]] = 1
        inside[end[words]] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:n] > 0
        low[inside] = data[inside]
        edge[:n] &= ~inside
        edge[start[words]] = edge[end[words]] = True
        whole[start[words]] = True
    first = np.flatnonzero(edge)
    first, last = first[:-1], first[1:]
    solid = ~SPACE[data[first]]
    first, last = first[solid], last[solid]
    return low, first, last, whole[first]


class Words:
    """Token ids of texts as little-endian bytes; texts are cut at ASCII white space, which has no token.

    Texts are taken a few megabytes at a time, lower-cased and cut into the matches
    of the tokenizer's own pattern, each of which is encoded by itself; each distinct
    match of those is looked up once. New ones are encoded many at a time, one to a
    line, and told apart by the tokens that end a match. They are cut and normalised
    already, so that the tokenizer's model is all they need. Words of characters
    whose composition or case may depend on others are encoded whole, as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lines.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), to_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _one_by_one(self, new: list[bytes]) -> None:
        for i in range(0, len(new), LINES):
            some = new[i : i + LINES]
            made = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            for w, e in zip(some, made, strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[bytes], whole: list[bool]) -> None:
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        again = [w in self.older for w in new]
        self.known.update((w, self.older[w]) for w, a in zip(new, again, strict=True) if a)
        cut = [w for w, a, o in zip(new, again, whole, strict=True) if not (a or o)]
        self._one_by_one([w for w, a, o in zip(new, again, whole, strict=True) if o and not a])
        for i in range(0, len(cut), LINES):
            some = cut[i : i + LINES]
            made = self.lines.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids
            ids = np.array(made, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a vocabulary whose matches do not end so
                self._one_by_one(some)
                continue
            flat, at = ids.tobytes(), 0
            for w, stop in zip(some, (4 * stops).tolist(), strict=True):
                self.known[w] = flat[at:stop]
                at = stop

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Token ids of each text."""
        data, at = column_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        out = []
        for i, j in slices(at, SLICE):
            here = at[i : j + 1] - at[i]
            low, start, end, whole = matches(data[at[i] : at[j]], here)
            words, codes = coded(low, start, end)
            found = list(map(self.known.get, words))
            new = np.array([n for n, f in enumerate(found) if f is None], np.int64)
            if len(new):
                alone = np.zeros(len(words), bool)
                alone[codes.to_numpy()[whole]] = True
                for k in range(0, len(new), STEP):  # so that one step's new words fit the store
                    some = new[k : k + STEP]
                    self._learn([words[n] for n in some], alone[some].tolist())
                    for n in some:
                        found[n] = self.known[words[n]]
            flat, begin = taken(found, codes)
            edges = begin[np.searchsorted(start, here)].tolist()
            out += [bytes(flat[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return out


def words_of(name: str) -> Words:
    """The tokenizer of a file that ``SparkContext.addFile`` has sent, one for each worker process."""
    kept = worker_store()
    if name not in kept:
        kept[name] = Words(SparkFiles.get(name))
    return kept[name]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): pieces of at most ``SEQUENCE`` ids.

    ``nth`` counts the pieces of a length within the writing task ``part``, so the
    result must be written once and read from there.
    """
    small_batches(docs)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        words, part = words_of(name), TaskContext.get().partitionId()
        seen = np.zeros(SEQUENCE + 1, np.int64)
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what batches before, or stages before in this worker, have left
            out = [[], [], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1)), strict=True):
                flat = memoryview(ids + end)
                for k, at in enumerate(range(0, len(flat), 4 * SEQUENCE)):
                    one = flat[at : at + 4 * SEQUENCE]
                    n = len(one) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(one), part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return text_of(docs, key, text).mapInArrow(run, schema)


def _exact(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Lengths to be had whose sum is ``gap``: one, else two, else three; the longest first."""
    if gap <= 0:
        return None
    if have[gap] > 0:
        return (gap,)
    low = np.arange(1, gap // 2 + 1)
    pair = _pair(have, gap, low)
    if pair:
        return pair
    for a in np.flatnonzero(have[: gap - 1])[::-1]:
        rest = gap - int(a)
        if 3 * a < gap:  # a is the longest of the three
            break
        have[a] -= 1
        pair = _pair(have, rest, low[: min(rest // 2, len(low))], int(a))
        have[a] += 1
        if pair:
            return (int(a), *pair)
    return None


def _pair(have: np.ndarray, total: int, low: np.ndarray, most: int | None = None) -> tuple[int, int] | None:
    high = total - low
    ok = (have[low] > 0) & (have[high] > 0)
    if total % 2 == 0 and len(low) and low[-1] * 2 == total:
        ok[-1] = have[total // 2] > 1
    if most is not None:
        ok &= high <= most
    hits = np.flatnonzero(ok)
    return (int(high[hits[0]]), int(low[hits[0]])) if len(hits) else None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that use up ``counts`` (by length, 0 to ``SEQUENCE``)."""
    have = counts.astype(np.int64).copy()
    made, rest = [], np.zeros_like(have)

    def take(pattern: tuple[int, ...]) -> None:
        parts, times = np.unique(pattern, return_counts=True)
        m = int((have[parts] // times).min())
        have[parts] -= m * times
        made.append((pattern, m))

    for length in range(SEQUENCE, 0, -1):
        while have[length] > 0:
            gap = SEQUENCE - length
            have[length] -= 1
            found = _exact(have, gap) if gap else ()
            have[length] += 1
            if found is None:
                rest[length] += have[length]
                have[length] = 0
            else:
                take((length, *found))
    have = rest
    while have.any():
        pattern, gap = [], SEQUENCE
        left = have.copy()
        while gap > 0:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            n = int(min(left[best], gap // best))
            pattern += [best] * n
            left[best] -= n
            gap -= n * best
        take(tuple(pattern))
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first number): where pieces of these numbers go."""
    used = np.zeros(SEQUENCE + 1, np.int64)
    rows, sequence = [], 0
    for pattern, m in made:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            rows.append((length, int(used[length]), sequence, offset, times))
            used[length] += times * m
            offset += times * length
        sequence += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {n: table[:, k] for k, n in enumerate(("length", "first", "sequence", "offset", "times"))}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = cut_lineage(pieces(docs, tokenizer, key, text))
    by_task = cut_lineage(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length at most
    counts = np.zeros(SEQUENCE + 1, np.int64)
    for row in totals:
        counts[row["length"]] = row["n"]
    where = places(plan(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(cut_lineage(by_task), ["length", "part"]).withColumn("nth", F.col("nth") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        keys = (where["length"] << np.int64(48)) + where["first"]
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << np.int64(48)) + nth, "right") - 1
            k, times = nth - where["first"][at], where["times"][at]
            made = {
                "sequence_id": pa.array(where["sequence"][at] + k // times),
                "offset": pa.array(where["offset"][at] + k % times * length),
            }
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(columns)} | made)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*columns, "nth").mapInArrow(place, schema)
