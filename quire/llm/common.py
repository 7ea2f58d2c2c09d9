"""What the operators of this subpackage share: Arrow text buffers, words, hashes, row numbers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of text worked on at once inside a task; a single longer text is worked on alone
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True at the first byte of every UTF-8 character
LEAD = (np.arange(256) & 0xC0) != 0x80

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_UNBASE = pow(_BASE, -1, 2**64)
_powers = {"up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the hash sum of the first i bytes; ``span_hash`` takes spans from it."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of each span; equal bytes give equal hashes anywhere."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def side_by_side(prefixes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``prefix_hash`` of texts one after the other from those of each, and where each text begins."""
    at = np.cumsum([0] + [len(p) - 1 for p in prefixes])
    up, _ = _power_tables(int(at[-1]) + 1)
    out = np.zeros(at[-1] + 1, np.uint64)
    for one, a, b in zip(prefixes, at[:-1].tolist(), at[1:].tolist(), strict=True):
        np.multiply(one[1:], up[a], out=out[a + 1 : b + 1])
        out[a + 1 : b + 1] += out[a]
    return out, at


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after the other, and where each text begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``; words never cross texts."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    edges = at[1:-1]
    first[edges[edges < len(data)]] = True
    last[edges[edges > 0] - 1] = True
    start = np.flatnonzero(solid & first)
    end = np.flatnonzero(solid & last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """The distinct stretches of ``data`` and the number of each one's entry; what lies between them is white space."""
    ends = np.concatenate([[0], np.cumsum(end - start)])
    solid = np.ascontiguousarray(data[~SPACE[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
    made = words.dictionary_encode()
    return made.dictionary.to_pylist(), made.indices


def taken(values: list[bytes] | pa.Array, codes: pa.Array) -> tuple[memoryview, np.ndarray]:
    """``values`` in the order of ``codes``, one after the other, and where each begins and the last ends."""
    if not len(codes):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = (values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())).take(codes).buffers()
    at = np.frombuffer(offsets, np.int64)[: len(codes) + 1]
    return memoryview(data or b""), at


def map_texts(df: DataFrame, keep: list[str], text: str, work: Callable, schema: str) -> DataFrame:
    """``work(rows, data, at)`` over slices of the texts of each Arrow batch.

    ``rows`` maps each column of ``keep`` to its Arrow slice; ``work`` returns an
    Arrow table's columns as a dict in the order of ``schema``.
    """

    def run(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(len(keep)))
            for i, j in slices(at):
                rows = {c: batch.column(k).slice(i, j - i) for k, c in enumerate(keep)}
                made = work(rows, data[at[i] : at[j]], at[i : j + 1] - at[i])
                if made is not None:
                    yield pa.RecordBatch.from_pydict(made)

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def text_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that columns of any other name cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def held_remainder(key: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def worker_store() -> dict:
    """A dictionary that lasts as long as the worker process: functions and their globals arrive anew with each task."""
    return sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__


def small_batches(df: DataFrame) -> None:
    """Arrow batches of at most 2,000 rows, so that a batch of long texts fits beside its working arrays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
