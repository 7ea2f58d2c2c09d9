"""Near-duplicate documents by min-max hashing.

Every document is its set of distinct 5-word shingles. Under each of
``PERMUTATIONS`` permutations of the shingle hashes both the smallest and the
largest value are kept: either agrees for two sets with probability equal to
their Jaccard similarity, so one hash evaluation gives two signature values.
The first values are banded; documents that share a band are compared on their
full sets, so a link is never a guess, and components of links are the groups.

With 40 bands of 5 values a pair at similarity 0.75 is missed with probability
2e-5, one at 0.80 with 1e-7.

Within a band's bucket pairs are not emitted. Documents with equal sets are
first folded into one representative; each member of a bucket is compared with
the bucket's smallest id; only where a bucket then still holds more than one
component are members of different components compared, inside tasks, in blocks
of bounded weight that give out linked pairs only. Before texts are read,
a pair must agree in size and in a sketch of three bits of each signature value:
at similarity 0.75 some 400 of the 512 agree with a deviation of 9.4, so the
bound of 349 costs seven such links in a hundred million, far fewer than the bands
themselves; it spares the texts of most pairs well under 0.65. A pair comes out of the first band it shares only. Nothing is capped.

Defined results: null or wordless text has an empty set, links with nothing and
is kept; one to four words make one shingle of the whole sequence; repeated rows
and ties fall to the smallest ``doc_id``; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.joins import join_per_key
from quire.llm.common import (
    LOWER,
    map_texts,
    mix,
    prefix_hash,
    small_batches,
    span_hash,
    text_of,
    word_spans,
)
from quire.llm.links import components
from quire.session import cut_lineage

WORDS = 5
PERMUTATIONS = 256
ROWS = 5
BANDS = 40

_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW_FACTORS = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALTS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
_WORD_FACTORS = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH_BITS = 3
SKETCH_GROUPS = 2 * PERMUTATIONS // 64
SKETCH_AGREE = 349  # of 2 * PERMUTATIONS
CELL = 1 << 20  # what a block weighs about: shingles and, per row, its bands and sketch
ROW_WEIGHT = 2 * (BANDS + SKETCH_GROUPS * SKETCH_BITS)
_COLUMNS = 8192  # shingles permuted at once, so that the block stays in cache


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    data = LOWER[data]
    start, end, doc = word_spans(data, at)
    h = span_hash(prefix_hash(data), start, end)
    n = len(at) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        runs = np.zeros(m, np.uint64)
        for k in range(WORDS):
            runs = mix(runs + h[k : k + m] * _WORD_FACTORS[k])
    sets = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            sets.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                whole = mix(whole + h[a + k : a + k + 1] * _WORD_FACTORS[k])
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value of the set under each permutation."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), _COLUMNS):
        values = _FACTORS[:, None] * short[None, i : i + _COLUMNS]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the signatures' first values."""
    values = signatures[:, : ROWS * BANDS].reshape(len(signatures), ROWS, BANDS).astype(np.uint64)
    keys = np.broadcast_to(_BAND_SALTS, (len(signatures), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys + (values[:, k, :] + np.uint64(1)) * _ROW_FACTORS[k])
    return keys.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Three bits of every signature value, as planes: a long has one bit of 64 values."""
    bits = (signatures * np.uint32(0x9E3779B1)) >> np.uint32(32 - SKETCH_BITS)
    planes = np.stack([(bits >> np.uint32(k)) & np.uint32(1) for k in range(SKETCH_BITS)], axis=2)
    planes = planes.reshape(len(signatures), SKETCH_GROUPS, 64, SKETCH_BITS).astype(np.uint64)
    longs = (planes << np.arange(64, dtype=np.uint64)[:, None]).sum(axis=2, dtype=np.uint64)
    return longs.reshape(len(signatures), SKETCH_GROUPS * SKETCH_BITS).view(np.int64)


def _agree():
    """Whether enough values agree; the first half of the values alone rules out most pairs."""
    differ = []
    for g in range(SKETCH_GROUPS):
        x = None
        for k in range(g * SKETCH_BITS, (g + 1) * SKETCH_BITS):
            y = F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b"))
            x = y if x is None else x.bitwiseOR(y)
        differ.append(F.bit_count(x))
    most = F.lit(2 * PERMUTATIONS - SKETCH_AGREE)
    half = sum(differ[1 : SKETCH_GROUPS // 2], differ[0])
    return (half <= most) & (half + sum(differ[SKETCH_GROUPS // 2 + 1 :], differ[SKETCH_GROUPS // 2]) <= most)


def _signed(rows, data, at):
    sets = shingle_sets(data, at)
    sizes = np.array([len(s) for s in sets], np.int64)
    prints = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        prints[i] = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    signatures = np.stack([signature(s) for s in sets])
    keys = band_keys(signatures)
    made = {
        "doc_id": rows["doc_id"],
        "n_shingles": pa.array(sizes),
        "print_a": pa.array(prints[:, 0].view(np.int64)),
        "print_b": pa.array(prints[:, 1].view(np.int64)),
        "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())),
    }
    sketch = sketches(signatures)
    return made | {f"s{k}": pa.array(sketch[:, k]) for k in range(sketch.shape[1])}


def _sets(rows, data, at):
    sets = [s.tobytes() for s in shingle_sets(data, at)]
    return {"doc_id": rows["doc_id"], "shingles": pa.array(sets, pa.binary())}


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(both) > 0 and 100 * shared >= 75 * (len(both) - shared)


def _confirmed(batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        good = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            good[i] = _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
        if good.any():
            yield pa.RecordBatch.from_pydict({"a": a[good], "b": b[good]})


def shingle_table(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full sets of the documents ``ids`` (doc_id), written once.

    The ids grow with the documents, so their join is a sorted one at any size.
    """
    texts = texts.join(ids.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    return cut_lineage(map_texts(texts, ["doc_id"], "text", _sets, "doc_id long, shingles binary"))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked; the two joins to the full sets have plain sides, which Spark splits where an id is hot."""
    sets = shingle_table(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().toDF("doc_id"), texts)
    full = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long")


def _celled(rows: DataFrame, weight) -> DataFrame:
    """``rows`` (band, id, ...) with their block ``own`` of the bucket, once for each cell (i, j) of two blocks they take part in.

    Blocks are dealt by the id's hash so that each weighs about ``CELL``; a bucket of one block has one cell.
    """
    blocks = rows.groupBy("band").agg(F.ceil(F.sum(weight) / CELL).cast("int").alias("blocks"))
    met = join_per_key(rows, cut_lineage(blocks), ["band"])
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("*", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return met.drop("other", "blocks").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _cells(batches) -> Iterator[pa.Table]:
    """The rows of each cell of batches that come sorted by (band, i, j)."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            mine = tuple(keys[:, lo])
            if mine != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of a cell that may be linked and are not: other components, sizes and sketches that allow the
    similarity, no band shared before this one, and for a cell of two blocks one row of each."""
    cell = cell.combine_chunks()
    get = {c: cell.column(c).to_numpy() for c in ("i", "j", "own", "component", "n", "place")}
    planes = [cell.column(f"s{k}").to_numpy() for k in range(SKETCH_GROUPS * SKETCH_BITS)]
    planes = np.stack(planes, axis=1).view(np.uint64).reshape(len(cell), SKETCH_GROUPS, SKETCH_BITS)
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cell), BANDS)
    two, most = get["i"][0] != get["j"][0], 2 * PERMUTATIONS - SKETCH_AGREE
    n = get["n"]
    for x in range(len(cell) - 1):
        ok = get["component"][x + 1 :] != get["component"][x]
        low, high = np.minimum(n[x + 1 :], n[x]), np.maximum(n[x + 1 :], n[x])
        ok &= 100 * low >= 75 * high
        if two:
            ok &= get["own"][x + 1 :] != get["own"][x]
        y = np.flatnonzero(ok) + x + 1
        if not len(y):
            continue
        differ = np.bitwise_or.reduce(planes[y] ^ planes[x], axis=2)
        y = y[np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most]
        if len(y):
            before = int(get["place"][x])
            y = y[(bands[y, :before] != bands[x, :before]).all(axis=1)]
        if len(y):
            yield x, y


def _with_candidates(batches):
    """(band, id) of the rows that have a candidate in their cell."""
    for cell in _cells(batches):
        some = np.zeros(len(cell), bool)
        for x, y in _candidates(cell):
            some[x] = True
            some[y] = True
        if some.any():
            yield pa.RecordBatch.from_pydict({c: cell.column(c).to_numpy()[some] for c in ("band", "id")})


def _linked_in_cell(batches):
    """The linked pairs (a, b) among the candidates of each cell, by their full sets, that join two components."""
    for cell in _cells(batches):
        ids, component = cell.column("id").to_numpy(), cell.column("component").to_pylist()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell.column("shingles")]
        parent = {c: c for c in component}

        def head(c, parent=parent):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = [], []
        for x, y in _candidates(cell):
            for k in y.tolist():
                one, other = head(component[x]), head(component[k])
                if one != other and _similar(sets[x], sets[k]):
                    parent[one] = other
                    a.append(max(ids[x], ids[k]))
                    b.append(min(ids[x], ids[k]))
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_across(members: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between rows of one bucket and different components; ``members`` (band, place, id, component).

    Rows are compared inside tasks, in cells of two blocks of a bucket, and only linked pairs come out. First the
    sketches alone tell which rows have a candidate; only those are met with their full sets.
    """
    columns = ["band", "id", "component", "place"]
    rows = members.select(*columns).join(facts, "id")
    some = _celled(rows, F.lit(ROW_WEIGHT)).mapInArrow(_with_candidates, "band long, id long").distinct()
    some = cut_lineage(some)
    sets = shingle_table(some.select(F.col("id").alias("doc_id")).distinct(), texts).withColumnRenamed("doc_id", "id")
    found = cut_lineage(some.join(rows, ["band", "id"])).join(sets, "id")
    return _celled(found, F.col("n") + ROW_WEIGHT).mapInArrow(_linked_in_cell, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, set_id (smallest doc_id with an equal set)."""
    small_batches(docs)
    texts = text_of(docs, key, text)
    sketch = [f"s{k}" for k in range(SKETCH_GROUPS * SKETCH_BITS)]
    signed = cut_lineage(
        map_texts(
            texts,
            ["doc_id"],
            "text",
            _signed,
            "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, "
            + ", ".join(f"{s} long" for s in sketch),
        )
    )
    same = ["print_a", "print_b", "n_shingles"]
    heads = cut_lineage(signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("set_id")))
    chosen = signed.join(heads.select(F.col("set_id").alias("doc_id")), "doc_id")
    chosen = cut_lineage(chosen.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", *sketch))
    facts = chosen.select("id", "n", "bands", *sketch)

    rows = chosen.select("id", F.posexplode("bands").alias("place", "band"))
    buckets = rows.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("top")).where("head < top")
    buckets = cut_lineage(buckets)
    members = cut_lineage(rows.join(buckets.select("band", "head"), "band"))
    sides = facts.drop("bands")
    stars = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    stars = stars.join(_side(sides, "a"), "a").join(_side(sides, "b"), "b").where(_plausible()).select("a", "b")
    stars = cut_lineage(stars)
    links = cut_lineage(confirm(stars, texts))
    parts = cut_lineage(components(links))

    # members of one bucket in different components, and not compared yet
    told = members.join(parts, "id", "left").select("band", "place", "id", F.coalesce("component", "id").alias("component"))
    told = cut_lineage(told)
    mixed = told.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mixed = cut_lineage(told.join(cut_lineage(mixed.select("band")), "band"))
    cross = links_across(mixed, facts, texts)
    links = cut_lineage(links.unionByName(cross))
    parts = cut_lineage(components(links).withColumnRenamed("id", "set_id"))

    named = cut_lineage(heads.join(parts, "set_id", "left"))
    out = signed.select("doc_id", *same).join(named, same, "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "set_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "set_id", "doc_id")).alias("kept"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
    )


def _side(df: DataFrame, name: str) -> DataFrame:
    """The columns with ``name`` at their end, and the id as ``name`` itself."""
    return df.select(*[F.col(c).alias(name if c == "id" else f"{c}{name}") for c in df.columns])


def _plausible():
    """Sizes and sketches of the two sides allow the similarity."""
    like = 100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")
    return like & _agree()
