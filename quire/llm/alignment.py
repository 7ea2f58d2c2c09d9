"""Alignment of two tokenizers' tokens by interval coalescing.

Tokenizer A is a byte-level BPE, B a piece model that adds a leading space. Both
spell the same bytes, so every token is an interval of byte offsets. All intervals
of A and B are sorted by start (``lexsort``), the running maximum of their ends is
accumulated, and a new group begins where a start reaches that maximum: no token
covers the offset. The tokens of A and B within a group are linked, each with each.

Links are counted by pair of ids: a group is expanded inside its slice of text in
bounded pieces, a group of very many tokens after folding equal ids, so what is
held are the distinct pairs of a text, never its links. The number of documents
that hold a pair is summed over the whole corpus in Spark. To score the links,
pairs held by at least ``SHARE`` of all (document, pair) entries go to the tasks,
so there are at most 1 / ``SHARE`` of them; all others meet their counts in a
join, in which no key is then hot. Results do not depend on the share.

A's ids are those of its vocabulary file. Since that numbers its tokens in the
order of their merges, the ids double as ranks and the encoding is done by ranks,
several times as fast as by the merge list; the tests compare the two.

Defined results: null and empty texts, and texts that either tokenizer changes
(their joined bytes differ from space + text), have no tokens, zeros everywhere
and an empty ``groups``; very long texts are worked on alone and whole; ties for
an id's highest count all are best; repeated rows and null ids are rows like any
other and each counts as a document; an empty table gives no rows; other columns
are neither read nor returned.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, text_of, worker_store
from quire.session import cut_lineage

SHARE = 2.0**-21
EXPANDED = 1 << 21  # links expanded at once
FOLDED = 1 << 16  # a group of more links has its equal ids folded first
JOINED = 1 << 19  # tokens written as text at once


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones are themselves, others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers of a worker, the bytes and lengths of their tokens, and their ids as text."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"] for t in made["added_tokens"]}
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: bits of B's ids, the low ones of a pair
        self.bits = max(len(self.bytes_b) - 1, 1).bit_length()
        # A's ids end in a comma or the bar before B's; B's in a comma, a semicolon, or nothing at the end of a text
        self.written = [b"%d%s" % (i, s) for i in range(len(self.bytes_a)) for s in (b",", b"|")]
        self.written_b = len(self.written)
        self.written += [b"%d%s" % (i, s) for i in range(len(self.bytes_b)) for s in (b",", b";", b"")]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of A and B for each text; none for a text that they do not both spell."""
        given = [t or "" for t in texts]
        out = []
        for text, b in zip(given, self.b.encode(given, num_threads=1), strict=True):
            want = b" " + text.encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            same = text and b"".join([self.bytes_b[i] for i in b]) == want and b"".join([self.bytes_a[i] for i in a]) == want
            out.append((a, b) if same else ([], []))
        return out


def tokenizers_of(name_a: str, name_b: str, pattern: str) -> Tokenizers:
    """The tokenizers of files that ``SparkContext.addFile`` has sent, one pair for each worker process."""
    kept, key = worker_store(), ("align", name_a, name_b, pattern)
    if key not in kept:
        kept[key] = Tokenizers(SparkFiles.get(name_a), SparkFiles.get(name_b), pattern)
    return kept[key]


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval, from 0 in the order of starts: intervals that overlap, directly or by others, share one."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    np.greater_equal(start[order][1:], reach[:-1], out=begins[1:])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group


def _tally(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in ascending order and the sum of the weights of each (None: how often it occurs)."""
    if weights is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    at = np.flatnonzero(first)
    sums = np.diff(np.append(at, len(keys))) if weights is None else np.add.reduceat(weights, at) if len(at) else weights
    return keys[at], sums


def linked_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray, bits: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(owner << width | a << bits | b) of the distinct pairs linked by each owner, and how often.

    Group g has the next ``na[g]`` ids of A, the next ``nb[g]`` of B, and belongs to ``owner[g]``.
    """
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    links = na * nb
    keys, sums = [], []

    def keep(k, w=None):
        k, w = _tally(k, w)
        keys.append(k)
        sums.append(w)

    for g in np.flatnonzero(links > FOLDED).tolist():
        ua, ca = np.unique(ids_a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(ids_b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        step = max(EXPANDED // len(ub), 1)
        for i in range(0, len(ua), step):
            k = (owner[g] << width | ua[i : i + step, None] << bits | ub[None, :]).ravel()
            keep(k, (ca[i : i + step, None] * cb[None, :]).ravel())
    small = np.flatnonzero(links <= FOLDED)
    total = np.cumsum(links[small])
    lo = 0
    while lo < len(small):
        done = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, done + EXPANDED, "right")), lo + 1)
        some = small[lo:hi]
        n = links[some]
        g = np.repeat(some, n)
        inside = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        of_a, of_b = np.divmod(inside, nb[g])
        keep(owner[g] << width | ids_a[first_a[g] + of_a] << bits | ids_b[first_b[g] + of_b])
        lo = hi
    if len(keys) == 1:
        return keys[0], sums[0]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _tally(np.concatenate(keys), np.concatenate(sums))


def aligned(tokens: list[tuple[list[int], list[int]]], kit: Tokenizers) -> dict[str, object]:
    """Numbers of tokens, groups and links of each text, its groups as text, and its pairs with their counts."""
    n = len(tokens)
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for t in tokens for i in t[k]), np.int64, int(m.sum())) for k, m in ((0, n_a), (1, n_b)))
    size_a, size_b = kit.sizes_a[a], kit.sizes_b[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    group = coalesce(np.concatenate([end_a - size_a, end_b - size_b]), np.concatenate([end_a, end_b]))
    group_a, group_b = group[: len(a)], group[len(a) :]
    groups = int(group.max()) + 1 if len(group) else 0
    na, nb = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    cut_a, cut_b = (np.concatenate([[0], np.cumsum(m)]) for m in (n_a, n_b))
    last_a = np.cumsum(na) - 1
    owner = np.searchsorted(cut_a, last_a, "right") - 1
    width = max(len(kit.bytes_a) - 1, 1).bit_length() + kit.bits
    pairs, times = linked_pairs(a, b, na, nb, owner, kit.bits, width)
    at = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << width)

    # all ids in the order of the text form: a group's ids of A, then those of B
    before_a, before_b = np.cumsum(na), np.cumsum(nb) - nb
    codes = np.empty(len(a) + len(b), np.int64)
    ends_a = np.zeros(len(a), np.int64)
    ends_a[last_a] = 1
    ends_b = np.zeros(len(b), np.int64)
    ends_b[np.cumsum(nb) - 1] = 1
    ends_b[cut_b[1:][n_b > 0] - 1] = 2
    codes[np.arange(len(a)) + before_b[group_a]] = a * 2 + ends_a
    codes[np.arange(len(b)) + before_a[group_b]] = kit.written_b + b * 3 + ends_b
    cut = cut_a + cut_b
    form = kit.written.__getitem__
    texts = [
        b"".join(b"".join(map(form, codes[i : min(i + JOINED, hi)].tolist())) for i in range(lo, hi, JOINED)).decode()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
    ]
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(owner, minlength=n),
        "n_links": np.bincount(owner, na * nb, n).astype(np.int64) if groups else np.zeros(n, np.int64),
        "groups": texts,
        "at": at.astype(np.int32),
        "pairs": pairs & np.int64((1 << width) - 1),
        "times": times.astype(np.int64),
    }


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` has the ids as ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct linked ids as ``a << bits | b``
    (``pair_bits``) in ascending order, ``times`` the number of their links.
    """
    context = docs.sparkSession.sparkContext
    for path in (path_a, path_b):
        context.addFile(path)
    names = [p.rsplit("/", 1)[-1] for p in (path_a, path_b)]

    def run(batches):
        kit = tokenizers_of(*names, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            for i, j in slices(at, 1 << 20):
                made = aligned(kit.encode(texts[i:j]), kit)
                cuts = pa.array(made["at"])
                lists = {c: pa.ListArray.from_arrays(cuts, pa.array(made[c])) for c in ("pairs", "times")}
                plain = {c: pa.array(made[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}
                groups = {"groups": pa.array(made["groups"], pa.string())}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i)} | plain | groups | lists)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
    return text_of(docs, key, text).mapInArrow(run, schema)


def pair_bits(path_b: str) -> int:
    """How many low bits of a pair are B's id."""
    import sentencepiece

    return max(sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size() - 1, 1).bit_length()


def pair_counts(found: DataFrame, bits: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair of ``found`` (pairs), and whether its A id has no higher count."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.shiftright("pair", bits)))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # one row per id of A's vocabulary at most
    return cut_lineage(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def link_scores(found: DataFrame, counts: DataFrame, share: float = SHARE) -> DataFrame:
    """``found`` (row, pairs, times, ...) without pairs and times, with n_best and count_sum; ``counts`` (pair, n, best).

    n_best are the links whose pair is a best one, count_sum the sum of the pairs' counts over all links.
    """
    entries = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(int(entries * share), 1)
    hot = counts.where(F.col("n") >= bound).orderBy("pair").toPandas()
    hot = [hot[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))]
    sent = found.sparkSession.sparkContext.broadcast(tuple(hot))
    columns = [c for c in found.columns if c not in ("pairs", "times")]

    def run(batches):
        key, n, best = sent.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            cuts = pairs.offsets.to_numpy().astype(np.int64)
            flat, t = (x.values.to_numpy()[cuts[0] : cuts[-1]] for x in (pairs, times))
            cuts = cuts - cuts[0]
            at = np.minimum(np.searchsorted(key, flat), max(len(key) - 1, 0))
            known = key[at] == flat if len(key) else np.zeros(len(flat), bool)
            sums = []
            for value in (best, n):
                got = np.zeros(len(flat), np.int64)
                got[known] = value[at[known]] * t[known]
                run_sum = np.concatenate([[0], np.cumsum(got)])
                sums.append(pa.array(run_sum[cuts[1:]] - run_sum[cuts[:-1]]))
            left = np.concatenate([[0], np.cumsum(~known)])[cuts].astype(np.int32)
            made = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            made |= {"hot_best": sums[0], "hot_sum": sums[1]}
            made |= {c: pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known])) for c, x in (("rare", flat), ("often", t))}
            yield pa.RecordBatch.from_pydict(made)

    kept = found.select(*columns).schema
    schema = kept.simpleString()[len("struct<") : -1] + ",hot_best:bigint,hot_sum:bigint,rare:array<bigint>,often:array<bigint>"
    alone = cut_lineage(found.mapInArrow(run, schema))
    rare = alone.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", "x.rare", "x.often")
    rare = rare.join(counts.where(F.col("n") < bound).withColumnRenamed("pair", "rare"), "rare")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("rare_best"),
        F.sum(F.col("n") * F.col("often")).alias("rare_sum"),
    )
    joined = alone.join(cut_lineage(rare), "row", "left")
    total = [(F.col(f"hot_{c}") + F.coalesce(f"rare_{c}", F.lit(0))).alias(name) for c, name in (("best", "n_best"), ("sum", "count_sum"))]
    return joined.select(*columns, *total)


def digests(docs: DataFrame, path_a: str, path_b: str, pattern: str, share: float = SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty without tokens)."""
    found = align(docs, path_a, path_b, pattern)
    sha = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    # a row number of its own, written at once, keeps repeated rows of one document apart
    found = cut_lineage(found.withColumn("groups_sha256", sha).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    scored = link_scores(found, pair_counts(found, pair_bits(path_b)), share)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
