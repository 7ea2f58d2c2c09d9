"""Near copies, exact copies, repeated passages and lines against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import awkward, by_id, docs  # noqa: F401

from quire.llm import logtree, minhash, naming, suffixes

SF = "/root/testdata/sf0.001"


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_texts():
    """Families of edited copies, a shared passage, short texts, copies and blanks."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one two", "ONE two", "one two three", "a b c d e", "A B C D E"]
    passage = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.randrange(40, 200))
        texts += [" ".join(edited(rng, base, rng.randrange(0, 8))) for _ in range(rng.randrange(1, 9))]
    texts += [" ".join(words(rng, 60) + passage + words(rng, 20)) for _ in range(15)]
    texts += [texts[20]] * 5
    texts.append(" ".join(words(rng, 30000)))
    return texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    head = list(range(len(sets)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("cell", [minhash.CELL, 300])
def test_near_duplicates_equal_brute_force(awkward, near_texts, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    got = minhash.near_duplicates(awkward(*near_texts))
    assert by_id(got, "n_shingles", "component_id", "kept") == brute_components(near_texts)


def test_links_whose_sketches_agree_little(docs):
    # similarity 30 / 40, a shared band, and 361 and 354 agreeing values
    texts = [" ".join(f"w{seed}x{i}" for i in range(39)) for seed in (34930, 86309)]
    texts += [t.replace(f"w{seed}x19 ", "other ") for t, seed in zip(texts, (34930, 86309), strict=True)]
    got = by_id(minhash.near_duplicates(docs(*texts)), "component_id")
    assert got == {0: (0,), 1: (1,), 2: (0,), 3: (1,)}


def test_sketches_lose_fewer_links_than_bands():
    p, n = 0.75 + 0.25 / 2**minhash.SKETCH_BITS, 2 * minhash.PERMUTATIONS
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(minhash.SKETCH_AGREE)) < 1e-7


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    want = brute_components([texts[i] for i in range(len(texts))])
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == want


def test_signature_values_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 600 / 1400) < 0.09
    assert len(minhash.signature(a)) == 2 * minhash.PERMUTATIONS


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_duplicates(awkward, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", 8)
    long = "abcdefgh" * 9
    texts = [None, "", " \n", "a b", "ab", "a  b", long, long + "x", long[:-1] + " h", "é", "é", long, "x" * 64, "x" * 72]
    sizes = [len(t or "") for t in texts]
    want = {}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if normal(u) == normal(t)]
        keep = min(same, key=lambda j: (-sizes[j], j))
        want[i] = keep, len(same), keep == i, hashlib.sha256(normal(t).encode()).hexdigest()
    got = naming.exact_duplicates(awkward(*texts))
    assert by_id(got, "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_duplicates_of_repeated_rows(docs):
    got = naming.exact_duplicates(docs((7, "same"), (7, "same"), (3, "other"), (7, "other"))).collect()
    rows = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert rows == [(3, 3, 2, True), (7, 3, 2, False), (7, 7, 2, False), (7, 7, 2, True)]


def test_exact_duplicates_without_ids(docs):
    got = naming.exact_duplicates(docs((None, "a"), (5, "a"), (None, "b"), (None, "b "), (9, "c"), (None, "c c"))).collect()
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr)
    # of "c" and "c c" the letters are not equal; "b " has more code points than "b"
    assert rows == sorted(
        [(None, 5, 2, False), (5, 5, 2, True), (None, None, 2, False), (None, None, 2, True), (9, 9, 1, True), (None, None, 1, True)], key=repr
    )


def test_repeated_passages_without_ids(docs):
    shared = " ".join(words(random.Random(8), 60, 10**5))
    rows = [(None, f"one {shared} two"), (5, f"three {shared} four"), (None, "short"), (None, f"five {shared} six")]
    want = brute_repeats([t for _, t in rows], 200)
    got = suffixes.digests(docs(*rows)).collect()
    made = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert made == sorted(want.values()) and sum(r["n_removed"] > 400 for r in got) == 3


def test_blocks_that_share_a_hash_are_told_apart(docs, monkeypatch):
    """With a hash of two values nearly all blocks clash, and the names still come out right."""
    monkeypatch.setattr(naming, "BLOCK", 4)
    texts = ["aaaabbbbcccc", "aaaabbbbcccd", "aaaabbbbcccc", "bbbbaaaacccc", "q", ""]
    monkeypatch.setattr(naming, "HASH", "pmod(xxhash64({}), 2)")
    got = by_id(naming.exact_duplicates(docs(*texts)), "keep_id", "group_size")
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[i] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.fixture(scope="module")
def repeat_texts():
    rng = random.Random(9)

    def prose(n):
        return " ".join(words(rng, n, 10**5))

    shared, edge = prose(60), prose(34)
    texts = [None, "", "short", "é" * 130, prose(100)]
    texts += [prose(rng.randrange(0, 40)) + " " + shared + " " + prose(rng.randrange(0, 40)) for _ in range(30)]
    texts += [prose(10) + edge[:k] + prose(10) for k in (198, 199, 200, 201)] + [edge]
    texts += ["the " * 300, "ab" * 99, "x" * 200, "x" * 201, texts[4], prose(2000)]
    texts.append(texts[-1][:3000] + "!" + texts[-1][3000:])
    return texts


@pytest.mark.parametrize("group", [256, 4])
def test_repeated_passages_equal_brute_force(awkward, repeat_texts, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    got = suffixes.digests(awkward(*repeat_texts))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(repeat_texts, 200)


def test_repeated_rows_lose_everything(docs):
    text = " ".join(words(random.Random(1), 80))
    got = suffixes.digests(docs((1, text), (1, text), (1, "other"))).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(5, 0), (len(text), len(text)), (len(text), len(text))]


def test_suffix_array_equals_sorting():
    rng = random.Random(3)
    for k in range(600):
        text = bytes(rng.choice(b"ab" if k % 3 else b"abcd") for _ in range(rng.randint(0, 60)))
        if k % 5 == 0:
            text = (text[:7] * 9)[:60]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_of_short_lyndon_prefixes_equal_the_linear_ones():
    rng = random.Random(8)
    for _ in range(200):
        text = bytes(rng.choices(b"ab\x00\xff"[: rng.randint(1, 4)], k=rng.randint(1, 40))) * rng.randint(1, 3)
        before, after = suffixes.smaller_suffixes(text)
        assert suffixes.prefix_groups(text, after) == suffixes.lyndon_groups(text, before)


def test_contexts_of_texts_side_by_side_equal_those_of_each(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdé ", k=n)) for n in (0, 10, 199, 200, 150, 400, 1000, 3, 700, 250, 90)]
    texts += ["a" * 1500, None, "ab" * 400, texts[6] + texts[6], "x"]

    def found(limit):
        monkeypatch.setattr(suffixes, "TOGETHER", limit)
        number = pa.array(range(len(texts)))
        batch = pa.RecordBatch.from_arrays([number, number, pa.array(texts)], ["doc_id", "print", "text"])
        return sorted(tuple(r.values()) for made in suffixes._contexts([batch]) for r in made.to_pylist())

    hashed = []
    hash_of = suffixes.span_hash
    monkeypatch.setattr(suffixes, "span_hash", lambda p, a, b: (hashed.append(len(a)), hash_of(p, a, b))[1])
    together = found(1 << 16)
    assert len(hashed) == 2  # one pass for all grams and one for all contexts, not two for each text
    assert together == found(1)
    windows = [max(len((t or "").encode()) - suffixes.LENGTH + 1, 0) for t in texts]
    held = collections.Counter()
    for doc, _, _, _, _, n, _ in together:
        held[doc] += n
    assert [held[k] for k in range(len(texts))] == windows
    assert {r[0] for r in together if r[6]} == {11, 13, 14}  # whose anchors recur


def test_contexts_hash_a_text_once(monkeypatch):
    hashed, prefix_hash = [], suffixes.prefix_hash
    monkeypatch.setattr(suffixes, "prefix_hash", lambda data: hashed.append(len(data)) or prefix_hash(data))
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc ", k=700)), "ab" * 300, "short"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "print", "text"])
    found = pa.Table.from_batches(suffixes._contexts([batch])).to_pydict()
    assert hashed == [700, 600]
    # the contexts of a text cover its windows, and only the periodic text's anchors recur
    for doc, text in ((1, texts[0]), (2, texts[1])):
        mine = [(a, n, r) for d, a, n, r in zip(found["doc_id"], found["first"], found["n"], found["recurs"], strict=True) if d == doc]
        assert [x for a, n, _ in mine for x in range(a, a + n)] == list(range(len(text) - suffixes.LENGTH + 1))
        assert {r for _, _, r in mine} == {doc == 2}


def test_recurring_lines(awkward):
    fresh = ["unlike any other line at all", "nothing here comes back again"]
    texts = [f"Page {k} of 9 in all\nhello there number {'abcdefgh'[k]} my friend\n{fresh[k % 2]} {k * 'z'}\n\nAll rights reserved." for k in range(6)]
    texts += [None, "", "All rights reserved.\nAll rights reserved.", "a single line"]
    got = by_id(logtree.without_recurring(awkward(*texts)), "n_lines", "n_dropped", "text")
    assert got[6] == got[7] == (1, 0, "")
    assert got[8] == (2, 2, "")
    assert got[9] == (1, 0, "a single line")
    assert got[2] == (5, 3, f"{fresh[0]} zz\n")


def test_empty_tables(docs, spark):
    none = docs("x").where("false")
    assert minhash.near_duplicates(none).count() == 0
    assert naming.exact_duplicates(none).count() == 0
    assert suffixes.digests(none).count() == 0
    assert logtree.digests(none).count() == 0
