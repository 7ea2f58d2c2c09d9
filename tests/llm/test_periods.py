"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_rows import awkward, docs  # noqa: F401

from quire.llm import periods

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "a " * 6, "a " * 5, "é " * 9, "x y " * 4, "x y " * 3, "x\x0by\x0cx y x  y", "lorem " * 20000]


def brute(words, exponent=4, shortest=6):
    """Every maximal stretch of every period, kept under its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, exponent * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def altered(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digest(doc_id, text):
    words = altered(doc_id, text)
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs),
        " ".join(w for i, w in enumerate(words) if i not in gone),
    )]
    return (doc_id, len(runs), *top, *sha)


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 1)])
def test_runs_of_random_words(exponent, shortest):
    rng = random.Random(exponent)
    texts = []
    for _ in range(300):
        base = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 40))]
        texts.append((base * rng.randrange(1, 6))[: rng.randrange(1, 90)] + [rng.randrange(3) for _ in range(rng.randrange(9))])
    names = np.array([w for t in texts for w in t], np.int64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periods.runs_of(names, at, exponent, shortest)
    want = [(k, *r) for k, t in enumerate(texts) for r in brute(t, exponent, shortest)]
    assert [tuple(r) for r in got.tolist()] == want


def test_ordered_positions():
    rng = random.Random(1)
    values = rng.sample(range(10**6), 6000)
    held = periods.Positions(values[0])
    for k, p in enumerate(values[1:], 1):
        if k % 500 == 0:
            known = sorted(values[:k])
            assert held.around(p) == (max((x for x in known if x < p), default=-1), min((x for x in known if x > p), default=-1))
        held.add(p)
    assert list(held) == sorted(values) and held.size == 6000


def test_digests_of_odd_rows(awkward):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(7, ODD[7]), (7, "b " * 8), (None, "c " * 7), (None, "c " * 7)]
    got = [tuple(r) for r in periods.digests(awkward(*rows)).collect()]
    quick = [(k, t) for k, t in rows if not t or len(t) < 1000]
    want = [digest(k, t) for k, t in quick]
    assert sorted(map(repr, (r for r in got if r[0] != 10))) == sorted(map(repr, want))
    (long,) = [r for r in got if r[0] == 10]
    assert long[1:5] == (1, 0, 20000, 1)


def test_general_operator(docs):
    got = periods.periodic_runs(docs("q a b a b a b z"), exponent=3).first()
    assert got["n_words"] == 8 and got["collapsed"] == "q a b z"
    assert [tuple(r) for r in got["runs"]] == [(1, 6, 2)]
    with pytest.raises(ValueError):
        periods.periodic_runs(docs("a"), exponent=1)


def test_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in periods.digests(given).collect())
    texts = [r for r in given.select("doc_id", "text").collect() if len(r["text"] or "") < 30_000]
    known = {r[0] for r in texts}
    assert [r for r in got if r[0] in known] == sorted(digest(r["doc_id"], r["text"]) for r in texts)
    assert len(got) == given.count() and sum(r[1] > 0 for r in got) > 10
    assert periods.digests(given.limit(0)).count() == 0
