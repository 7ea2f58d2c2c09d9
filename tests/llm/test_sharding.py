"""Sharding: the law, the slots, and how many copies are parted."""

import collections
import random
import zlib

import pytest
from llm_rows import awkward, docs  # noqa: F401

from quire.llm import sharding

SF = "/root/testdata/sf0.001"


def check(got, texts, shards=16):
    """The law of rows and the facts of every row; returns the shards of each text."""
    rows = [r.asDict() for r in got.collect()]
    facts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["text_crc32"]) for r in rows))) == sorted(
        map(repr, ((i, *facts(t)) for i, t in texts))
    )
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    sizes = sorted(len(slots[s]) for s in range(shards))
    assert set(slots) <= set(range(shards)) and sizes[-1] - sizes[0] <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    spread = collections.defaultdict(collections.Counter)
    for r in rows:
        spread[r["size"], r["text_crc32"]][r["shard"]] += 1
    return spread


def parted(spread):
    """Rows of texts met more than once that are not in their text's main shard, and all rows of such texts."""
    several = [c for c in spread.values() if sum(c.values()) > 1]
    return sum(sum(c.values()) - max(c.values()) for c in several), sum(sum(c.values()) for c in several)


@pytest.mark.parametrize("n", [0, 5, 35])
def test_few_rows(docs, n):
    texts = [(k, f"text {k}") for k in range(n)]
    check(sharding.balanced_shards(docs(*texts)), texts)


def test_copies_stay_together(docs):
    rng = random.Random(1)
    texts = [f"text {k}" for k in range(600)]
    for k in range(150):
        texts += [f"copy {k}"] * rng.choice([2, 2, 3, 5, 9])
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    apart, linked = parted(check(sharding.balanced_shards(docs(*texts).repartition(6)), texts))
    assert linked > 400 and apart <= 0.02 * linked


def test_only_copies(docs):
    rng = random.Random(2)
    texts = [f"copy {k // 4}" for k in range(1200)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    apart, linked = parted(check(sharding.balanced_shards(docs(*texts).repartition(6)), texts))
    assert linked == 1200 and apart <= 0.15 * linked


def test_a_text_that_a_third_of_all_rows_have(docs):
    rng = random.Random(3)
    texts = ["hot"] * 400 + [f"copy {k // 3}" for k in range(300)] + [f"text {k}" for k in range(500)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    spread = check(sharding.balanced_shards(docs(*texts).repartition(8)), texts)
    hot = spread.pop((4, zlib.crc32(b"hot")))
    assert len(hot) <= 9  # 75 rows a shard: at least six
    apart, linked = parted(spread)
    assert apart <= 0.1 * linked


def test_odd_rows(awkward):
    texts = [(1, None), (1, ""), (None, "x"), (None, "x"), (2, "x"), (2, "é" * 100_000), (3, " ")]
    spread = check(sharding.balanced_shards(awkward(*texts)), texts)
    assert sum(spread[1, 0].values()) == 2


def test_other_numbers_of_shards(docs):
    texts = [(k, f"copy {k % 40}") for k in range(100)]
    for shards in (1, 3):
        check(sharding.balanced_shards(docs(*texts), shards), texts, shards)


def test_quotas_are_kept():
    may = sharding.granted([[0, 9, 4], [5, 0, 0], [0, 6, 0]], [0, 3, 10])
    assert may == [[0, 5 + 1, 4], [5, 0, 0], [0, 2, 0]]


def test_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
    apart, linked = parted(check(sharding.balanced_shards(given), texts))
    assert apart <= 0.05 * linked
