"""Token alignment against loops over byte offsets, with the tokenizers' own libraries."""

import collections
import hashlib
import os
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from llm_rows import awkward, by_id, docs  # noqa: F401
from tokenizers import Tokenizer

from quire.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    None, "", " ", "one", "two  spaces", "tab\there", "line\nbreak", "über größer naïve", "日本語のテキスト", "😀 emoji 🏳️‍🌈 flags",
    "<|endoftext|> <s> </s> <unk>", "don't we'll I've", "a" * 500, "=" * 300 + " -- " + "-" * 77, "3.14159 26535 89793", "▁mark",
    "the cat sat on the mat", "the cat sat on the hat", "ﬁ ligature", "x y", "end ",
]


@pytest.fixture(scope="module")
def kits():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(texts, kits):
    """The contract, document by document and offset by offset."""
    a, b = kits
    chars = alignment.byte_characters()
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], collections.Counter()
    for text in texts:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        sides = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids[0]], [spell_b(i) for i in ids[1]]
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(s) != want for s in sides):
            rows.append(None)
            continue
        ends = [set(np.cumsum([len(t) for t in s]).tolist()) for s in sides]
        cuts = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            at, g = 0, 0
            for i, t in zip(ids[k], sides[k], strict=True):
                groups[g][k].append(i)
                at += len(t)
                g += at == cuts[g]
        links = collections.Counter((x, y) for gx, gy in groups for x in gx for y in gy)
        held.update(links.keys())
        rows.append((len(ids[0]), len(ids[1]), groups, links))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        form = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(n for (x, y), n in links.items() if held[x, y] == top[x])
        total = sum(held[p] * n for p, n in links.items())
        out.append((n_a, n_b, len(groups), sum(links.values()), best, total, hashlib.sha256(form.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("share", [alignment.SHARE, 2.0])
def test_against_offsets(awkward, kits, share):
    got = by_id(alignment.digests(awkward(*TEXTS), *FILES, share), *COLUMNS)
    want = brute(TEXTS, kits)
    assert got == dict(enumerate(want))
    assert [w[0] for w in want][:3] == [0, 0, 0] or want[2][0] >= 0


def test_repeated_rows_and_null_ids(docs, kits):
    rows = [(5, "the cat"), (5, "the cat"), (None, "the cat"), (None, "a dog"), (6, None)]
    got = alignment.digests(docs(*rows), *FILES).collect()
    want = [(k, *w) for (k, _), w in zip(rows, brute([t for _, t in rows], kits), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("share", [alignment.SHARE, 1e-4])
def test_documents(spark, kits, share):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_id(alignment.digests(given, *FILES, share), *COLUMNS)
    rows = given.select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], kits), strict=True))
    assert alignment.digests(given.limit(0), *FILES).count() == 0


def test_large_groups_are_folded(monkeypatch):
    rng = np.random.default_rng(3)
    na, nb = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
    a, b, owner = rng.integers(0, 5, na.sum()), rng.integers(0, 5, nb.sum()), np.sort(rng.integers(0, 7, 200))
    plain = alignment.linked_pairs(a, b, na, nb, owner, 3, 6)
    monkeypatch.setattr(alignment, "FOLDED", 12)
    monkeypatch.setattr(alignment, "EXPANDED", 10)
    folded = alignment.linked_pairs(a, b, na, nb, owner, 3, 6)
    assert all((x == y).all() for x, y in zip(plain, folded, strict=True)) and plain[1].sum() == (na * nb).sum()


def test_intervals_that_overlap_share_a_group():
    rng = random.Random(2)
    for _ in range(200):
        start = np.array([rng.randrange(30) for _ in range(8)])
        end = start + np.array([rng.randrange(1, 6) for _ in range(8)])
        group = alignment.coalesce(start, end)
        covered = {x for s, e in zip(start.tolist(), end.tolist(), strict=True) for x in range(2 * s + 1, 2 * e)}
        name = {x: sum(1 for y in range(x) if y not in covered and y + 1 in covered) for x in covered}
        assert group.tolist() == [name[2 * s + 1] - 1 for s in start.tolist()]


def test_ranks_equal_the_merge_list(kits):
    rng = random.Random(4)
    kit = alignment.Tokenizers(*FILES)
    pool = "aehilnorstuüé ßñ日本の\n\t  .,;:!?'\"-=0123456789😀 ABCDE"
    texts = [" " + "".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(3000)]
    want = [e.ids for e in kits[0].encode_batch(texts, add_special_tokens=False)]
    assert [kit.a.encode_ordinary(t) for t in texts] == want
