"""Rules, classifier, tokens, packing, scores and page text against brute force, other libraries and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_rows import awkward, by_id, docs  # noqa: F401
from tokenizers import Tokenizer

from quire.llm import bpe, contexttree, discriminant, forest, packing, template
from quire.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "é" * 3, "a b a b a b", "x\ny\nx\n \nx", "😀 #$ <b>", "the " * 30000]


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_rule_statistics(awkward, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(forest.quality_rules(awkward(*ODD), labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute_statistics(t) for i, t in enumerate(ODD)}


def test_rules_on_documents(spark):
    docs_, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = forest.quality_rules(docs_, labels)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = by_id(got, *columns, "kept")
    texts = dict(docs_.select("doc_id", "text").collect())
    assert {i: r[:-1] for i, r in rows.items()} == {i: brute_statistics(t) for i, t in texts.items()}
    assert not any(r[-1] and r[-2] for r in rows.values())
    marks = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if not rows[r["doc_id"]][-2]]
    right = [kept == (quality == 1) for (*_, kept), quality in marks]
    assert sum(right) >= 0.97 * len(right)


def test_isolation_forest_finds_the_far_rows():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (5, 3))])
    scored = forest.scores(forest.fit(rows), rows, len(rows))
    assert set(np.argsort(scored)[-5:]) == set(range(500, 505))
    assert forest.scores([], rows, 0).shape == (505,)


def test_classifier_on_held_out_rows(spark):
    docs_, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = by_id(discriminant.quality_scores(docs_, labels), "held_out", "score", "predicted")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= s <= 1 and p == (s >= 0.7) for i, (h, s, p) in got.items())
    held = [(got[r["doc_id"]][2], r["quality"]) for r in labels.collect() if got[r["doc_id"]][0]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_classifier_learns_nothing_from_held_out_rows(spark):
    docs_, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (by_id(discriminant.quality_scores(docs_, x), "score") for x in (labels, turned))
    assert a.keys() == b.keys() and all(math.isclose(a[i][0], b[i][0], rel_tol=1e-6, abs_tol=1e-12) for i in a)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1)] * 3, 1.0), ([(1, 0)] * 3, 0.0), ([(1, None)], 0.5)])
def test_classifier_without_two_classes(awkward, spark, labels, score):
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = by_id(discriminant.quality_scores(awkward(*ODD), marks), "score")
    assert got == {i: (score,) for i in range(len(ODD))}


def test_log_density_equals_the_formula():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (200, 4)), rng.normal(1, 2, (100, 4))]
    model = discriminant.Discriminant(
        np.array([200.0, 100.0]), np.stack([v.sum(axis=0) for v in x]), np.stack([v.T @ v for v in x])
    )
    logs = []
    for k in range(2):
        cov = model.factors[k] @ model.factors[k].T
        d = x[0][:5] - model.means[k]
        logs.append(model.priors[k] - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x[0][:5]), 1 / (1 + np.exp(logs[0] - logs[1])))


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


def test_bpe_equals_tiktoken(ranks):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "😀", "́", "ing", "2024", "'s", "\t", "中", "aaaaaaaa", "=", "====", "\x00", "​", " ", "İ"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == whole.encode_ordinary(text)
        assert "".join(codec.decode_stream(ids)) == text


def test_small_stores_change_nothing(ranks, monkeypatch):
    text = " ".join(f"word{k % 97}x{k}" for k in range(3000))
    want = bpe.Codec(ranks, public_tokenizers.PATTERN).encode(text)
    for name in ("KEPT_STATES", "KEPT_PIECES", "KEPT_WORDS"):
        monkeypatch.setattr(bpe, name, 50)
    assert bpe.Codec(ranks, public_tokenizers.PATTERN).encode(text) == want


def test_utf8_machine_equals_python():
    rng = random.Random(2)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xED, 0xA0, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 12)))
        machine, cut = bpe.Utf8Machine(), rng.randint(0, len(data))
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.end() == data.decode(errors="replace")


def test_bpe_digests_and_round_trip(awkward, ranks):
    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(awkward(*ODD), path, pattern), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(ODD):
        ids = whole.encode_ordinary(t or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode())]
        assert got[i] == (len(ids), *sha)
    encoded = bpe.encode_documents(awkward(*ODD), path, pattern)
    assert by_id(bpe.decode_documents(encoded, path, pattern), "text") == {i: (t or "",) for i, t in enumerate(ODD)}


def test_packing(awkward):
    texts = ODD + ["word " * n for n in (4095, 4096, 8191, 2000, 2094)] + ["same words here"] * 40
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = packing.pack(awkward(*texts), tokenizer_file("word_bpe_49k.json")).collect()
    check_packing(got, texts, tokenizer)


def check_packing(got, texts, tokenizer):
    found = collections.defaultdict(list)
    rows = collections.defaultdict(dict)
    for r in got:
        rows[r["doc_id"]][r["piece"]] = r
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert sorted(rows[i]) == list(range(-(-len(ids) // 4096)))
        for k, r in rows[i].items():
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * k, len(part), zlib.crc32(part.tobytes()))
    for places in found.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(found), total


def test_packing_of_documents_is_tight(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs_.orderBy("doc_id").collect()]
    got = packing.pack(docs_, tokenizer_file("word_bpe_49k.json")).collect()
    sequences, total = check_packing(got, texts, Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")))
    assert sequences <= 1.01 * -(-total // 4096) + 1


def test_words_equal_whole_texts():
    words, rng = packing.Words(tokenizer_file("word_bpe_49k.json")), random.Random(3)
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    parts = ["a", "the", " ", "\n", "é", "é", "😀", "́", " ́", "2024", "'s", "\x1c", " ", "\u0085", "Σ", "ΟΔΟΣ", "İ", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.ids(texts) == want


class Counted(dict):
    """A store that counts how often it is asked."""

    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_packing_looks_a_repeated_word_up_once():
    words = packing.Words(tokenizer_file("word_bpe_49k.json"))
    words.known = Counted(words.known)
    texts = ["Alpha beta, größer " * 200] * 10 + ["", " ", "beta,"]
    got = words.ids(texts)
    assert words.known.asked <= 10
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want


def test_packing_learns_a_match_once_whatever_its_case_and_marks(monkeypatch):
    words, learnt = packing.Words(tokenizer_file("word_bpe_49k.json")), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new, whole: (learnt.extend(new), learn(new, whole)))
    texts = ["Größe größe. GRÖSSE, größe! (Größe) größe's GRÖßE;", "don't DON'T ''s x'rest i'LL 'a' '", "a\u0301 <|endoftext|>x 12\u00b2"]
    got = words.ids(texts)
    assert len(learnt) == len(set(learnt)) and learnt.count("größe".encode()) == 1
    assert b"don" in learnt and b"'t" in learnt and b"DON'T" not in learnt
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want


def test_packing_stores_of_any_size_give_the_same_ids(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcÀßŁȺ'st.,7 \n漢") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want = packing.Words(tokenizer_file("word_bpe_49k.json")).ids(texts)
    for name, value in (("KEPT_WORDS", 30), ("STEP", 20), ("LINES", 7), ("SLICE", 500)):
        monkeypatch.setattr(packing, name, value)
    small = packing.Words(tokenizer_file("word_bpe_49k.json"))
    assert small.ids(texts) == want
    assert len(small.known) <= 50


def test_byte_bpe_looks_a_repeated_word_up_once(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    codec.words = Counted(codec.words)
    text = "\n  indented" + " word größer 12,5\u00a0%  x" * 200 + " "
    got = codec.encode(text)
    assert codec.words.asked <= 10 and codec.words
    want = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert got == [i for piece in want.split(text) for i in want.machine.ids(piece.encode())]


def test_plans_use_up_every_length():
    rng = np.random.default_rng(4)
    for lengths in ([], [4096], [1] * 9000, list(rng.integers(1, 4097, 3000)), [1000, 2000, 1096] * 50, [3000] * 10 + [1096] * 10):
        counts = np.bincount(np.array(lengths, int), minlength=packing.SEQUENCE + 1)
        used = np.zeros_like(counts)
        made = packing.plan(counts)
        for pattern, times in made:
            assert sum(pattern) <= packing.SEQUENCE
            np.add.at(used, list(pattern), times)
        assert (used == counts).all()
    assert sum(t for _, t in made) == 10


def test_base_scores(awkward):
    texts = [*ODD, "The the THE cat", "cat dog", "new words only", "cat"] * 3
    rows = [(i, (t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 10 == 0) for i, t in enumerate(texts)]
    count = collections.Counter(w for _, ws, h in rows if not h for w in ws)
    n, scale = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    got = by_id(contexttree.score(awkward(*texts)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for i, ws, held in rows:
        assert got[i][:4] == (held, len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(got[i][4], sum(math.log10(count[w] + 0.1) - scale for w in ws), rel_tol=1e-9)


def brute_tree(train, depth):
    """Node counts and weights of every context, from the definition."""
    nodes = collections.defaultdict(lambda: [0, 0])
    for text in train:
        data = bytes([255]) * depth + text + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (1 << bit) | (data[i] >> (8 - bit))
                    nodes[data[i - d : i], node][(data[i] >> (7 - bit)) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    below, weight, stop = collections.defaultdict(float), {}, {}
    for ctx, node in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(*nodes[ctx, node])
        if len(ctx) == depth:
            weight[ctx, node], stop[ctx, node] = own, 1.0
        else:
            deep = below[ctx, node]
            top = max(own, deep)
            weight[ctx, node] = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(deep - top))
            stop[ctx, node] = math.exp(math.log(0.5) + own - weight[ctx, node])
        if ctx:
            below[ctx[1:], node] += weight[ctx, node]
    return nodes, stop


def brute_score(text, nodes, stop, depth):
    data, total = bytes([255]) * depth + text + b"\xff", 0.0
    for i in range(depth, len(data)):
        for bit in range(8):
            node, one = (1 << bit) | (data[i] >> (8 - bit)), (data[i] >> (7 - bit)) & 1
            got, rest, q = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (data[i - d : i], node)
                if key not in nodes:
                    break
                zero = (nodes[key][0] + 0.5) / (sum(nodes[key]) + 1)
                q = got + rest * zero
                got, rest = got + rest * stop[key] * zero, rest * (1 - stop[key])
            total += math.log10(1 - q if one else q)
    return total


def test_scores_equal_the_context_tree(awkward):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "Then", "hen", "éa", "ten"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    low = [t.encode().lower() for t in texts]
    nodes, stop = brute_tree([b for i, b in enumerate(low) if zlib.crc32(str(i).encode()) % 10], contexttree.DEPTH)
    got = by_id(contexttree.score(awkward(*texts)), "score")
    for i, b in enumerate(low):
        assert math.isclose(got[i][0], brute_score(b, nodes, stop, contexttree.DEPTH), rel_tol=1e-6)


def test_scores_of_rare_contexts_in_a_large_table(docs):
    rng = random.Random(8)
    texts = ["ab" * 16000] * 10 + ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    low = [t.encode() for t in texts]
    train = [b for i, b in enumerate(low) if zlib.crc32(str(i).encode()) % 10]
    assert sum(len(b) + 1 for b in train) > 2**18  # a cut at 2**-18 of the symbols left out their rare contexts
    nodes, stop = brute_tree(train, contexttree.DEPTH)
    got = by_id(contexttree.score(docs(*texts)), "score")
    for i, b in list(enumerate(low))[9:]:
        assert math.isclose(got[i][0], brute_score(b, nodes, stop, contexttree.DEPTH), rel_tol=1e-6)


@pytest.mark.parametrize("share", [2.0**-4, 1.0])
def test_scores_do_not_depend_on_what_is_sent(awkward, monkeypatch, share):
    texts = [*ODD[:-1], "The the THE cat", "cat dog", "new words only"] * 4
    whole = by_id(contexttree.score(awkward(*texts)), "score", "base_score")
    monkeypatch.setattr(contexttree, "GRAM_SHARE", share)
    part = by_id(contexttree.score(awkward(*texts)), "score", "base_score")
    assert all(math.isclose(x, y, rel_tol=1e-9) for i in whole for x, y in zip(whole[i], part[i], strict=True))


def test_scores_without_training_rows(docs):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = by_id(contexttree.score(docs((held[0], "ab"), (held[1], None))), "n_known", "train_tokens", "score")
    assert got[held[0]][:2] == (0, 0) and math.isclose(got[held[0]][2], 24 * math.log10(0.5))
    assert math.isclose(got[held[1]][2], 8 * math.log10(0.5))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="wrap"><{m}><h1>Head &amp; %s</h1><p>One <b>two</b>
three&nbsp;&lt;4&gt;.<p>Next <a href='x>y'>link</a></p><div class="comments"><p>Nice</p></div><form>Mail</form>
<ul><li>item<li>item two</ul></{m}><aside>Side</aside></div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"', "section"])
def test_page_text(spark, tag):
    body = PAGE.replace("<{m}>", f"<{tag}>").replace("</{m}>", f"</{tag.split()[0]}>")
    rows = [(k, f"http://host.example/{k}", body % k, "x") for k in range(4)]
    rows += [(8, "http://other.example/", None, "x"), (9, None, "", "x"), (10, "odd", "<p>a<p>b", "x"), (11, "u", "plain &eacute; text", "x")]
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    found = {r["page_id"]: r["text"] for r in got.collect()}
    for k in range(4):
        assert found[k] == f"Head & {k}\n\nOne two three <4>.\n\nNext link\n\nitem\n\nitem two"
    assert found[8] == found[9] == ""
    assert found[10] == "a\n\nb"
    assert found[11] == "plain é text"


def test_given_pages(spark):
    """On the given pages, which have an article each, the text is that of the article's blocks."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in template.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert got[r["page_id"]] == "\n\n".join(x for x in blocks if x)


def test_empty_tables(docs, spark):
    none, labels = docs("x").where("false"), spark.createDataFrame([], "doc_id long, quality int")
    assert forest.quality_rules(none, labels).count() == 0
    assert discriminant.quality_scores(none, labels).count() == 0
    assert bpe.digests(none, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert contexttree.score(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert template.extract(pages).count() == 0
