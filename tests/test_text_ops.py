"""Scans, scalar text, search, entities, topics, languages on hand-made rows."""

import difflib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import text as ft
from quire.functions.joins import join_per_key
from quire.operators import analysis, compare, entities, ingest, language, layout, search, tables, text, topics


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_ingest(table):
    m = table(
        "filename string, n_bytes long",
        ("a/b/ sample.PDF", 10), ("readme.txt", 10), ("big.pdf", 50 * 1024 * 1024 + 1), ("edge.pdf", 50 * 1024 * 1024), ("x.pdf ", 1),
    )
    got = {r.filename: (r.accepted, r.reason, r.safe_name) for r in ingest.ingest_validate(m).collect()}
    assert got["a/b/ sample.PDF"] == (True, None, "sample.PDF")
    assert got["readme.txt"][:2] == (False, "wrong_type")
    assert got["big.pdf"][:2] == (False, "too_large")
    assert got["edge.pdf"][0] and not got["x.pdf "][0]


def test_manifest_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    got = ingest.read_manifest(spark, str(tmp_path)).collect()
    assert got[0].n_bytes == 5 and got[0].filename.endswith("a.pdf")


def test_refresh_is_incremental(spark, table, tmp_path):
    path = str(tmp_path / "analysis")
    seen = []

    def analyse(todo):
        seen.append(sorted(r.doc_id for r in todo.collect()))
        return todo.select("doc_id", "content_hash")

    ingest.refresh(table("doc_id long, text string", (1, "a"), (2, "b")), path, analyse)
    now = table("doc_id long, text string", (1, "a"), (2, "changed"), (3, "c"))
    got = ingest.refresh(now, path, analyse)
    assert seen == [[1, 2], [2, 3]]
    # one current analysis for each document, that of its present text
    want = now.select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))
    assert sorted(rows(got)) == sorted(rows(want))


def test_page_lookup_and_spans(table, pages, spans):
    refs = table("doc_id long, page int", (1, 0), (1, 9))
    assert [r[3] for r in rows(ingest.page_lookup(pages, refs), "page")] == ["ok", "out_of_range"]
    assert ingest.text_spans(spans, 1).count() == 1
    assert ingest.text_spans(spans, 7).count() == 0
    assert ingest.doc_text(pages, " ").first().text == "Hello World Page Two Content test@example.com Page Three"


def test_doc_stats_counts_separators(pages):
    text_all = "".join(t + "\n" for t in ("Hello World", "Page Two Content test@example.com", "Page Three"))
    got = text.doc_stats(pages).first()
    assert (got.page_count, got.character_count, got.word_count) == (3, len(text_all), len(text_all.split()))
    joined = text.doc_stats(pages, " ", trailing=False).first()
    assert joined.character_count == len(text_all) - 1
    with pytest.raises(ValueError):
        text.doc_stats(pages, "-")


@pytest.mark.parametrize(
    "raw, fixed",
    [("", ""), ("a  b", "A b"), ("one.  two. three", "One. Two. Three"), ("x.Y. Z", "X.Y. Z"), ("end.", "End."), ("éa. é", "Éa. é")],
)
def test_fix_grammar(spark, raw, fixed):
    assert one(spark, raw, text.fix_grammar) == fixed


def test_small_text(spark):
    assert one(spark, " a \n\n\t b \n", text.normalize_lines) == "a b"
    assert one(spark, "\x1c x  ", ft.strip) == "x"
    assert one(spark, "aXbxc", lambda c: ft.starts_of(c, "x")) == [1, 3]
    assert one(spark, "aXbxc", lambda c: ft.starts_of(c, "x", True)) == [3]
    assert one(spark, "l1\nl2" + "z" * 200, lambda c: text.first_line(c)) == "l1"


@pytest.mark.parametrize(
    "font, flags, code",
    [
        ("BCDEEE+Helvetica-Light", 0, "helv"),
        ("Helvetica", 16, "helv"),
        ("Unknown Sans", 16, "hebo"),
        ("Unknown Sans", 18, "hebi"),
        ("Times-Bold", 16, "tibo"),
        ("Georgia", 2, "tiit"),
        ("Georgia", 8, "cour"),
        ("DejaVu Sans Mono", 0, "cour"),
        ("Courier New PS", 18, "cobi"),
    ],
)
def test_font_code(spark, font, flags, code):
    df = spark.createDataFrame([(font, flags)], "f string, g int")
    assert df.select(text.font_code(F.col("f"), F.col("g"))).first()[0] == code


def test_font_display_and_color(spark):
    df = spark.createDataFrame([("A+Courier-Times", True, False, 0xFF8000)], "f string, b boolean, i boolean, c int")
    got = df.select(
        text.font_display_name(F.col("f"), F.col("b"), F.col("i")).alias("n"), text.color_rgb(F.col("c")).alias("c")
    ).first()
    assert got.n == "Courier-Bold"
    assert (got.c.r, round(got.c.g, 6), got.c.b) == (1.0, round(128 / 255, 6), 0.0)


def test_find(spans):
    assert search.find_matches(spans, "hello").count() == 1
    assert search.find_matches(spans, "hello", match_case=True).count() == 0
    assert search.find_matches(spans, "ZZZZNONEXISTENTZZZZ").count() == 0
    hit = search.find_matches(spans, "World").first()
    assert (hit.page, hit.start, hit.match_x0, hit.match_x1) == (0, 6, 108.0, 138.0)


def test_replace_counts_spans(table, spans):
    twice = spans.withColumn("text", F.concat("text", F.lit(" Page")))
    got = rows(search.replace_text(twice, "Page", "Leaf"), "page_number")
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 1)]
    assert rows(search.replace_text(twice, "Page", "Leaf", scope=2)) == [(1, 3, 1)]
    assert search.replaced_spans(spans, "Hello", "Goodbye").where("changed").first().text == "Goodbye World"


def test_delete_and_redact(table):
    p = table("doc_id long, page int, text string", (1, 0, "The the 12/3/2024 call 123-45-6789 $5"), (1, 1, "x"))
    gone = rows(search.delete_text(p, "THE").select("page", "deleted", "text"), "page")
    assert gone == [(0, 2, "  12/3/2024 call 123-45-6789 $5"), (1, 0, "x")]
    got = search.redact_pattern(p, "ssn", "$1\\").where("page = 0").first()
    assert (got.redacted, got.text) == (1, "The the 12/3/2024 call $1\\ $5")
    assert search.redact_pattern(p, "date").where("page = 0").first().redacted == 1
    with pytest.raises(ValueError):
        search.redact_pattern(p, "iban")


def test_literal_terms_are_not_patterns(table):
    p = table("doc_id long, page int, text string", (1, 0, "a.b a+b \\E a.b"))
    assert search.delete_text(p, "a.b").first().deleted == 2
    assert search.delete_text(p, "\\E").first().text == "a.b a+b  a.b"
    assert search.term_counts(p, "a+b").where("page is null").first().occurrences == 1


def test_section_search_order(table):
    b = table("doc_id long, page int, block int, text string", (1, 0, 0, "beta"), (1, 0, 1, "ALPHA betaX"), (1, 1, 0, "alpha"), (1, 2, 0, "no"))
    q = table("query_id long, doc_id long, question string", (7, 1, "Alpha beta alpha"))
    got = rows(search.section_search(b, q, 2).select("rank", "page", "block", "relevance"), "rank")
    assert got == [(1, 0, 1, 1.0), (2, 0, 0, 0.5)]


def test_entities(table):
    p = table(
        "doc_id long, page int, text string",
        (1, 0, "Mail a.b@c.org or +1 555-123-4567. SSN 123-45-6789. Paid $1,234.50 on March 3, 2024 by Ann Smith. The White House."),
        (1, 1, "a.b@c.org Acme Widgets Inc. https://x.org/a?b=1 12/31/24 Jan 5 2024 7.50 EUR"),
    )
    got = {(r.entity_type, r.value): r.page for r in entities.entities(p).collect()}
    assert got[("emails", "a.b@c.org")] == 0
    assert got[("ssns", "123-45-6789")] == 0 and got[("phones", "123-45-6789.")] == 0
    assert got[("monetary", "$1,234.50")] == 0 and got[("monetary", "7.50 EUR")] == 1
    assert got[("dates", "March 3, 2024")] == 0 and got[("dates", "12/31/24")] == 1 and got[("dates", "Jan 5 2024")] == 1
    assert ("people", "Ann Smith") in got and ("people", "The White House") not in got
    assert ("organizations", "Acme Widgets Inc") in got or ("organizations", "Acme Widgets Inc.") in got
    assert ("urls", "https://x.org/a?b=1") in got
    assert "ssns" not in {r.entity_type for r in entities.key_info(p).collect()}


def test_any_decimal_digit_counts(table):
    p = table("doc_id long, page int, text string", (1, 0, "am \u0663/\u0664/\u0662\u0660\u0662\u0664 da"))
    assert [r.entity_type for r in entities.entities(p).collect()] == ["dates"]
    assert search.redact_pattern(p, "date").first().text == "am  da"


def test_short_dates_need_long_years(table):
    d = table("doc_id long, text string", (1, "March 3, 24 and Mar 3, 2024 and Mar 3, 2024"))
    assert [r.value for r in entities.extract_data(d, "dates").collect()] == ["Mar 3, 2024"]
    assert entities.extract_data(d, "nothing").count() == 0
    assert len(entities.extract_data_raw(d).first().dates) == 2


def test_topics(table):
    d = table("doc_id long, text string", (1, "this with café Zebra apple apple zebra caf mango"), (2, "this that"))
    got = [(r.word, r["count"]) for r in topics.key_topics(d).orderBy("rank").collect()]
    assert got == [("zebra", 2), ("apple", 2), ("mango", 1)]
    assert topics.top_topic(d).first().top_topic == "zebra"


def python_summary(text, variant):
    import re

    flat = text.replace("\n", " ")
    if variant == "analysis":
        s = [x.strip() for x in re.split(r"[.!?]+", flat) if len(x.strip()) > 20]
        if not s:
            return "No extractable text."
        n = len(s)
        return ". ".join(s if n <= 5 else [s[0], s[n // 4], s[n // 2], s[3 * n // 4], s[-1]]) + "."
    s = [x.strip() for x in flat.split(".") if x.strip() and (variant == "assist" or len(x.strip()) > 10)]
    n = len(s)
    if variant == "brief":
        if not s:
            return "No text found."
        return ". ".join(s if n <= 3 else [s[0], s[n // 3], s[2 * n // 3], s[-1]]) + "."
    return text if n <= 3 else ". ".join([s[0], s[n // 2], s[-1]]) + "."


@pytest.mark.parametrize("variant", ["analysis", "brief", "assist"])
def test_summaries(table, variant):
    texts = ["", "short."] + [
        " ".join(f"Sentence number {i} has\nenough characters." for i in range(n)) for n in (1, 3, 4, 5, 6, 7, 9, 13)
    ]
    df = table("i int, text string", *enumerate(texts))
    got = [r.s for r in df.orderBy("i").select(topics.summary(F.col("text"), variant).alias("s")).collect()]
    assert got == [python_summary(t, variant) for t in texts]


@pytest.mark.parametrize(
    "value, lang",
    [
        ("the cat and the dog", "english"),
        ("der hund und die katze", "german"),
        ("il cane della sono", "italian"),
        ("el perro pero los", "spanish"),
        ("de que", "spanish"),  # a tie goes to the earlier language
        ("  ", "unknown"),
        ("zzz", "unknown"),
        ("я вижу the cat", "russian/cyrillic"),
        ("一abcdefghi", "unknown"),  # exactly a tenth is not enough
        ("一一abcdefgh", "chinese/japanese/korean"),
        ("مرحبا the", "arabic"),
    ],
)
def test_language(table, value, lang):
    got = language.detect_language(table("doc_id long, text string", (1, value))).first()
    assert got.language == lang
    if lang == "unknown":
        assert got.confidence == 0


def test_page_similarity(table, pages):
    pairs = table("pair_id long, doc_a long, page_a int, doc_b long, page_b int", (1, 1, 1, 1, 2), (2, 1, 0, 1, 0), (3, 1, 0, 1, 5))
    got = {r.pair_id: r for r in compare.page_similarity(pages, pairs).collect()}
    assert (got[1].common_words, got[1].unique_to_a, got[1].unique_to_b, got[1].similarity) == (1, 3, 1, 0.2)
    assert got[2].similarity == 1.0
    assert got[3].error == "invalid page numbers" and got[3].similarity is None


def test_document_diff(table):
    p = table(
        "doc_id long, page int, text string",
        (1, 0, "a\nb\nc"), (2, 0, "a\nc\nd"), (1, 1, "same"), (2, 1, "same"), (1, 2, "gone"), (2, 3, "+new"),
    )
    pairs = table("pair_id long, doc_a long, doc_b long", (9, 1, 2))
    got = {r.page: r for r in compare.document_diff(p, pairs).collect()}
    assert sorted(got) == [0, 2, 3]
    assert (got[0].lines_added, got[0].lines_removed) == (1, 1)
    assert got[0].diff.split("\n")[:2] == ["--- doc1/page_1", "+++ doc2/page_1"]
    assert (got[2].lines_added, got[2].lines_removed) == (0, 1)
    assert (got[3].lines_added, got[3].lines_removed) == (1, 0)
    counts = {r.page: (r.lines_added, r.lines_removed) for r in compare.line_changes(p, pairs).collect()}
    assert all(counts[k][0] <= got[k].lines_added and counts[k][1] <= got[k].lines_removed for k in got)
    change = compare.page_count_changes(p, pairs).first()
    assert (change.pages_added, change.pages_removed) == (0, 0)


def test_diff_counts_lines_that_look_like_marks(table):
    p = table("doc_id long, page int, text string", (1, 0, "a\n--x"), (2, 0, "a\n++y\n+++z"))
    pairs = table("pair_id long, doc_a long, doc_b long", (9, 1, 2))
    got = compare.document_diff(p, pairs).first()
    assert (got.lines_added, got.lines_removed) == (2, 1)


def test_alignment_equals_the_standard_diff():
    rnd = random.Random(1)
    for k in range(600):
        a = [rnd.choice("abcdefgh" + "xyz" * (k % 3)) for _ in range(rnd.choice([0, 1, 3, 8, 20, 250] if k % 20 == 0 else [0, 3, 20]))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            if b and rnd.random() < 0.5:
                del b[rnd.randrange(len(b))]
            else:
                b.insert(rnd.randint(0, len(b)), rnd.choice("abcdefgh++-"))
        want = list(difflib.unified_diff(a, b, "x", "y", lineterm=""))[2:]
        assert compare._hunks(a, b, compare._Alignment(a, b).edits()) == want


def test_matches_keep_their_place_where_lower_case_is_longer(table):
    s = table("doc_id long, page int, text string, x0 double, x1 double", (1, 0, "\u0130\u0130 The end", 0.0, 10.0))
    found = search.find_matches(s, "the").first()
    assert (found.start, found.match_x0, found.match_x1) == (3, 3.0, 6.0)
    gone = search.delete_text(s, "the").first()
    assert (gone.deleted, gone.text) == (1, "\u0130\u0130  end")


def test_header_belongs_to_its_column(table):
    c = "doc_id long, page int, table_index int, r int, c int, cell string"
    cells = table(c, *[(1, 0, 0, 0, i, x) for i, x in ((0, "A"), (2, "C"))], *[(1, 0, 0, 1, i, str(i)) for i in range(4)])
    got = tables.tables_from_cells(cells).first()
    assert got.headers == ["A", "col_1", "C"]
    assert [(p.key, p.value) for p in got.pairs] == [("A", "0"), ("col_1", "1"), ("C", "2"), ("col_3", "3")]


def test_a_key_with_half_the_rows_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))
        big = spark.range(40_000).repartition(8).select(key.alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        small = big.groupBy("doc_id").agg(F.count("*").alias("n"))
        joined = join_per_key(big, small, ["doc_id"])
        got = joined.groupBy().agg(F.sum("n"), F.count("*")).first()
        assert tuple(got) == (20_000 * 20_000 + 20_000, 40_000)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_doc_context(table, pages):
    focus = table("doc_id long, current_page int", (1, 1))
    got = rows(compare.doc_context(pages, focus).select("section", "page", "context"), "section", "page")
    assert got == [(1, 1, "Page Two Content test@example.com"), (2, 0, "Hello World"), (2, 2, "Page Three")]
    outline = compare.doc_context(pages, focus, full_text_pages=2).where("section = 2")
    assert [r.context for r in outline.orderBy("page").collect()] == ["Hello World", "Page Two Content test@example.com", "Page Three"]


def test_fixed_lists():
    assert len(fv.STOP_WORDS) == 50 and all(len(w) == 14 for w in fv.LANGUAGE_WORDS.values())


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_profile_finds_words_once(table):
    docs = table("doc_id long, text string", (1, "alpha beta alpha\ngamma"))
    plan = optimized(analysis.profile(docs)).toString()
    assert plan.count(fv.LANGUAGE_WORD) == 1
    assert fv.TOPIC_WORD not in plan


def test_heading_counts_shuffle_no_text(spans):
    node = optimized(layout.headings(spans).groupBy("doc_id").count())
    while node.nodeName() != "Join":
        node = node.children().head()
    joined = node.children().head().output()
    assert "text" not in [joined.apply(i).name() for i in range(joined.size())]


def test_top_topic_is_the_first_of_all_topics(table):
    values = (
        "alpha beta beta alpha", "zeta zeta alpha", "beta alpha gamma", "", "of the with this", None,
        "caf\u00e9 abcd1 abcd_ abcd abcd", "ABCD \u212aelvin kelvin efgh e\u0301abcd", "one1 two2", "\u0130abc abcd-abcd",
        "page document this", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xy" for i in range(600, -1, -1)),
    )
    docs = table("doc_id long, text string", *enumerate(values))
    text = F.col("text")
    for stop in (None, (), ("abcd",)):
        got = docs.select(
            F.get(topics.topic_counts(text, stop), F.lit(0))["word"],
            topics.top_topic_of(text, stop),
            topics.top_topic_of(text, stop, language.language_words(text)),
        ).collect()
        assert all(a == b == c for a, b, c in got)
        assert got[0][0] == "alpha"


def test_texts_with_a_match_have_what_it_needs(table):
    values = (
        "1/2/99", "11-12-2024", "May 3, 2024", "Sept. 3 24", "Jan\u00a03,\u20032024", "Dec 31 1999", "\u0663/\u0664/\u0662\u0660", "3 May",
        "$ 5", "\u20ac7,5", "\u00a3\u00a05", "12.50 USD", "1,000.25", "1.2", "$x", "123-45-6789", "123-45-678", "\u0661\u0662\u0663-45-6789",
        "Ann Smith", "Ann\u00a0Maria Smith", "aAnn Smith", "Ann  S", "Acme Co", "Acme Co.", "Acme\u2003Widgets Inc.", "Acme Cold", "Co", "A&B Ltd\nX",
        "a@b.cc", "see http://x", "://", "+1 555-010-1234",
    )
    docs = table("text string", *[(v,) for v in values])
    text = F.col("text")
    for pattern, needs in fv.NEEDED_BY.items():
        got = docs.select("text", ft.all_matches(text, pattern), ft.all_matches(text, pattern, needs)).collect()
        assert [r[1] for r in got] == [r[2] for r in got]
        assert any(r[1] for r in got)


def test_script_needs_more_than_a_tenth(table):
    values = ("a" * 9 + "\u4e2d", "a" * 8 + "\u4e2d", "\u00e9" * 20, "\u0431" * 2 + "a" * 8, "\u0631" + "a" * 9, "", "\U0001f600" * 3, None)
    docs = table("text string", *[(v,) for v in values])
    found = [r[0] for r in docs.select(language.script(F.col("text"))).collect()]
    assert found == [None, "CJK", None, "Cyrillic", None, None, None, None]


def test_many_entities_are_told_apart(table):
    text = "\n".join(f"a{i % 700}@b.example x{i % 2}@b.example" for i in range(1400))
    (row,) = analysis.profile(table("doc_id long, text string", (1, text))).collect()
    assert row.entity_count == 702
