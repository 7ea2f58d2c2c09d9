"""Layout, tables, forms and page sets on hand-made rows."""

import random

import pytest
from conftest import SPAN, rows, span
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import batch, forms, layout, pageset, tables, text

CELL = "doc_id long, page int, table_index int, r int, c int, cell string"


def test_avg_and_headings(table):
    s = table(
        SPAN,
        span(1, 0, 0, "Big Bold", 20.0, 16), span(1, 0, 1, "Big", 20.0), span(1, 0, 2, "BOLDCAPS", 8.0, 16),
        span(1, 0, 3, "BOLD CAPS", 8.0, 16), span(1, 0, 4, "bold", 8.0, 16), span(1, 0, 5, "CAPS", 8.0), span(1, 0, 6, "ABC", 8.0),
        span(1, 0, 7, "  ", 99.0, 16), span(2, 0, 0, " ", 40.0),
    )
    avg = {r.doc_id: r.avg_size for r in layout.avg_font_size(s).collect()}
    assert avg[2] == 12.0 and avg[1] == pytest.approx((20 * 2 + 8 * 5) / 7)
    got = rows(layout.headings(s).select("text", "level"))
    assert dict(got) == {"Big Bold": 1, "Big": 2, "BOLDCAPS": 2, "BOLD CAPS": 3, "bold": 3, "CAPS": 4}
    toc = table("doc_id long, seq int, level int, title string, page int", (1, 0, 1, "T", 0))
    assert layout.sections(s, toc).where("origin = 'toc'").first().title == "T"


def test_classify_blocks(table):
    s = table(
        SPAN,
        span(1, 0, 0, "• item"), span(1, 0, 1, "1. item"), span(1, 0, 2, "a) item"), span(1, 0, 3, "short bold", flags=16),
        span(1, 0, 4, "b" * 100, flags=16), span(1, 0, 5, "plain"), span(1, 0, 6, " "), span(1, 0, 7, "large", 30.0),
    )
    im = table("doc_id long, page int, idx int, x0 double, y0 double, x1 double, y1 double", (1, 0, 0, 0.0, 0.0, 1.0, 1.0))
    got = {(r.block, r.kind) for r in layout.classify_blocks(s, im).collect()}
    assert got == {
        (0, "list_item"), (1, "list_item"), (2, "list_item"), (3, "heading"), (4, "paragraph"), (5, "paragraph"),
        (7, "heading"), (0, "image"),
    }


def greedy_groups(spans):
    """(x0, y0, x1, size) in order, to the anchor of each."""
    owner = [None] * len(spans)
    for i, a in enumerate(spans):
        if owner[i] is None:
            owner[i] = i
            for j in range(i + 1, len(spans)):
                b = spans[j]
                if owner[j] is None and abs(b[1] - a[1]) < a[3] * 0.5 and b[0] - a[2] < a[3] * 2:
                    owner[j] = i
    return owner


def test_span_groups_match_brute_force(table):
    rnd = random.Random(5)
    boxes = [(rnd.uniform(0, 300), rnd.uniform(0, 60), 0, rnd.choice([8.0, 12.0, 20.0])) for _ in range(60)]
    boxes = [(x, y, x + rnd.uniform(5, 80), s) for x, y, _, s in boxes]
    s = table(SPAN, *[span(1, 0, i, f"t{i}", b[3], x0=b[0], y0=b[1], x1=b[2]) for i, b in enumerate(boxes)])
    want = {}
    for i, o in enumerate(greedy_groups(boxes)):
        want.setdefault(o, []).append(f"t{i}")
    got = {r.anchor: r.text.split() for r in layout.span_groups(s).collect()}
    assert got == want


def test_regions(table, spans):
    r = table(
        "region_id long, doc_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double",
        (1, 1, 0, 0.0, 0.0, 100.0, 100.0), (2, 1, 0, 0.0, 0.0, 72.0, 100.0), (3, 1, 2, 80.0, 80.0, 81.0, 81.0),
    )
    got = rows(layout.region_text(spans, r).select("region_id", "text", "has_text"), "region_id")
    assert got == [(1, "Hello World", True), (2, "", False), (3, "Page Three", True)]


@settings(max_examples=200, deadline=None)
@given(st.floats(1, 100), st.floats(1, 500), st.floats(0.1, 500))
def test_fit_bounds(size, old, new):
    # the same rule in plain Python, held to its bounds
    keep = new <= old * 1.05
    fitted = size if keep else max(size * old / new, max(size * 0.7, 6.0))
    assert fitted >= min(size, 6.0) and (fitted <= size or size < 6 / 0.7)


@pytest.mark.parametrize(
    "size, old, new, fitted, warned",
    [(10, 100, 105, 10, False), (10, 100, 125, 8, False), (10, 100, 400, 7, True), (5, 100, 400, 6, True), (5, 100, 110, 6, True)],
)
def test_fit_font_size(spark, size, old, new, fitted, warned):
    a, b = layout.fit_font_size(F.lit("x"), F.lit(float(size)), F.lit(float(old)), F.lit(float(new)))
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (got.a, got.b) == (pytest.approx(fitted), warned)


@pytest.fixture
def glyphs(table):
    codes = [(c, ch, w) for c in ("helv", "tiro") for ch, w in (("a", 0.5), ("b", 0.25), ("i", 0.5))]
    return table("font_code string, ch string, unit_width double", *codes)


def test_text_width(table, glyphs):
    df = table("font_code string, t string, s double", ("helv", "abib?", 10.0), ("cobi", "ab", 10.0), ("tiro", "", 9.0))
    got = [r.w for r in layout.text_width(df, glyphs, "t", "s", "w").orderBy("font_code").collect()]
    assert sorted(got) == [0.0, 0.0, 15.0]


def test_text_width_by_stand_ins(table):
    wide = {"a": 0.5, "b": 0.25, "i": 0.5, "\0": 0.5, "é": 0.25, "😀": 1.0, "\u4e00": 0.75}
    glyphs = table("font_code string, ch string, unit_width double", *[("helv", ch, w) for ch, w in wide.items()], ("helv", "b", 2.0),
                   ("helv", "ab", 0.5), ("tiro", "\0", 0.5), ("tiro", None, 0.25), ("cour", "a", 0.5), ("cour", "b", None))
    text = "ab\0i?é😀\u4e00b"
    df = table("font_code string, t string, s double", *[(c, text, 2.0) for c in ("helv", "tiro", "cour", "none")], ("helv", None, 2.0))
    got = {(r.font_code, r.t): r.w for r in layout.text_width(df, glyphs, "t", "s", "w").collect()}
    b = 0.25 + 2.0 + 0.5  # several widths
    assert got[("helv", text)] == pytest.approx(2 * (3 * 0.5 + 2 * b + 0.25 + 1.0 + 0.75))
    assert got[("tiro", text)] == 1.0 and got[("cour", text)] == got[("none", text)] == got[("helv", None)] == 0.0
    classes = layout.glyph_classes(glyphs).where("font_code = 'helv'").first().classes
    assert (classes.others, classes.stands) == ("\0a", "ii")


def test_plan_edit_move_add(table, spans, pages, glyphs):
    edits = table("edit_id long, doc_id long, scope int, find string, repl string", (1, 1, None, "Hello", "a" * 400), (2, 1, 1, "Hello", "x"))
    plan = layout.replacement_plan(spans, edits, glyphs).collect()
    assert [p.edit_id for p in plan] == [1]
    assert plan[0].adjusted_size == pytest.approx(8.4) and plan[0].size_warning and plan[0].insert_y == 82.0
    e = table(
        "edit_id long, doc_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double, new_text string, new_size double, new_color int",
        (1, 1, 0, 70.0, 70.0, 90.0, 90.0, "ab", 0.0, None), (2, 1, 0, 500.0, 500.0, 600.0, 520.0, "", None, 7), (3, 1, 9, 0.0, 0.0, 1.0, 1.0, "", None, None),
    )
    got = {r.edit_id: r for r in layout.edit_region(spans, pages, e, glyphs).collect()}
    assert (got[1].size, got[1].insert_y, got[1].status) == (12.0, 82.0, "ok")
    assert (got[2].size, got[2].color) == (11.0, 7) and got[2].insert_y == pytest.approx(520 - 11 * 0.15)
    assert got[3].status == "invalid_page"
    m = table(
        "move_id long, doc_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double, nx0 double, ny0 double, nx1 double, ny1 double",
        (1, 1, 0, 72.0, 72.0, 172.0, 92.0, 0.0, 0.0, 1000.0, 200.0), (2, 1, 0, 500.0, 500.0, 510.0, 510.0, 0.0, 0.0, 1.0, 1.0),
    )
    got = {r.move_id: r for r in layout.move_spans(spans, m).collect()}
    assert (got[1].new_x, got[1].new_size, got[1].new_y, got[1].status) == (0.0, 72.0, 72.0, "text")
    assert got[2].status == "nothing" and got[2].new_size is None
    add = table(
        "add_id long, doc_id long, page int, x double, y double, text string, font_size double, color int",
        (1, 1, 0, 100.0, 200.0, "Injected Text", 14.0, None), (2, 1, 99, 0.0, 0.0, "no", None, None),
    )
    assert {r.status for r in layout.addition_status(pages, add).collect()} == {"ok", "invalid_page"}
    new = layout.add_spans(spans, pages, add)
    assert new.count() == 4 and new.where("text = 'Injected Text'").first().origin_y == 214.0


def test_stamps(pages, glyphs):
    got = layout.stamp_layout(pages, None, glyphs, "a{n}/{total}", "Top-Left", 10.0, 36.0, only=[1]).collect()
    assert [(r.stamp, r.x, r.y) for r in got] == [("a2/3", 36.0, 46.0)]
    mark = layout.watermark_layout(pages, glyphs, "ab", 40.0, 0.0).first()
    assert (mark.x, mark.y) == (306.0 - 15.0, 396.0 + 20.0)


def test_validate(table, spans):
    from quire.operators import search

    e = table(
        "edit_id long, doc_id long, page int, bx0 double, by0 double, bx1 double, by1 double, expected string",
        (1, 1, 0, 72.0, 72.0, 140.0, 90.0, "Hello"), (2, 1, 0, 72.0, 72.0, 80.0, 90.0, "Hello"), (3, 1, 1, 72.0, 72.0, 900.0, 90.0, "nope"),
    )
    got = {r.edit_id: r.issues for r in search.validate_replacement(spans, e).collect()}
    assert got == {1: [], 2: ["text_extends_beyond_original_bounds"], 3: ["replacement_text_not_found_in_region"]}


def test_tables(table):
    grid = [
        ["Item", "", "Price", "Price"], ["a", None, "$1,234.50", "x"], ["b", "q", "12%", "2"], ["c"], ["d", "", "n/a", "", "extra"],
    ]
    cells = [(1, 0, 0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)] + [(1, 1, 0, 0, 0, "alone")]
    t = tables.tables_from_cells(table(CELL, *cells))
    values = {(r.r, r.key): r.value for r in tables.table_values(t).collect()}
    assert values[(1, "Price")] == "x" and values[(1, "col_1")] == "" and values[(4, "col_4")] == "extra"
    assert (3, "Price") not in values
    cat = tables.table_catalog(t).collect()
    assert [(c.row_count, c.col_count, c.page_number) for c in cat] == [(4, 4, 1)]
    total = tables.table_column_sum(t, "price").first()
    assert (total.header, total.total, total.n_values) == ("Price", 2.0, 1)
    assert tables.table_lookup(t, "1,234").first().r == 1
    lines = [r.line for r in tables.tables_csv(t).orderBy("r").collect()]
    assert lines[:3] == ["# Table on page 1 (index 0)", '"Item","col_1","Price","Price"', '"a","","x","x"']
    assert lines[-1] == '"d","","",""'


def test_write_csv(table, tmp_path):
    lines = table("doc_id long, page int, table_index int, r int, line string", (1, 0, 0, 1, "b"), (1, 0, 0, 0, "a"))
    tables.write_csv(lines, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "a\nb\n"


def test_forms(table):
    p = table("doc_id long, page int, text string", (1, 0, "Name: ____\n[x] Agree\n[ ] No\nHome\nAddr: ___"), (1, 1, "Name: _____ \n[X] Agree"))
    w = table("doc_id long, page int, pos int, field_name string, field_type string, field_value string", (1, 0, 0, "Name", "text", "Bob"), (1, 1, 0, "", "text", "q"))
    fields = forms.form_fields(p, w)
    names = sorted((r.page, r.part, r.pos, r.field_name, r.checked) for r in fields.where("part > 0").collect())
    assert [n[3] for n in names if n[0] == 0] == ["Name", "No\nHome\nAddr", "Agree", "No"] or names[0][3] == "Name"
    data = {r.field_name: r.value for r in forms.form_data(fields).collect()}
    assert data["Name"] == "" and data["Agree"] == "true" and data["No"] == "false" and "" not in data
    up = table("doc_id long, field_name string, value string", (1, "Name", "Eve"), (1, "Nope", "x"))
    assert {r.field_value for r in forms.fill_forms(w, up).collect()} == {"Eve", "q"}
    twice = table("doc_id long, field_name string, value string, seq int", (1, "Name", "Eve", 2), (1, "Name", "Ann", 1))
    assert sorted(r.field_value for r in forms.fill_forms(w, twice).collect()) == ["Eve", "q"]
    assert [r.error for r in forms.unknown_fields(w, up).collect()] == ["Field 'Nope' not found"]
    assert forms.form_summary(table("doc_id long", (1,), (2,)), fields).orderBy("doc_id").collect()[1].has_forms is False


def texts(df):
    return [r.text for r in df.orderBy("page").collect()]


def test_page_operations(table, pages):
    edit = table("doc_id long, page int, new_rotation int", (1, 0, 90), (1, 1, None), (1, 99, 90))
    assert [r.rotation for r in pageset.rotate_pages(pages, edit).orderBy("page").collect()] == [90, 90, 0]
    assert pageset.invalid_pages(pages, edit).first().page == 99
    turns = table("doc_id long, page int, new_rotation int, seq int", (1, 0, None, 1), (1, 0, None, 2), (1, 1, None, 1), (1, 1, 180, 2), (1, 1, None, 3))
    assert [r.rotation for r in pageset.rotate_pages(pages, turns).orderBy("page").collect()] == [180, 270, 0]
    cut = "doc_id long, start int, end int"
    for start, end, left in ((1, 1, 2), (2, 2, 2), (0, 2, 3), (5, 5, 3), (-1, 0, 3), (2, 1, 3)):
        assert pageset.delete_pages(pages, table(cut, (1, start, end))).count() == left
    left = pageset.delete_pages(pages, table(cut, (1, 0, 0), (1, 0, 1)))
    assert [(r.page, r.text) for r in left.collect()] == [(0, "Page Three")]
    assert pageset.delete_pages(pages, table(cut, (1, 0, 1), (1, 2, 2))).count() == 3
    left = pageset.delete_pages(pages, table(cut, (1, 0, 1)))
    assert [(r.page, r.text) for r in left.collect()] == [(0, "Page Three")]
    order = "doc_id long, page_order array<int>"
    assert texts(pageset.reorder_pages(pages, table(order, (1, [2, 1, 0]))))[0] == "Page Three"
    assert texts(pageset.reorder_pages(pages, table(order, (1, [0, 0, 0]))))[0] == "Hello World"
    ranges = table(cut, (1, 0, 0), (1, 1, 2), (1, 2, 3))
    parts = pageset.split_documents(pages, ranges)
    assert sorted(r["count"] for r in parts.groupBy("new_doc_id").count().collect()) == [1, 2]
    assert {r.status for r in pageset.split_status(pages, ranges).collect()} == {"ok", "invalid_range"}
    merged = pageset.merge_documents(pages, table("doc_id long, doc_ids array<long>", (1, [1, 404])))
    assert [r.page for r in merged.orderBy("page").collect()] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_reorder_inverse_and_split_merge_are_identity(table, seed):
    rnd = random.Random(seed)
    n = 9
    p = table("doc_id long, page int, rotation int, text string", *[(1, i, 0, f"p{i}") for i in range(n)])
    order = rnd.sample(range(n), n)
    inverse = [order.index(i) for i in range(n)]
    mixed = pageset.reorder_pages(p, table("doc_id long, page_order array<int>", (1, order)))
    assert texts(mixed) == [f"p{i}" for i in order]
    back = pageset.reorder_pages(mixed, table("doc_id long, page_order array<int>", (1, inverse)))
    assert texts(back) == [f"p{i}" for i in range(n)]
    k = rnd.randrange(1, n - 1)
    parts = pageset.split_documents(p, table("doc_id long, start int, end int", (1, 0, k), (1, k + 1, n - 1)))
    ids = [r[0] for r in parts.where("page = 0").orderBy("text").select("new_doc_id").collect()]
    plan = table("doc_id string, doc_ids array<string>", (ids[0], [ids[1]]))
    joined = pageset.merge_documents(parts.drop("source_doc_id").withColumnRenamed("new_doc_id", "doc_id"), plan)
    assert texts(joined) == [f"p{i}" for i in range(n)]
    i, j = rnd.randrange(n), rnd.randrange(n)
    want = list(range(n))
    want.insert(j, want.pop(i))
    moved = pageset.move_page(p, table("doc_id long, src int, dst int", (1, i, j)))
    assert texts(moved) == [f"p{x}" for x in want]


def test_batch(pages, spans, glyphs, tmp_path, spark):
    corpus = {"pages": pages, "spans": spans, "glyphs": glyphs}
    ops = [{"type": "replace", "find": "Hello", "replace": "Goodbye"}, {"type": "nonsense"}, {"type": "replace"}, {"type": "stamp"}]
    after, result = batch.batch_operations(corpus, ops, str(tmp_path / "made"))
    got = [(r.step, r.status, r.n) for r in result.orderBy("step").collect()]
    assert got == [(0, "ok", 1), (1, "skipped", 0), (2, "error", 0), (3, "ok", 3)]
    assert after["spans"].where("text = 'Goodbye World'").count() == 1
    assert batch.history_entry(ops) == "Batch: replace, nonsense, replace, stamp"
    assert batch.load(spark, str(tmp_path / "made"))["spans"].count() == 3
    assert batch.changed_documents(pages, pages).count() == 0
    assert batch.changed_documents(pages, pages.withColumn("text", F.upper("text"))).count() == 1


def test_batch_options(pages, spans, glyphs):
    corpus = {"pages": pages, "spans": spans, "glyphs": glyphs}
    ops = [
        {"type": "stamp", "text": "a{n}", "position": "top-right", "margin": 10, "size": 20, "pages": [1]},
        {"type": "watermark", "text": "abba", "size": 40, "rotation": 0, "opacity": 0.5, "pages": [0, 2]},
    ]
    after, result = batch.batch_operations(corpus, ops)
    assert [r.n for r in result.orderBy("step").collect()] == [1, 2]
    marks = sorted(rows(after["marks"].select("page", "kind", "text", "x", "y", "size", "rotation", "opacity")))
    # an "a" is half as wide as its size, a "b" a quarter; the page is 612 by 792
    assert marks == [
        (0, "watermark", "abba", 306.0 - 30.0, 396.0 + 20.0, 40.0, 0.0, 0.5),
        (1, "stamp", "a2", 612.0 - 10.0 - 10.0, 30.0, 20.0, 0.0, 1.0),
        (2, "watermark", "abba", 306.0 - 30.0, 396.0 + 20.0, 40.0, 0.0, 0.5),
    ]


def test_batch_goes_on_after_steps_that_fail_on_a_row(pages, spans, glyphs):
    def number(c, op):
        text = F.when(F.col("page") == op["page"], F.col("text").cast("int").cast("string")).otherwise(F.col("text"))
        changed, seen = batch._seen(c["pages"].withColumn("text", text), F.count(F.lit(1)))
        return {**c, "pages": changed}, seen

    ops = [
        {"type": "get_page_count"}, {"type": "number", "page": 1}, {"type": "search_text", "query": "page"},
        {"type": "number", "page": 9}, {"type": "number", "page": 2}, {"type": "delete_text", "text": "page"},
    ]
    after, result = batch.batch_operations({"pages": pages, "spans": spans, "glyphs": glyphs}, ops, more={"number": number})
    got = [(r.status, r.n, r.reason is not None) for r in result.orderBy("step").collect()]
    assert got == [("ok", 3, False), ("error", 0, True), ("ok", 2, False), ("ok", 3, False), ("error", 0, True), ("ok", 2, False)]
    assert sorted(r.text for r in after["pages"].collect()) == [" Three", " Two Content test@example.com", "Hello World"]


def test_batch_reads_each_table_once(pages, spans, glyphs, tmp_path, spark):
    pages.write.parquet(str(tmp_path / "in"))
    given = spark.read.parquet(str(tmp_path / "in"))
    ops = [{"type": "search_text", "query": "page"}, {"type": "delete_text", "text": "page"}, {"type": "get_word_count"}] * 4
    planned, counts, _ = batch._planned({"pages": given, "spans": spans, "glyphs": glyphs}, ops, batch.OPERATIONS, {})
    assert len(counts) == 12 and planned["pages"]._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_crowded_pages_are_divided(table):
    rnd = random.Random(9)
    boxes = [(rnd.uniform(0, 600), rnd.uniform(0, 780)) for _ in range(700)]
    s = table(SPAN, *[span(1 + (i % 7 == 0), 0, i, "x" * rnd.randrange(1, 60), x0=x, y0=y) for i, (x, y) in enumerate(boxes)])
    r = [(i, 1 + i % 2, 0, x := rnd.uniform(0, 600), y := rnd.uniform(0, 780), x + rnd.uniform(1, 300), y + rnd.uniform(1, 90)) for i in range(60)]
    r += [(90, 1, 0, -50.0, -50.0, 900.0, 900.0), (91, 1, 0, 800.0, 800.0, 810.0, 810.0), (92, 3, 0, 0.0, 0.0, 9.0, 9.0)]
    regions = table("region_id long, doc_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double", *r)
    assert layout._grids(s).count() == 1
    got = sorted(rows(layout.region_spans(s, regions).select("region_id", "block")))
    want = [
        (g[0], b.block) for b in s.collect() for g in r
        if g[1] == b.doc_id and b.x0 < g[5] and b.x1 > g[3] and b.y0 < g[6] and b.y1 > g[4]
    ]
    assert got == sorted(want) and len(got) > 1000


def test_span_groups_of_several_bands(table):
    rnd = random.Random(6)
    boxes = [(rnd.uniform(0, 500), rnd.uniform(0, 700), rnd.choice([6.0, 12.0, 30.0])) for _ in range(150)]
    boxes = [(x, y, x + rnd.uniform(5, 80), s) for x, y, s in boxes]
    s = table(SPAN, *[span(1, 0, i, f"t{i}", b[3], x0=b[0], y0=b[1], x1=b[2]) for i, b in enumerate(boxes)])
    assert layout._bands(s).select("band").distinct().count() > 5
    want = {}
    for i, o in enumerate(greedy_groups(boxes)):
        want.setdefault(o, []).append(f"t{i}")
    assert {r.anchor: r.text.split() for r in layout.span_groups(s).collect()} == want


def test_stamps_join_nothing(pages, glyphs):
    plan = layout.stamp_layout(pages, None, glyphs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables_are_neither_broadcast_nor_sorted(table):
    rows = [(d, 0, 0, r, c, f"{r}{c}") for d in range(3) for r in range(3) for c in range(2)]
    t = tables.tables_from_cells(table("doc_id long, page int, table_index int, r int, c int, cell string", *rows))
    for df in (t, tables.tables_csv(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
    assert tables.tables_csv(t).count() == 3 * 4


def test_font_name_is_made_once(table):
    df = table("font string, flags int", ("ABC+Times New", 16)).select(text.font_code(F.col("font"), F.col("flags")).alias("code"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
