"""Page similarity, document comparison and document context."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quire.functions.joins import join_per_key
from quire.functions.text import is_blank, strip, words
from quire.operators.ingest import page_counts


def page_similarity(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Word-set overlap of two pages per row of ``pairs(pair_id, doc_a, page_a, doc_b, page_b)``."""
    profile = pages.select(
        "doc_id",
        "page",
        F.col("text"),
        words(F.lower("text")).alias("w"),
    ).select("doc_id", "page", F.substring("text", 1, 500).alias("preview"), F.size("w").alias("n"), F.array_distinct("w").alias("w"))

    def side(tag: str) -> DataFrame:
        return profile.select(
            F.col("doc_id").alias(f"doc_{tag}"),
            F.col("page").alias(f"page_{tag}"),
            F.col("preview").alias(f"preview_{tag}"),
            F.col("n").alias(f"word_count_{tag}"),
            F.col("w").alias(f"_{tag}"),
        )

    both = pairs.join(side("a"), ["doc_a", "page_a"], "left").join(side("b"), ["doc_b", "page_b"], "left")
    common = F.size(F.array_intersect("_a", "_b"))
    both = both.withColumn("common_words", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), common))
    only_a = F.size("_a") - F.col("common_words")
    only_b = F.size("_b") - F.col("common_words")
    return (
        both.withColumn("unique_to_a", only_a)
        .withColumn("unique_to_b", only_b)
        .withColumn(
            "similarity",
            F.round(
                F.col("common_words")
                / F.greatest(F.col("common_words") + F.col("unique_to_a") + F.col("unique_to_b"), F.lit(1)),
                3,
            ),
        )
        .withColumn("error", F.when(F.col("common_words").isNull(), "invalid page numbers"))
        .drop("_a", "_b")
    )


_AT = [("pair_id", pa.int64()), ("page", pa.int32())]
DIFF_TYPES = pa.schema([*_AT, ("lines_added", pa.int32()), ("lines_removed", pa.int32()), ("diff", pa.string())])
EDIT_TYPES = pa.schema([*_AT, ("pos", pa.int32()), ("op", pa.string()), ("line", pa.string())])
CONTEXT = 3  # unchanged lines around a change in a diff
COMMON_FROM = 200  # pages of so many lines do not align by lines that are more than one in a hundred


class _Alignment:
    """Which lines of two pages belong together.

    The longest run of lines both have, the earliest of equals, is fixed first;
    then the same on either side of it. In a long new page very common lines do
    not begin a run, though they prolong one.
    """

    def __init__(self, old: list[str], new: list[str]):
        self.old, self.new = old, new
        self.places: dict[str, list[int]] = {}
        for j, line in enumerate(new):
            self.places.setdefault(line, []).append(j)
        if len(new) >= COMMON_FROM:
            most = len(new) // 100 + 1
            self.places = {line: at for line, at in self.places.items() if len(at) <= most}

    def _run(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """(old place, new place, length) of the longest common run inside the two ranges."""
        best, ending = (a0, b0, 0), {}
        for i in range(a0, a1):
            here = {}
            for j in self.places.get(self.old[i], ()):
                if b0 <= j < b1:
                    here[j] = n = ending.get(j - 1, 0) + 1
                    if n > best[2]:
                        best = (i - n + 1, j - n + 1, n)
            ending = here
        a, b, n = best
        while a > a0 and b > b0 and self.old[a - 1] == self.new[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while a + n < a1 and b + n < b1 and self.old[a + n] == self.new[b + n]:
            n += 1
        return a, b, n

    def edits(self) -> list[tuple[str, int, int]]:
        """(op, old place, new place) line by line: ' ' kept, '-' gone, '+' new; what goes stands before what comes."""
        todo, kept = [(0, len(self.old), 0, len(self.new))], []
        while todo:
            a0, a1, b0, b1 = todo.pop()
            a, b, n = self._run(a0, a1, b0, b1)
            if n:
                kept += [(a + k, b + k) for k in range(n)]
                todo += [(a0, a, b0, b), (a + n, a1, b + n, b1)]
        out, i, j = [], 0, 0
        for a, b in [*sorted(kept), (len(self.old), len(self.new))]:
            out += [("-", k, j) for k in range(i, a)] + [("+", a, k) for k in range(j, b)]
            if a < len(self.old):
                out.append((" ", a, b))
            i, j = a + 1, b + 1
        return out


def _span(first: int, n: int) -> str:
    """A range in a hunk's head: numbers from one, an empty range by the line before it."""
    return f"{first + 1}" if n == 1 else f"{first + (n > 0)},{n}"


def _hunks(old: list[str], new: list[str], edits: list[tuple[str, int, int]]) -> list[str]:
    """Changed lines with up to ``CONTEXT`` kept ones around; changes closer than two contexts share a hunk."""
    near = [k for k, (op, _, _) in enumerate(edits) if op != " "]
    out, at = [], 0
    while at < len(near):
        end = at
        while end + 1 < len(near) and near[end + 1] - near[end] - 1 <= 2 * CONTEXT:
            end += 1
        part = edits[max(0, near[at] - CONTEXT) : near[end] + CONTEXT + 1]
        a, b = sum(op != "+" for op, _, _ in part), sum(op != "-" for op, _, _ in part)
        out.append(f"@@ -{_span(part[0][1], a)} +{_span(part[0][2], b)} @@")
        out += [op + (new[j] if op == "+" else old[i]) for op, i, j in part]
        at = end + 1
    return out


def _page_edits(batch):
    """(pair, page, old lines, new lines, edits) of each differing page pair of an Arrow batch."""
    for pair, page, a, b in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "page", "text_a", "text_b")), strict=True):
        old, new = ((t or "").splitlines() for t in (a, b))
        if old != new:
            yield pair, page, old, new, _Alignment(old, new).edits()


def _diff_rows(batches):
    for batch in batches:
        rows = []
        for pair, page, old, new, edits in _page_edits(batch):
            head = [f"--- doc1/page_{page + 1}", f"+++ doc2/page_{page + 1}"]
            ops = [op for op, _, _ in edits]
            rows.append((pair, page, ops.count("+"), ops.count("-"), "\n".join(head + _hunks(old, new, edits))))
        yield _table(rows, DIFF_TYPES)


def _edit_rows(batches):
    for batch in batches:
        for pair, page, old, new, edits in _page_edits(batch):
            yield _table(
                [(pair, page, k, op, new[j] if op == "+" else old[i]) for k, (op, i, j) in enumerate(edits)], EDIT_TYPES
            )


def _table(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


def _paired(pages: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """Pages of one side of each pair."""
    wanted = pairs.select("pair_id", F.col(f"doc_{tag}").alias("doc_id"))
    return join_per_key(pages, wanted, ["doc_id"])


def aligned_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pages of both documents of each pair side by side, by page index."""

    def side(tag: str) -> DataFrame:
        return _paired(pages, pairs, tag).select("pair_id", "page", F.col("text").alias(f"text_{tag}"))

    return side("a").join(side("b"), ["pair_id", "page"], "full")


def _differing(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    return aligned_pages(pages, pairs).where(~F.col("text_a").eqNullSafe(F.col("text_b")))


def document_diff(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered line diff of each differing page pair of ``pairs(pair_id, doc_a, doc_b)``.

    Equal pages are dropped in the JVM; only differing ones are aligned, one page
    pair per row, batch by batch. As in the usual line diff, lines that make up
    more than one in a hundred of a new page of ``COMMON_FROM`` lines or more do
    not begin a run there, so results change in kind at that size.
    """
    return _differing(pages, pairs).mapInArrow(_diff_rows, from_arrow_schema(DIFF_TYPES))


def page_edits(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The whole alignment of each differing page pair, one row per line: ' ' kept, '-' gone, '+' new."""
    return _differing(pages, pairs).mapInArrow(_edit_rows, from_arrow_schema(EDIT_TYPES))


def page_count_changes(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    counts = page_counts(pages)
    a = counts.select(F.col("doc_id").alias("doc_a"), F.col("page_count").alias("pages_a"))
    b = counts.select(F.col("doc_id").alias("doc_b"), F.col("page_count").alias("pages_b"))
    n_a, n_b = F.coalesce("pages_a", F.lit(0)), F.coalesce("pages_b", F.lit(0))
    return (
        pairs.join(a, "doc_a", "left")
        .join(b, "doc_b", "left")
        .select(
            "pair_id",
            n_a.alias("doc1_pages"),
            n_b.alias("doc2_pages"),
            F.greatest(n_b - n_a, F.lit(0)).alias("pages_added"),
            F.greatest(n_a - n_b, F.lit(0)).alias("pages_removed"),
        )
    )


def line_changes(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines only one side has, as multisets, per differing page pair (order ignored)."""

    def lines(tag: str, sign: int) -> DataFrame:
        one = _paired(pages, pairs, tag)
        return one.select("pair_id", "page", F.explode(F.split("text", "\n", -1)).alias("line"), F.lit(sign).alias("d"))

    both = lines("a", -1).unionByName(lines("b", 1))
    balance = both.groupBy("pair_id", "page", "line").agg(F.sum("d").alias("d")).where("d <> 0")
    return balance.groupBy("pair_id", "page").agg(
        F.sum(F.greatest("d", F.lit(0))).alias("lines_added"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("lines_removed"),
    )


def doc_context(pages: DataFrame, focus: DataFrame, full_text_pages: int = 20) -> DataFrame:
    """Context lines for a reader at ``focus(doc_id, current_page)``, one row per context part.

    Short documents give the other pages' text (2000 characters each), long ones
    the first line of every page; the current page gives 4000 characters. Parts
    are rows ordered by (section, page), so a long outline is never gathered.
    """
    at = join_per_key(pages, focus.join(page_counts(pages), "doc_id"), ["doc_id"])
    here = F.col("page") == F.col("current_page")
    short = F.col("page_count") <= full_text_pages
    body = strip(F.col("text"))
    n = (F.col("page") + 1).cast("string")
    blank = is_blank(F.col("text"))
    current = F.when(
        here,
        F.when(blank, F.concat(F.lit("Page "), n, F.lit(" has no extractable text."))).otherwise(
            F.substring("text", 1, 4000)
        ),
    )
    other = F.when(short & ~here & ~blank, F.substring(body, 1, 2000)).when(
        ~short & ~blank, F.substring(F.substring_index(body, "\n", 1), 1, 100)
    )
    parts = F.array(
        F.struct(F.lit(1).alias("section"), current.alias("context")),
        F.struct(F.lit(2).alias("section"), other.alias("context")),
    )
    return (
        at.select("doc_id", "page_count", "page", F.explode(parts).alias("p"))
        .select("doc_id", "page_count", "page", "p.section", "p.context")
        .where(F.col("context").isNotNull())
    )
