"""Several named operations in a row over one corpus, with one result row each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import literal_count, word_count
from quire.operators import entities, layout, pageset, search
from quire.session import shared_dir

Corpus = dict[str, DataFrame]
#: what an operation returns: the changed corpus, and its count, seen as the rows pass by or asked for apart
Count = Observation | DataFrame
Operation = Callable[[Corpus, dict], tuple[Corpus, Count]]


def _seen(df: DataFrame, count: Column) -> tuple[DataFrame, Observation]:
    """``df`` and a count over its rows, taken when they are written."""
    seen = Observation(f"step-{uuid.uuid4()}")
    return df.observe(seen, F.coalesce(count, F.lit(0)).cast("bigint").alias("n")), seen


def _apart(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _replace(c: Corpus, op: dict):
    done = search.replaced_spans(c["spans"], op["find"], op["replace"], op.get("page"))
    done, seen = _seen(done, F.count_if("changed"))
    return {**c, "spans": done.drop("changed")}, seen


def _delete_text(c: Corpus, op: dict):
    done, seen = _seen(search.delete_text(c["pages"], op["text"]), F.sum("deleted"))
    return {**c, "pages": done.drop("deleted")}, seen


def _redact(c: Corpus, op: dict):
    done, seen = _seen(search.redact_pattern(c["pages"], op["kind"], op.get("mask", "")), F.sum("redacted"))
    return {**c, "pages": done.drop("redacted")}, seen


def _delete_pages(c: Corpus, op: dict):
    status = pageset.deletion_status(c["pages"], op["ranges"]).where("status = 'ok'")
    return {**c, "pages": pageset.delete_pages(c["pages"], op["ranges"])}, _apart(status)


def _rotate(c: Corpus, op: dict):
    hit = op["edits"].join(c["pages"].select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return {**c, "pages": pageset.rotate_pages(c["pages"], op["edits"])}, _apart(hit)


def _reorder(c: Corpus, op: dict):
    good = pageset.order_status(c["pages"], op["orders"]).where("status = 'ok'")
    return {**c, "pages": pageset.reorder_pages(c["pages"], op["orders"])}, _apart(good)


def _add_text(c: Corpus, op: dict):
    good = layout.addition_status(c["pages"], op["additions"]).where("status = 'ok'")
    return {**c, "spans": layout.add_spans(c["spans"], c["pages"], op["additions"])}, _apart(good)


def _options(op: dict, **names: str) -> dict:
    """The given options of an operation under the names a layout function has for them."""
    return {name: op[option] for option, name in names.items() if op.get(option) is not None}


def _marked(c: Corpus, kind: str, placed: DataFrame, content: str, opacity: Column) -> tuple[Corpus, Observation]:
    marks = placed.select("doc_id", "page", F.lit(kind).alias("kind"), F.col(content).alias("text"), "x", "y", "size", "rotation", opacity.alias("opacity"))
    marks, seen = _seen(marks, F.count(F.lit(1)))
    return {**c, "marks": c["marks"].unionByName(marks) if "marks" in c else marks}, seen


def _stamp(c: Corpus, op: dict):
    chosen = _options(op, text="template", position="position", size="font_size", margin="margin", pages="only", as_of="as_of")
    placed = layout.stamp_layout(c["pages"], c.get("names"), c["glyphs"], **chosen)
    size = F.lit(float(chosen.get("font_size", fv.STAMP_FONT_SIZE)))
    return _marked(c, "stamp", placed.withColumn("size", size).withColumn("rotation", F.lit(0.0)), "stamp", F.lit(1.0))


def _watermark(c: Corpus, op: dict):
    chosen = _options(op, text="text", size="font_size", rotation="rotation", opacity="opacity", pages="only")
    placed = layout.watermark_layout(c["pages"], c["glyphs"], **chosen)
    size = F.lit(float(chosen.get("font_size", fv.WATERMARK_FONT_SIZE)))
    turned = F.lit(float(chosen.get("rotation", fv.WATERMARK_ROTATION)))
    return _marked(c, "watermark", placed.withColumn("size", size).withColumn("rotation", turned), "watermark", F.col("opacity"))


def _search(c: Corpus, op: dict):
    pages, seen = _seen(c["pages"], F.sum(literal_count(F.lower("text"), op["query"].lower())))
    return {**c, "pages": pages}, seen


def _extract(c: Corpus, op: dict):
    return c, _apart(entities.entities(c["pages"], (op["kind"],)))


def _page_count(c: Corpus, op: dict):
    pages, seen = _seen(c["pages"], F.count(F.lit(1)))
    return {**c, "pages": pages}, seen


def _word_count(c: Corpus, op: dict):
    pages, seen = _seen(c["pages"], F.sum(word_count(F.col("text"))))
    return {**c, "pages": pages}, seen


OPERATIONS: dict[str, Operation] = {
    "replace": _replace,
    "replace_text": _replace,
    "delete_text": _delete_text,
    "redact_pattern": _redact,
    "delete_pages": _delete_pages,
    "rotate_page": _rotate,
    "reorder_pages": _reorder,
    "add_text": _add_text,
    "stamp": _stamp,
    "watermark": _watermark,
    "search_text": _search,
    "extract_data": _extract,
    "get_page_count": _page_count,
    "get_word_count": _word_count,
}
RESULT = "step int, type string, status string, n long, reason string"
AIDS = ("glyphs", "names")  # tables that operations read and never change


def _planned(corpus: Corpus, ops: list[dict], known: dict[str, Operation], broken: dict[int, str]):
    """The corpus after ``ops``, the count of each step that is planned, and what is already known of the others."""
    counts, told = {}, {}
    for step, op in enumerate(ops):
        kind = op.get("type", "")
        if step in broken:
            told[step] = ("error", broken[step])
        elif kind not in known:
            told[step] = ("skipped", f"unknown operation type: {kind}")
        else:
            try:
                corpus, counts[step] = known[kind](corpus, op)
            except Exception as e:  # recorded; the other operations go on
                told[step] = ("error", f"{type(e).__name__}: {e}")
    return corpus, counts, told


def _write(corpus: Corpus, path: str) -> None:
    # pages first: counts taken on pages are then those of this one pass
    for name in sorted(set(corpus) - set(AIDS), key=lambda n: (n != "pages", n)):
        corpus[name].write.mode("overwrite").parquet(f"{path}/{name}")


def _counted(counts: dict[int, Count]) -> dict[int, int]:
    return {step: n.get["n"] if isinstance(n, Observation) else n.first()["n"] for step, n in counts.items()}


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e.getCondition() if isinstance(e, PySparkException) and e.getCondition() else str(e).splitlines()[0]}"


def batch_operations(
    corpus: Corpus, ops: list[dict], path: str | None = None, more: dict[str, Operation] | None = None
) -> tuple[Corpus, DataFrame]:
    """Run ``ops`` in order; returns the changed corpus, read back from ``path``, and one result row per operation.

    Each table is read once and written once, with all steps in that one pass; what the steps did is counted as the
    rows go by. Counts that need other rows (statuses of page ranges, distinct entities) are small queries after it.
    Tables named in ``AIDS`` (glyph widths, file names) are only read.

    An unknown type is skipped with a reason. A step that cannot be planned is an error and the others go on. So is
    one that fails on a row: when the pass fails, passes over its first half, quarter, ... find the first step that it
    fails with, and the pass is run again without it. ``more`` adds operations of one's own.
    """
    spark = next(iter(corpus.values())).sparkSession
    path = path or f"{shared_dir(spark)}/batch-{uuid.uuid4()}"
    known = {**OPERATIONS, **(more or {})}
    broken: dict[int, str] = {}

    def passes(steps: int, into: str):
        after, counts, told = _planned(corpus, ops[:steps], known, broken)
        _write(after, into)
        return after, _counted(counts), told

    while True:
        try:
            after, counts, told = passes(len(ops), path)
            break
        except Exception as e:
            # the shortest list that fails ends with the step to blame; without any step the corpus itself is unreadable
            good, bad, why = -1, len(ops), e
            while bad - good > 1:
                half = (good + bad) // 2
                try:
                    passes(half, f"{shared_dir(spark)}/batch-{uuid.uuid4()}")
                    good = half
                except Exception as other:
                    bad, why = half, other
            if bad == 0 or bad - 1 in broken:
                raise
            broken[bad - 1] = _reason(why)
    rows = []
    for step, op in enumerate(ops):
        status, reason = told.get(step, ("ok", None))
        rows.append((step, op.get("type", ""), status, counts.get(step, 0), reason))
    aids = {name: corpus[name] for name in AIDS if name in corpus}
    return {**{n: spark.read.parquet(f"{path}/{n}") for n in after if n not in AIDS}, **aids}, spark.createDataFrame(rows, RESULT)


def history_entry(ops: list[dict]) -> str:
    """The single history label of a batch."""
    return "Batch: " + ", ".join(op.get("type", "") for op in ops)


def stored(corpus: Corpus, path: str) -> None:
    """Write every table of a corpus below ``path``."""
    for name, df in corpus.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str, names=("pages", "spans")) -> Corpus:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of documents whose pages differ, so that a sink can skip the others."""
    def digest(df: DataFrame) -> DataFrame:
        row = F.xxhash64("page", "rotation", "text").cast("decimal(38,0)")
        return df.groupBy("doc_id").agg(F.sum(row).alias("h"), F.count(F.lit(1)).alias("n"))

    a, b = digest(before), digest(after)
    return (
        a.join(b.withColumnsRenamed({"h": "h2", "n": "n2"}), "doc_id", "full")
        .where(~(F.col("h").eqNullSafe(F.col("h2")) & F.col("n").eqNullSafe(F.col("n2"))))
        .select("doc_id")
    )


