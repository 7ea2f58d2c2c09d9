"""Line dedup with a log-template tree.

Lines that differ only in some fields ("Page 3 of 9", "posted by ann") come from
one template. The tree has fixed depth: a line goes by its number of tokens, then
by its first ``LEADING`` tokens, where one with a digit counts as a field. In a
leaf a position whose most frequent token covers less than ``SHARE`` of the leaf's
lines is a field. A line's template is its tokens with the fields masked; it
counts if at least ``SHARE`` of its tokens are not masked, else the line itself is
its template. A template found in ``MIN_DOCS`` documents or more recurs, and all
its lines are dropped from every document, the first ones too.

Only leaves with ``MIN_DOCS`` lines are looked into, which loses nothing. All is
counting by leaf, position and template, combined before each shuffle; no leaf is
ever gathered. Equal lines are one row with a count from the second step on.

Defined results: null text is empty; lines without a token stay; a line repeated
within one document counts once; ``doc_id`` null is a document of its own; of
several rows of one ``doc_id`` the lines count as one document's; order and line
ends stay as they were; an empty table gives no rows; other columns are neither
read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of
from quire.session import cut_lineage

LEADING = 3
MIN_DOCS = 5
SHARE = 0.5
FIELD = "<*>"


def tokens_of(line):
    """Tokens ``[^\\x20\\x09-\\x0D]+`` of a line."""
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def _leaf(tokens):
    leading = F.transform(F.slice(tokens, 1, LEADING), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.concat_ws(" ", leading))


def recurring_lines(texts: DataFrame) -> DataFrame:
    """(line) every distinct line of ``texts`` (doc_id, text) whose template recurs."""
    lines = texts.select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("leaf", F.xxhash64(_leaf(tokens_of(F.col("line")))))
    leaves = cut_lineage(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select("leaf"))
    found = cut_lineage(lines.join(leaves, "leaf").select("leaf", "doc_id", "line"))
    counted = cut_lineage(found.groupBy("leaf", "line").agg(F.count("*").alias("n")))
    split = counted.withColumn("tokens", tokens_of(F.col("line")))
    at = split.select("leaf", "n", F.posexplode("tokens").alias("pos", "token"))
    at = at.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    at = at.groupBy("leaf", "pos").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    fields = at.where(F.col("most") < SHARE * F.col("n")).groupBy("leaf").agg(F.collect_set("pos").alias("fields"))
    masked = split.join(cut_lineage(fields), "leaf", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<int>")))
    kept = F.size("tokens") - F.size("fields")
    template = F.transform("tokens", lambda t, i: F.when(F.array_contains("fields", i), F.lit(FIELD)).otherwise(t))
    template = F.when(kept >= SHARE * F.size("tokens"), F.concat_ws(" ", template)).otherwise(
        F.concat_ws("\n", F.lit(""), F.concat_ws(" ", "tokens"))
    )
    named = cut_lineage(masked.select("leaf", "line", F.xxhash64("leaf", template).alias("template")))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), "line"))
    pairs = found.join(named, ["leaf", "line"]).select("template", doc.alias("doc")).distinct()
    often = pairs.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("template")
    return named.join(cut_lineage(often), "template").select("line")


def without_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text without the recurring lines."""
    texts = text_of(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    # the print tells rows of one id with different texts apart
    texts = texts.withColumn("print", F.xxhash64("text"))
    gone = cut_lineage(recurring_lines(texts).select(F.xxhash64("line").alias("hash")).distinct())
    mine = texts.select("doc_id", "print", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    mine = mine.select("doc_id", "print", F.xxhash64("line").alias("hash")).join(gone, "hash")
    mine = cut_lineage(mine.groupBy("doc_id", "print").agg(F.collect_set("hash").alias("gone")).withColumnRenamed("doc_id", "id"))
    out = texts.join(mine.withColumnRenamed("print", "seen"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("seen")), "left")
    lines = F.split("text", "\n")
    stay = F.when(F.col("gone").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("gone", F.xxhash64(x)))
    )
    out = out.select("doc_id", lines.alias("lines"), stay.alias("stay"))
    n = F.size("lines").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256."""
    return without_recurring(docs, key, text).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE = rf"""
    WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT DISTINCT doc_id, unnest(lines) AS line FROM raw),
    t AS (
        SELECT doc_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens
        FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    f AS (
        SELECT doc_id, line, tokens, array_to_string(list_concat([CAST(len(tokens) AS VARCHAR)], list_transform(
            tokens[1:{LEADING}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END)), ' ') AS leaf
        FROM t),
    leaves AS (SELECT leaf FROM f GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
    c AS (SELECT leaf, line, tokens, count(*) AS n FROM f JOIN leaves USING (leaf) GROUP BY ALL),
    p AS (SELECT leaf, n, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM c),
    q AS (SELECT leaf, pos, token, sum(n) AS n FROM p GROUP BY ALL),
    v AS (SELECT leaf, pos FROM q GROUP BY ALL HAVING max(n) < {SHARE} * sum(n)),
    w AS (SELECT leaf, list(pos) AS fields FROM v GROUP BY leaf),
    m AS (
        SELECT c.leaf, c.line, c.tokens, coalesce(w.fields, []) AS fields
        FROM c LEFT JOIN w USING (leaf)),
    named AS (
        SELECT leaf, line, CASE WHEN len(tokens) - len(fields) >= {SHARE} * len(tokens)
            THEN array_to_string(list_transform(tokens, lambda x, i:
                CASE WHEN list_contains(fields, i - 1) THEN '{FIELD}' ELSE x END), ' ')
            ELSE chr(10) || array_to_string(tokens, ' ') END AS template
        FROM m),
    often AS (
        SELECT leaf, template FROM f JOIN named USING (leaf, line) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    gone AS (SELECT DISTINCT line FROM named JOIN often USING (leaf, template)),
    e AS (SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM raw),
    k AS (
        SELECT doc_id, any_value(n_lines) AS n_lines, count(gone.line) AS n_dropped,
               string_agg(e.line, chr(10) ORDER BY i) FILTER (WHERE gone.line IS NULL) AS text
        FROM e LEFT JOIN gone USING (line) GROUP BY doc_id)
    SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS text_sha256 FROM k
"""
