"""Queries over entities, topics, summaries, languages and comparison."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import compare, entities, language, topics
from quire.plans import parts as P
from quire.plans.registry import query
from quire.sources import corpus


@query(
    "entities",
    P.sql([P.PG, P.OP, P.EP], f"""
    SELECT doc_id, entity_type, value, fp[1]::INTEGER AS page, fp[2]::INTEGER AS pos
    FROM (SELECT doc_id, entity_type, value, min([page, pos]) AS fp FROM ({P.entity_rows("ep")}) GROUP BY ALL)"""),
)
def _(spark, sf):
    return entities.entities(corpus.entity_pages(spark, sf))


@query(
    "key_info",
    P.sql([P.PG, P.OP, P.EP], f"""
    SELECT doc_id, {", ".join(f"count(DISTINCT value) FILTER (entity_type = '{t}') AS {t}" for t in fv.KEY_INFO_TYPES)}
    FROM ({P.entity_rows("ep", fv.KEY_INFO_TYPES)}) GROUP BY doc_id"""),
)
def _(spark, sf):
    return entities.key_info_counts(corpus.entity_pages(spark, sf))


def _doc_texts(spark, sf):
    """Documents, and each order page as a document of its own."""
    own = corpus.docs(spark, sf)
    orders = corpus.order_pages(spark, sf).select((F.col("doc_id") * 8 + F.col("page")).alias("doc_id"), "text")
    return own.unionByName(orders)


DT = "dt AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id * 8 + page, text FROM op)"

for _kind, _pattern in fv.EXTRACT_PATTERNS.items():
    _found = P.found("text", _pattern)
    if _kind == "phones":
        _found = f"list_filter(list_transform({_found}, lambda x: {P.strip('x')}), lambda x: length(x) >= 7)"

    @query(
        f"extract_data_{_kind}",
        P.sql([P.OP, DT], f"""
        SELECT doc_id, value, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS pos FROM (
          SELECT doc_id, v[i] AS value, min(i) AS p FROM (
            SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, {_found} AS v FROM dt)) GROUP BY ALL)"""),
    )
    def _(spark, sf, kind=_kind):
        return entities.extract_data(_doc_texts(spark, sf), kind)


@query(
    "extract_data_raw",
    P.sql([P.OP, DT], f"""
    SELECT doc_id, {", ".join(f"array_to_string({P.found('text', p)}, '|') AS {k}" for k, p in fv.EXTRACT_PATTERNS.items())}
    FROM dt"""),
)
def _(spark, sf):
    raw = entities.extract_data_raw(_doc_texts(spark, sf))
    return raw.select("doc_id", *[F.array_join(k, "|").alias(k) for k in fv.EXTRACT_PATTERNS])


TW = f"""tw AS (
  SELECT doc_id, word, count(*) AS count, min(i) AS first_pos FROM (
    SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
                                 lambda x: regexp_full_match(x, '[a-z]{{4,}}')) AS w FROM documents)))
  WHERE word NOT IN ({", ".join(P.lit(w) for w in fv.STOP_WORDS)}) GROUP BY ALL)"""


@query(
    "key_topics",
    P.sql(TW, """
    SELECT doc_id, word, count, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first_pos) AS rank FROM tw) WHERE rank <= 20"""),
)
def _(spark, sf):
    return topics.key_topics(corpus.docs(spark, sf))


def summary_sql(e, variant):
    if variant == "analysis":
        s, keep, empty, marks = P.sentences(e, "[.!?]+", 20), 5, "'No extractable text.'", ("0", "n // 4", "n // 2", "3 * n // 4")
    elif variant == "brief":
        s, keep, empty, marks = P.sentences(e, "[.]", 10), 3, "'No text found.'", ("0", "n // 3", "2 * n // 3")
    else:
        s, keep, empty, marks = P.sentences(e, "[.]", 0), 3, None, ("0", "n // 2")
    picks = "array_to_string([" + ", ".join(f"s[{m} + 1]" for m in marks) + ", s[n]], '. ') || '.'"
    whole = e if empty is None else "array_to_string(s, '. ') || '.'"
    first = "" if empty is None else f"WHEN n = 0 THEN {empty} "
    return f"""SELECT doc_id, CASE {first}WHEN n <= {keep} THEN {whole} ELSE {picks} END AS summary
      FROM (SELECT *, len(s) AS n FROM (SELECT doc_id, text, {s} AS s FROM documents))"""


for _key, _variant in (("summary_sections", "analysis"), ("summary_brief", "brief"), ("summary_assist", "assist")):

    @query(_key, summary_sql("text", _variant))
    def _(spark, sf, variant=_variant):
        return corpus.docs(spark, sf).select("doc_id", topics.summary(F.col("text"), variant).alias("summary"))


def _script_sql():
    share = "0.1::DOUBLE * length(text)"
    return "CASE " + " ".join(
        f"WHEN len(regexp_extract_all(text, '{c}')) > {share} THEN '{n}'" for n, _, c in fv.SCRIPTS
    ) + " END"


_LANG_OF_SCRIPT = "CASE script " + " ".join(f"WHEN '{n}' THEN '{lang}'" for n, lang, _ in fv.SCRIPTS) + " END"
# documents, and the same texts with their words turned into other scripts
SD = """sd AS (
  SELECT doc_id, text FROM documents
  UNION ALL SELECT -(doc_id * 4 + 1), translate(text, 'aeion', 'цдежз') FROM documents
  UNION ALL SELECT -(doc_id * 4 + 2), translate(text, 'aeion', '的是不我一') FROM documents
  UNION ALL SELECT -(doc_id * 4 + 3), translate(text, 't', 'ا') FROM documents)"""


def _script_docs(spark, sf):
    d = corpus.docs(spark, sf)
    out = d
    for kind, old, new in (
        (0, "aeion", "цдежз"),
        (1, "aeion", "的是不我一"),
        (2, "t", "ا"),
    ):
        out = out.unionByName(d.select(corpus.other_id(F.col("doc_id"), kind).alias("doc_id"), F.translate("text", old, new).alias("text")))
    return out


@query(
    "detect_script",
    P.sql(SD, f"""
    SELECT doc_id, script, {_LANG_OF_SCRIPT} AS language, CASE WHEN script IS NOT NULL THEN 0.8::DOUBLE END AS confidence
    FROM (SELECT doc_id, {_script_sql()} AS script FROM sd)"""),
)
def _(spark, sf):
    return language.detect_script(_script_docs(spark, sf))


LANG_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS rk, '{lang}' AS lang, unnest({P.lits(ws)}) AS word" for i, (lang, ws) in enumerate(fv.LANGUAGE_WORDS.items())
)


def language_ctes(src):
    return f"""ld AS (
      SELECT doc_id, {P.strip("text")} = '' AS blank, {_script_sql()} AS script,
             list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
                                       lambda x: regexp_full_match(x, '[a-z]+'))) AS w FROM {src}),
    lw AS ({LANG_ROWS}),
    sc AS (SELECT doc_id, rk, lang, count(*) / 14.0::DOUBLE AS score FROM (SELECT doc_id, unnest(w) AS word FROM ld)
           JOIN lw USING (word) GROUP BY ALL),
    bs AS (SELECT doc_id, lang, score FROM sc
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rk) = 1),
    lg AS (SELECT doc_id, CASE WHEN blank OR (script IS NULL AND score IS NULL) THEN 'unknown'
             WHEN script IS NOT NULL THEN {_LANG_OF_SCRIPT} ELSE lang END AS language,
             CASE WHEN blank OR (script IS NULL AND score IS NULL) THEN 0::DOUBLE
             WHEN script IS NOT NULL THEN 0.8::DOUBLE ELSE round(score, 2) END AS confidence
           FROM ld LEFT JOIN bs USING (doc_id))"""


@query("detect_language", P.sql([SD, language_ctes("sd")], "SELECT doc_id, language, confidence FROM lg"))
def _(spark, sf):
    return language.detect_language(_script_docs(spark, sf))


@query("language_scores", P.sql([SD, language_ctes("sd")], "SELECT doc_id, lang AS language, round(score, 2) AS score FROM sc"))
def _(spark, sf):
    return language.language_shares(_script_docs(spark, sf))


@query(
    "page_similarity",
    P.sql(P.PG, f""",
    pr AS (SELECT doc_id * 2 AS pair_id, doc_id AS doc_a, 0 AS page_a, doc_id AS doc_b, 1 AS page_b FROM documents
           UNION ALL SELECT doc_id * 2 + 1, doc_id, 0, doc_id + 1, 0 FROM documents),
    pf AS (SELECT doc_id, page, left(text, 500) AS preview, {P.words("lower(text)")} AS w FROM pg),
    jn AS (
      SELECT pair_id, doc_a, page_a, doc_b, page_b, a.preview AS preview_a, b.preview AS preview_b,
             len(a.w)::INTEGER AS word_count_a, len(b.w)::INTEGER AS word_count_b,
             list_distinct(a.w) AS da, list_distinct(b.w) AS db
      FROM pr LEFT JOIN pf a ON a.doc_id = doc_a AND a.page = page_a LEFT JOIN pf b ON b.doc_id = doc_b AND b.page = page_b)
    SELECT * EXCLUDE (da, db, common), common AS common_words, (len(da) - common)::INTEGER AS unique_to_a,
           (len(db) - common)::INTEGER AS unique_to_b,
           round(common / greatest(len(da) + len(db) - common, 1)::DOUBLE, 3) AS similarity,
           CASE WHEN common IS NULL THEN 'invalid page numbers' END AS error
    FROM (SELECT *, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN len(list_intersect(da, db))::INTEGER END AS common
          FROM jn)""".lstrip()),
)
def _(spark, sf):
    d = corpus.docs(spark, sf)
    n = F.col("doc_id")
    both = F.array(
        F.struct((n * 2).alias("pair_id"), n.alias("doc_a"), F.lit(0).alias("page_a"), n.alias("doc_b"), F.lit(1).alias("page_b")),
        F.struct((n * 2 + 1).alias("pair_id"), n.alias("doc_a"), F.lit(0).alias("page_a"), (n + 1).alias("doc_b"), F.lit(0).alias("page_b")),
    )
    pairs = d.select(F.explode(both).alias("p")).select("p.*")
    return compare.page_similarity(corpus.pages(spark, sf), pairs)


def _versions(spark, sf):
    d = corpus.docs(spark, sf)
    pages = corpus.pages_of(d.unionByName(corpus.edited_copies(d)))
    pairs = d.select(
        F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("doc_a"), corpus.other_id(F.col("doc_id"), 1).alias("doc_b")
    )
    return pages, pairs


@query("document_diff")
def _(spark, sf):
    return compare.document_diff(*_versions(spark, sf))


_STRIPPED = "CASE WHEN ends_with({0}, chr(10)) THEN left({0}, length({0}) - 1) ELSE {0} END"
_LINES = f"CASE WHEN {{0}} = '' THEN 0 ELSE len(string_split({_STRIPPED}, chr(10))) END"


# the copies' pages, in the way edited_copies makes them
CP = """c2 AS (
  SELECT doc_id, list_concat(list_transform(list_filter(list_zip(l, range(0, len(l))), lambda z: z[2] % 11 <> 9), lambda z: z[1]),
                             ['appended line']) AS ls
  FROM (SELECT doc_id, string_split(replace(text, ' the ', ' that '), chr(10)) AS l FROM documents)),
la AS (SELECT doc_id, i // 8 AS page, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM ln)),
lb AS (SELECT doc_id, i // 8 AS page, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM c2))"""


@query(
    "document_diff_rebuild",
    P.sql([P.LN, CP], f""",
    pa AS (SELECT doc_id, page, string_agg(ls[i + 1], chr(10) ORDER BY i) AS a FROM (SELECT doc_id, ls, i // 8 AS page, i FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM ln)) GROUP BY doc_id, page),
    pb AS (SELECT doc_id, page, string_agg(ls[i + 1], chr(10) ORDER BY i) AS b FROM (SELECT doc_id, ls, i // 8 AS page, i FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM c2)) GROUP BY doc_id, page),
    ab AS (SELECT doc_id, page, coalesce(a, '') AS a, coalesce(b, '') AS b FROM pa FULL JOIN pb USING (doc_id, page))
    SELECT doc_id AS pair_id, page::INTEGER AS page, ({_LINES.format("b")} - {_LINES.format("a")})::BIGINT AS net_lines,
           sha256({_STRIPPED.format("a")}) AS old_sha, sha256({_STRIPPED.format("b")}) AS new_sha, true AS enough
    FROM ab WHERE {_STRIPPED.format("a")} <> {_STRIPPED.format("b")} OR {_LINES.format("a")} <> {_LINES.format("b")}""".lstrip()),
)
def _(spark, sf):
    """The alignment rebuilds both pages, and has at least the changes that any order of lines needs."""
    pages, pairs = _versions(spark, sf)
    edits = compare.page_edits(pages, pairs)
    at, line = ["pair_id", "page"], F.struct("pos", "line")

    def text(op):
        kept = F.sort_array(F.collect_list(F.when(F.col("op") != op, line)))
        return F.sha2(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), 256)

    def count(op):
        return F.sum(F.when(F.col("op") == op, 1).otherwise(0))

    whole = edits.groupBy(*at).agg(count("+").alias("more"), count("-").alias("less"), text("+").alias("old_sha"), text("-").alias("new_sha"))
    least = compare.line_changes(pages, pairs)
    both = whole.join(least, at, "left")
    enough = (F.col("more") >= F.coalesce("lines_added", F.lit(0)) - 1) & (F.col("less") >= F.coalesce("lines_removed", F.lit(0)) - 1)
    return both.select(*at, (F.col("more") - F.col("less")).alias("net_lines"), "old_sha", "new_sha", enough.alias("enough"))


@query(
    "line_changes",
    P.sql([P.LN, CP], """
    SELECT doc_id AS pair_id, page::INTEGER AS page, sum(greatest(d, 0))::BIGINT AS lines_added,
           sum(greatest(-d, 0))::BIGINT AS lines_removed FROM (
      SELECT doc_id, page, line, sum(d) AS d FROM (
        SELECT *, -1 AS d FROM la UNION ALL SELECT *, 1 FROM lb) GROUP BY ALL HAVING sum(d) <> 0) GROUP BY ALL"""),
)
def _(spark, sf):
    return compare.line_changes(*_versions(spark, sf))


@query(
    "page_count_changes",
    P.sql([P.LN, CP], """
    SELECT doc_id AS pair_id, a AS doc1_pages, b AS doc2_pages, greatest(b - a, 0) AS pages_added,
           greatest(a - b, 0) AS pages_removed FROM (
      SELECT ln.doc_id, ((len(ln.ls) + 7) // 8)::INTEGER AS a, ((len(c2.ls) + 7) // 8)::INTEGER AS b
      FROM ln JOIN c2 USING (doc_id))"""),
)
def _(spark, sf):
    return compare.page_count_changes(*_versions(spark, sf))


@query(
    "doc_context",
    P.sql(P.PG, f""",
    x AS (SELECT pg.*, doc_id % 3 AS cur, count(*) OVER (PARTITION BY doc_id)::INTEGER AS page_count, {P.strip("text")} AS body
          FROM pg)
    SELECT doc_id, page_count, page, 1 AS section,
           CASE WHEN body = '' THEN 'Page ' || (page + 1) || ' has no extractable text.' ELSE left(text, 4000) END AS context
    FROM x WHERE page = cur
    UNION ALL
    SELECT doc_id, page_count, page, 2, CASE WHEN page_count <= 20 THEN left(body, 2000)
           ELSE left(split_part(body, chr(10), 1), 100) END
    FROM x WHERE body <> '' AND (page_count > 20 OR page <> cur)""".lstrip()),
)
def _(spark, sf):
    focus = corpus.docs(spark, sf).select("doc_id", (F.col("doc_id") % 3).cast("int").alias("current_page"))
    return compare.doc_context(corpus.pages(spark, sf), focus)
