"""Queries over message intent."""

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import intent, layout
from quire.plans import parts as P
from quire.plans.layout import HIT
from quire.plans.registry import query
from quire.sources import corpus


def _strip(e):
    return P.strip(e)


def _ex(col, pattern, n, flags=""):
    return f"regexp_extract({col}, {P.lit(flags + pattern)}, {n})"


def _is(col, pattern, flags=""):
    return f"regexp_matches({col}, {P.lit(flags + pattern)})"


def _num(e):
    return f"CASE WHEN {e} <> '' THEN try_cast({e} AS BIGINT) - 1 END"


def rules_sql(mode):
    """(condition, action, {argument: expression}) in order, over columns msg, low, current_page."""
    strict = mode == "strict"
    out = []
    for p in (fv.INTENT_COUNT_LONG, fv.INTENT_COUNT_SHORT):
        out.append((_is("low", p), "query_count", {"term": f"rtrim({_strip(_ex('low', p, 1))}, '?')"}))
    out.append((_is("low", fv.INTENT_PAGES), "query_pages", {}))
    quotes, tail = P.lit("\"'"), P.lit("\"'.,")
    for p in fv.INTENT_REPLACE:
        repl = f"trim({_strip(_ex('msg', p, 2, '(?i)'))}, {tail})"
        if strict:
            repl = f"trim(regexp_replace({repl}, {P.lit('(?i)' + intent.PAGE_TAIL)}, ''), {tail})"
        out.append((
            _is("msg", p, "(?i)"), "replace",
            {"find": f"trim({_strip(_ex('msg', p, 1, '(?i)'))}, {quotes})", "repl": repl,
             "scope": _num(_ex("low", fv.INTENT_SCOPE, 1))},
        ))
    p = fv.INTENT_DELETE_TEXT
    if strict:
        p = intent.STRICT_DELETE_TEXT
    term = f"rtrim({_strip(_ex('msg', p, 1, '(?i)'))}, '.')"
    out.append((
        f"{_is('msg', p, '(?i)')} AND NOT (contains(low, 'delete') AND contains(split_part(low, 'delete', 1), 'page'))"
        f" AND {term} <> '' AND length({term}) < {fv.MAX_DELETE_TERM} AND NOT {_is(term, fv.INTENT_NOT_TEXT, '(?i)')}",
        "delete_text", {"find": term},
    ))
    p = fv.INTENT_DELETE_PAGES
    start = _num(_ex("low", p, 1))
    out.append((_is("low", p), "delete_pages", {"start": start, "end": f"coalesce({_num(_ex('low', p, 2))}, {start})"}))
    p = fv.INTENT_ROTATE
    out.append((_is("low", p), "rotate_page", {"page": f"coalesce({_num(_ex('low', p, 1))}, current_page)"}))
    out.append(("contains(low, 'rotate') AND contains(low, 'this')", "rotate_page", {"page": "current_page"}))
    for kind, p in fv.INTENT_EXTRACT.items():
        if strict and kind == "urls":
            p = intent.STRICT_URLS
        out.append((_is("low", p), "extract", {"kind": f"'{kind}'"}))
    out.append((_is("low", fv.INTENT_REDACT_SSN), "redact", {"kind": "'ssn'"}))
    out.append((_is("low", fv.INTENT_REDACT_OTHER), "redact", {"kind": _ex("low", fv.INTENT_REDACT_KIND, 1)}))
    p = fv.INTENT_ADD_TEXT
    out.append((
        _is("msg", p, "(?i)"), "add_text",
        {"new_text": _ex("msg", p, 1, "(?i)"), "page": f"coalesce({_num(_ex('msg', p, 2, '(?i)'))}, current_page)"},
    ))
    out.append((_is("low", fv.INTENT_SUMMARIZE), "summarize", {}))
    out.append((_is("low", fv.INTENT_WORD_COUNT), "word_count", {}))
    return out


def intents_cte(mode):
    rules = rules_sql(mode)
    which = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(rules)) + " ELSE -1 END"
    action = "CASE rule " + " ".join(f"WHEN {i} THEN '{a}'" for i, (_, a, _) in enumerate(rules)) + " ELSE 'unknown' END"
    types = {"scope": "BIGINT", "start": "BIGINT", "end": "BIGINT", "page": "BIGINT"}
    args = ", ".join(
        "(CASE rule "
        + " ".join(f"WHEN {i} THEN {given[name]}" for i, (_, _, given) in enumerate(rules) if name in given)
        + f' END)::{types.get(name, "VARCHAR")} AS "{name}"'
        for name in intent.ARGS
    )
    return f"""it AS (SELECT conv_id, turn, role, part, text, current_page, {action} AS action, {args}
      FROM (SELECT *, {which} AS rule FROM (SELECT *, lower(msg) AS low FROM (SELECT *, {_strip("text")} AS msg FROM ms))))"""


@query("message_intent", P.sql([P.MS, intents_cte("reference")], "SELECT conv_id, turn, part, action FROM it"))
def _(spark, sf):
    return intent.message_intent(corpus.messages(spark, sf)).select("conv_id", "turn", "part", "action")


COLS = ["conv_id", "turn", "part", "action", *intent.ARGS]
COLS_SQL = ", ".join(f'"{c}"' for c in COLS)

for _key, _mode in (("intent_args", "reference"), ("intent_args_strict", "strict")):

    @query(_key, P.sql([P.MS, intents_cte(_mode)], f"SELECT {COLS_SQL} FROM it"))
    def _(spark, sf, mode=_mode):
        return intent.intent_args(corpus.messages(spark, sf), mode).select(*COLS)


def _boxes(spark, sf):
    """A selected box for the commands on even turns, on the document of the same number."""
    t = F.col("turn")
    return corpus.table(spark, sf, "conversations").where("turn % 2 = 0").select(
        F.format_string("%d/%d", F.col("conv_id"), t).alias("region_id"), F.col("conv_id").alias("doc_id"), (t % 3).cast("int").alias("page"),
        F.lit(72.0).alias("rx0"), F.lit(72.0).alias("ry0"), F.lit(300.0).alias("rx1"), F.lit(95.0).alias("ry1"),
        "conv_id", "turn",
    )


@query(
    "intent_region_context",
    P.sql([P.SP, P.MS, intents_cte("reference"), f"""
    bx AS (SELECT conv_id, turn, conv_id AS doc_id, turn % 3 AS page, 72 AS rx0, 72 AS ry0, 300 AS rx1, 95 AS ry1
           FROM conversations WHERE turn % 2 = 0),
    bt AS (SELECT conv_id, turn, {P.strip("string_agg(sp.text, chr(10) ORDER BY block, line)")} AS rt
           FROM bx JOIN sp USING (doc_id, page) WHERE {HIT.replace("text", "sp.text")} GROUP BY ALL)"""], """
    SELECT conv_id, turn, part,
      CASE WHEN rt <> '' AND action = 'redact' AND coalesce(kind, '') = '' THEN 'delete_text'
           WHEN rt <> '' AND action = 'unknown' THEN 'query_region' ELSE action END AS action,
      CASE WHEN rt <> '' AND ((action IN ('replace', 'delete_text') AND coalesce(find, '') = '')
                              OR (action = 'redact' AND coalesce(kind, '') = '')) THEN rt ELSE find END AS find,
      CASE WHEN rt <> '' AND action = 'unknown' THEN rt END AS answer
    FROM it LEFT JOIN bt USING (conv_id, turn)"""),
)
def _(spark, sf):
    boxes = _boxes(spark, sf)
    read = layout.region_text(corpus.spans(spark, sf), boxes).select("conv_id", "turn", F.col("text").alias("region_text"))
    found = intent.intents(corpus.messages(spark, sf))
    return intent.intent_region_context(found, read, ["conv_id", "turn"]).select(
        "conv_id", "turn", "part", "action", "find", "answer"
    )
