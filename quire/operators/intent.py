"""Message intent: the first rule that matches decides, and gives its arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import strip

# (?U) Unicode classes, (?d) only a line feed ends a line
FLAGS = "(?Ud)"
NO_CASE = "(?iUd)"
STRICT_URLS = r"(?:extract|pull|find|list|get)\s+(?:all\s+)?(?:the\s+)?(?:urls?|links?)"
# as the fixed pattern, but what ends the term is a whole word
STRICT_DELETE_TEXT = (
    r"(?:delete|remove|strip|erase)\s+(?:every\s+instance\s+of\s+|all\s+instances\s+of\s+|all\s+"
    r"|the\s+(?:word|text|phrase)\s+)?[\"']?(.+?)[\"']?\s*(?:\b(?:from|in|on)\b|$)"
)
PAGE_TAIL = r"\s+(?:on|in)\s+page\s+\d+\W*$"

ARGS = ("term", "find", "repl", "scope", "start", "end", "page", "kind", "new_text")


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(c, pattern, n)


def _number(c: Column) -> Column:
    """1-based page number in text to a 0-based one, null if absent."""
    return F.when(c != "", c.try_cast("bigint") - 1)


def intents(messages: DataFrame, mode: str = "reference") -> DataFrame:
    """``messages(..., text, current_page)`` with ``action`` and its arguments.

    ``mode='strict'`` mends three loose rules: any message with "link" counts as
    a request for urls, a text to delete is cut at the letters "in", "on" or
    "from" inside a word, and "on page N" stays in the replacement.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    strict = mode == "strict"
    msg, low, here = F.col("_msg"), F.col("_low"), F.col("current_page").cast("bigint")
    df = messages.withColumn("_msg", strip(F.col("text"))).withColumn("_low", F.lower("_msg"))

    rules: list[tuple[Column, dict[str, Column]]] = []

    def rule(when: Column, action: str, **args: Column) -> None:
        rules.append((when, {"action": F.lit(action), **args}))

    for pattern in (fv.INTENT_COUNT_LONG, fv.INTENT_COUNT_SHORT):
        p = FLAGS + pattern
        rule(low.rlike(p), "query_count", term=F.rtrim(strip(_group(low, p, 1)), F.lit("?")))
    rule(low.rlike(FLAGS + fv.INTENT_PAGES), "query_pages")

    scope_p = FLAGS + fv.INTENT_SCOPE
    scope = _number(_group(low, scope_p, 1))
    for pattern in fv.INTENT_REPLACE:
        p = NO_CASE + pattern
        repl = F.btrim(strip(_group(msg, p, 2)), F.lit("\"'.,"))
        if strict:
            repl = F.btrim(F.regexp_replace(repl, NO_CASE + PAGE_TAIL, ""), F.lit("\"'.,"))
        rule(msg.rlike(p), "replace", find=F.btrim(strip(_group(msg, p, 1)), F.lit("\"'")), repl=repl, scope=scope)

    p = NO_CASE + (STRICT_DELETE_TEXT if strict else fv.INTENT_DELETE_TEXT)
    term = F.rtrim(strip(_group(msg, p, 1)), F.lit("."))
    page_first = low.contains("delete") & F.substring_index(low, "delete", 1).contains("page")
    is_text = (term != "") & (F.length(term) < fv.MAX_DELETE_TERM) & ~term.rlike(NO_CASE + fv.INTENT_NOT_TEXT)
    rule(msg.rlike(p) & ~page_first & is_text, "delete_text", find=term)

    p = FLAGS + fv.INTENT_DELETE_PAGES
    start = _number(_group(low, p, 1))
    rule(low.rlike(p), "delete_pages", start=start, end=F.coalesce(_number(_group(low, p, 2)), start))

    p = FLAGS + fv.INTENT_ROTATE
    rule(low.rlike(p), "rotate_page", page=F.coalesce(_number(_group(low, p, 1)), here))
    rule(low.contains("rotate") & low.contains("this"), "rotate_page", page=here)

    for kind, pattern in fv.INTENT_EXTRACT.items():
        wanted = STRICT_URLS if strict and kind == "urls" else pattern
        rule(low.rlike(FLAGS + wanted), "extract", kind=F.lit(kind))

    rule(low.rlike(FLAGS + fv.INTENT_REDACT_SSN), "redact", kind=F.lit("ssn"))
    rule(low.rlike(FLAGS + fv.INTENT_REDACT_OTHER), "redact", kind=_group(low, fv.INTENT_REDACT_KIND, 1))

    p = NO_CASE + fv.INTENT_ADD_TEXT
    rule(
        msg.rlike(p), "add_text", new_text=_group(msg, p, 1), page=F.coalesce(_number(_group(msg, p, 2)), here)
    )
    rule(low.rlike(fv.INTENT_SUMMARIZE), "summarize")
    rule(low.rlike(fv.INTENT_WORD_COUNT), "word_count")

    # the number of the first rule that holds, then one column per argument
    which = F.coalesce(*[F.when(when, i) for i, (when, _) in enumerate(rules)], F.lit(-1))
    df = df.withColumn("_rule", which)

    def column(name: str) -> Column:
        out = None
        for i, (_, args) in enumerate(rules):
            if name in args:
                hit = F.col("_rule") == i
                out = F.when(hit, args[name]) if out is None else out.when(hit, args[name])
        return out

    return df.select(
        *messages.columns,
        F.coalesce(column("action"), F.lit("unknown")).alias("action"),
        *[column(name).alias(name) for name in ARGS],
    )


def message_intent(messages: DataFrame, mode: str = "reference") -> DataFrame:
    return intents(messages, mode).drop(*ARGS)


def intent_args(messages: DataFrame, mode: str = "reference") -> DataFrame:
    return intents(messages, mode)


def intent_region_context(classified: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Intents with the text of a selected region put in where they lack it.

    ``regions(*on, region_text)``. A message without region text stays as it is.
    """
    joined = classified.join(regions.select(*on, "region_text"), on, "left")
    has = F.coalesce(F.col("region_text") != "", F.lit(False))
    no_find = F.coalesce(F.col("find"), F.lit("")) == ""
    no_kind = F.coalesce(F.col("kind"), F.lit("")) == ""
    action = F.col("action")
    fills = has & action.isin("replace", "delete_text") & no_find
    turns = has & (action == "redact") & no_kind
    asks = has & (action == "unknown")
    return (
        joined.withColumn("find", F.when(fills | turns, F.col("region_text")).otherwise(F.col("find")))
        .withColumn("answer", F.when(asks, F.col("region_text")))
        .withColumn("action", F.when(turns, "delete_text").when(asks, "query_region").otherwise(action))
        .drop("region_text")
    )
