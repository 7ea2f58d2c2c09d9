"""Script and language detection, computed inside each document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import all_matches, is_blank, let, literal_list


def script(text: Column) -> Column:
    """Name of the first script with more than a tenth of all characters, else null.

    A character of these scripts takes more than one byte, so texts with fewer
    further bytes than that are not searched.
    """
    share = F.length(text) * fv.SCRIPT_SHARE
    found = F.coalesce(
        *[F.when(F.regexp_count(text, F.lit(chars)) > share, name) for name, _, chars in fv.SCRIPTS]
    )
    return F.when(F.octet_length(text) - F.length(text) > share, found)


def detect_script(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", script(F.col("text")).alias("script"))
    names = F.create_map(*[F.lit(x) for name, lang, _ in fv.SCRIPTS for x in (name, lang)])
    return found.withColumn("language", F.element_at(names, F.col("script"))).withColumn(
        "confidence", F.when(F.col("script").isNotNull(), fv.SCRIPT_CONFIDENCE)
    )


def language_words(text: Column) -> Column:
    """Words of a to z in the lower-cased text, in order."""
    return all_matches(F.lower(text), fv.LANGUAGE_WORD)


def language_scores(text: Column, words: Column | None = None) -> Column:
    """Array of (score, language) in tie-breaking order; score is the share of indicator words present.

    ``words`` are the text's ``language_words``, where they are at hand.
    """
    known = literal_list(sorted({w for ws in fv.LANGUAGE_WORDS.values() for w in ws}))
    hits = F.array_intersect(language_words(text) if words is None else words, known)
    return let(
        hits,
        lambda h: F.array(
            *[
                F.struct(
                    (F.size(F.array_intersect(h, literal_list(ws))) / len(ws)).alias("score"), F.lit(lang).alias("language")
                )
                for lang, ws in fv.LANGUAGE_WORDS.items()
            ]
        ),
    )


def language_of(text: Column, words: Column | None = None) -> Column:
    """Struct of language and confidence: script first, then indicator words.

    A document is one row and the word lists are literals, so there is no
    shuffle. The first of several best scores wins.
    """
    names = F.create_map(*[F.lit(x) for name, lang, _ in fv.SCRIPTS for x in (name, lang)])
    best = let(
        language_scores(text, words),
        lambda s: F.aggregate(
            F.slice(s, 2, len(fv.LANGUAGE_WORDS) - 1),
            s[0],
            lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a),
        ),
    )

    def decide(x: Column) -> Column:
        written = x["script"].isNotNull()
        unknown = x["blank"] | (~written & (x["best"]["score"] == 0))
        name = F.when(unknown, "unknown").when(written, F.element_at(names, x["script"])).otherwise(x["best"]["language"])
        sure = F.when(unknown, 0.0).when(written, fv.SCRIPT_CONFIDENCE).otherwise(F.round(x["best"]["score"], 2))
        return F.struct(name.alias("language"), sure.alias("confidence"))

    facts = F.struct(script(text).alias("script"), best.alias("best"), is_blank(text).alias("blank"))
    return let(facts, decide)


def language_shares(docs: DataFrame) -> DataFrame:
    """One row per document and language with any of its indicator words: the rounded score."""
    scores = docs.select("doc_id", F.explode(language_scores(F.col("text"))).alias("s"))
    return scores.where("s.score > 0").select("doc_id", F.col("s.language").alias("language"), F.round("s.score", 2).alias("score"))


def detect_language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", language_of(F.col("text")).alias("l")).select("doc_id", "l.*")
