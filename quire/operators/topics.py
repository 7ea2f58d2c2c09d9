"""Key topics and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.text import all_matches, let, strip


def topic_counts(text: Column, stop=None) -> Column:
    """Topic words of one text with count and first position, most frequent first.

    Works inside the row: the words are sorted with their positions, equal
    neighbours make a run, and a run's length and first position are the count
    and the tie-breaker. Exploding the words and grouping them by document would
    shuffle nearly every word of the corpus.
    """
    stop = fv.STOP_WORDS if stop is None else tuple(stop)
    found = all_matches(F.lower(text), fv.TOPIC_WORD)
    kept = F.filter(found, lambda w: ~w.isin(*stop)) if stop else found
    ordered = F.sort_array(F.transform(kept, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))

    def runs(s: Column) -> Column:
        starts = F.array_compact(
            F.transform(s, lambda x, i: F.when((i == 0) | (x["word"] != F.get(s, i - 1)["word"]), i))
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, k: F.struct(
                    (at - F.coalesce(F.get(b, k + 1), F.size(s))).alias("minus"),
                    F.get(s, at)["pos"].alias("first_pos"),
                    F.get(s, at)["word"].alias("word"),
                ),
            ),
        )

    return F.sort_array(let(ordered, runs))


def key_topics(docs: DataFrame, k: int = fv.TOPIC_COUNT, stop=None) -> DataFrame:
    """The ``k`` most frequent words per document; ties go to the earlier word."""
    best = F.slice(topic_counts(F.col("text"), stop), 1, k)
    return docs.select("doc_id", F.posexplode(best).alias("i", "t")).select(
        "doc_id", "t.word", (-F.col("t.minus")).alias("count"), (F.col("i") + 1).alias("rank")
    )


def top_topic_of(text: Column, stop=None, words: Column | None = None) -> Column:
    """The most frequent topic word of one text; of several, the one that comes first.

    Only counts are compared, so plain words are sorted, and the longest runs are
    looked up in the text's order. ``words`` are the text's ``language_words``,
    where they are at hand: the longer ones are its topic words.
    """
    stop = fv.STOP_WORDS if stop is None else tuple(stop)
    found = all_matches(F.lower(text), fv.TOPIC_WORD) if words is None else words

    def is_topic(w: Column) -> Column:
        long_enough = F.length(w) >= fv.TOPIC_MIN_CHARS
        return long_enough & ~w.isin(*stop) if stop else long_enough

    def most(kept: Column, s: Column) -> Column:
        # where words change: the start of each run and the end of the last
        bounds = F.filter(
            F.sequence(F.lit(0), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1))
        )

        def first(b: Column) -> Column:
            sizes = F.transform(b, lambda at, k: F.get(b, k + 1) - at)
            longest = let(
                F.array_max(sizes), lambda n: F.filter(b, lambda at, k: F.get(b, k + 1) - at == n)
            )
            best = F.transform(longest, lambda at: F.get(s, at))
            return let(best, lambda t: F.get(F.when(F.size(t) > 1, F.array_intersect(kept, t)).otherwise(t), F.lit(0)))

        return let(bounds, first)

    return let(F.filter(found, is_topic), lambda kept: let(F.sort_array(kept), lambda s: most(kept, s)))


def top_topic(docs: DataFrame, stop=None) -> DataFrame:
    """The single most frequent word per document."""
    return docs.select("doc_id", top_topic_of(F.col("text"), stop).alias("top_topic")).where("top_topic IS NOT NULL")


def _sentences(text: Column, splitter: str, longer_than: int) -> Column:
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    parts = F.transform(F.split(flat, splitter, -1), strip)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def _quoted(sentences: Column) -> Column:
    return F.concat(F.array_join(sentences, ". "), F.lit("."))


def summary(text: Column, variant: str = "analysis") -> Column:
    """Extractive summary of a document text.

    ``analysis`` splits on . ! ? and keeps up to five spread sentences;
    ``brief`` splits on full stops and keeps up to four; ``assist`` keeps the
    first, middle and last, or the text itself when it is short.
    """
    if variant == "analysis":
        s, keep, empty = _sentences(text, "[.!?]+", 20), 5, "No extractable text."
        marks = ((0, 1), (1, 4), (1, 2), (3, 4))
    elif variant == "brief":
        s, keep, empty = _sentences(text, "[.]", 10), 3, "No text found."
        marks = ((0, 1), (1, 3), (2, 3))
    elif variant == "assist":
        s, keep, empty = _sentences(text, "[.]", 0), 3, None
        marks = ((0, 1), (1, 2))
    else:
        raise ValueError(f"unknown summary variant: {variant}")

    def choose(s: Column) -> Column:
        n = F.size(s)
        spread = [F.get(s, F.floor(n * num / den).cast("int")) for num, den in marks]
        picked = _quoted(F.array(*spread, F.try_element_at(s, F.lit(-1))))
        if empty is None:
            return F.when(n <= keep, text).otherwise(picked)
        return F.when(n == 0, empty).when(n <= keep, _quoted(s)).otherwise(picked)

    return let(s, choose)

