"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of ``BLOCK`` bytes. Equal
blocks get one integer name: they meet by hash, are told apart by their whole
bytes, and are numbered in sorted order inside their partition. Then adjacent
names are paired and the pairs named in the same way, until each document has
one name. Two documents have the same name, and as many blocks, only if their
texts are equal: names come from comparing the things named, never from a
fingerprint alone.

The bytes of a block are shuffled once, with equal blocks combined first; back
to the documents a name travels by the block's 64-bit hash. Where two different
blocks share a hash, which the naming step sees, those are joined by their bytes.
Everything is DataFrame functions.

Defined results: null counts as empty, and all empty texts are one group; of
equal texts the row with the most code points stays, then the smallest
``doc_id``, a null one last; of repeated rows of one id exactly one stays, though
all have its id as ``keep_id``; where only rows without an id are left to choose
from, one of them stays and ``keep_id`` is null; very long texts are many blocks,
each dealt by itself; an empty table gives no rows; other columns are neither
read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

BLOCK = 4096
HASH = "xxhash64({})"


def normal_text(text):
    """The text without ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """``distinct`` rows with a name: their place in the sorted partition, unique over all partitions.

    Written at once: a name must not be worked out a second time from rows that arrive in another order.
    """
    return cut_lineage(distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()))


def _blocks(norm: str, of: str = "{}") -> str:
    """SQL for the array of blocks, each put into ``of``."""
    pieces = f"greatest(cast(ceil(octet_length({norm}) / {BLOCK}) as int), 1)"
    block = of.format(f"substring({norm}, k * {BLOCK} + 1, {BLOCK})")
    return f"transform(sequence(0, {pieces} - 1), k -> {block})"


def block_names(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(row_id, n, i, name) for every block; ``texts`` (norm), ``facts`` (row_id, sha, hashes)."""
    blocks = texts.select(F.explode(F.expr(_blocks("norm"))).alias("block"))
    named = _numbered(blocks.select(F.expr(HASH.format("block")).alias("hash"), "block").distinct(), ["hash", "block"])
    by_hash = named.groupBy("hash").agg(F.min("name").alias("name"), F.max("name").alias("top"))
    by_hash = cut_lineage(by_hash.select("hash", F.when(F.col("name") == F.col("top"), F.col("name")).alias("name")))
    exploded = facts.select("row_id", "sha", F.size("hashes").alias("n"), F.posexplode("hashes").alias("i", "hash"))
    met = exploded.join(by_hash, "hash")
    clear = met.where("name is not null").select("row_id", "n", "i", "name")
    clash = by_hash.where("name is null").select("hash")
    if clash.isEmpty():
        return clear
    # different blocks under one hash: these alone are joined by their bytes
    whole = texts.select(F.sha2("norm", 256).alias("digest"), F.posexplode(F.expr(_blocks("norm"))).alias("i", "block"))
    whole = whole.withColumn("hash", F.expr(HASH.format("block"))).join(clash, "hash").join(named, ["hash", "block"])
    whole = whole.select(F.unhex("digest").alias("sha"), "i", F.col("name").alias("exact")).distinct()
    unclear = met.where("name is null").drop("name").join(whole, ["sha", "i"])
    return clear.unionByName(unclear.select("row_id", "n", "i", F.col("exact").alias("name")))


def document_names(names: DataFrame) -> DataFrame:
    """(row_id, n, name): one name for each document, from the names of its blocks."""
    done = None
    width = 1
    names = cut_lineage(names)
    while True:
        ready = names.where(f"n <= {width}").select("row_id", "n", "name")
        done = ready if done is None else done.unionByName(ready)
        names = names.where(f"n > {width}")
        if names.isEmpty():
            return done
        at = F.floor(F.col("i") / 2).cast("int").alias("i")
        pairs = names.groupBy("row_id", "n", at).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = cut_lineage(pairs)
        named = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        names = cut_lineage(pairs.join(named, ["left", "right"]).select("row_id", "n", "i", "name"))
        width *= 2


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the columns ``keep`` of the row."""
    own = [F.col(c).alias(f"own_{c}") for c in keep]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *own)
    own = [f"own_{c}" for c in keep]
    texts = rows.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).alias("size"),
        F.encode(normal_text(F.col("text")), "UTF-8").alias("norm"),
        *own,
    )
    # a row id of its own, written at once, keeps repeated rows of one document apart
    facts = cut_lineage(
        texts.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "size",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.expr(_blocks("norm", HASH)).alias("hashes"),
            *own,
        )
    )
    names = document_names(block_names(texts, facts))
    named = cut_lineage(facts.select("row_id", "doc_id", "size", "sha", *own).join(names, "row_id"))
    # a row with an id is above one without, as a null is below all numbers
    best = F.struct(F.col("size"), (-F.col("doc_id")).alias("neg"), (-F.col("row_id")).alias("row"))
    groups = cut_lineage(named.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.max(best).alias("best")))
    return named.join(groups, ["n", "name"]).select(
        "doc_id",
        (-F.col("best.neg")).alias("keep_id"),
        "group_size",
        (F.col("row_id") == -F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col(f"own_{c}").alias(c) for c in keep],
    )
