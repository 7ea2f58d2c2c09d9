"""Sharding of documents by balanced label propagation.

Documents are linked by equal texts. Rows of one text that lie close together in
the input are one node, the text is the neighbourhood they share: a link table of
(group, node), never of pairs. Every node starts in a shard of its own choice by
hash. In each round a join brings every node the votes of its group, which are
the numbers of its rows in each shard, and the node asks to move to the shard
with most votes (ties by hash). Moves are granted under quotas: between two
shards as many rows may go one way as the other way, and beyond that as many as
the target has room for linked rows, which while the rounds go on is a sixteenth
more than its quota; nodes that gain most go first. In every second round only
shards with room are asked, so that full ones are passed by. Rounds end when
nothing moves.

Unlinked documents are neutral: they fill what the linked ones leave. The law is
``rows``: of N rows each shard gets N div 16 or one more. The rows of a shard are
numbered, small groups first, each in one piece, then large ones, then unlinked
rows; the number is the slot. Rows beyond the quota, of which there are few but
for groups larger than a shard, go in their order to the places that are left.

Everything is DataFrame functions. A hot text is spread over its nodes, whose
number is bounded by that of the input's partitions and some thousand; votes and
demands are summed before they are shuffled; rows are joined by (text, node) and
numbered within (shard, node). Only tables of one row per shard or pair of shards
come to the driver. Each round is written to the shared folder.

Defined results: null text counts as empty, with size 1; all empty texts are one
group; repeated rows and null ids are rows like any other, each with a slot; very
long texts weigh as one row; an empty table gives no rows; other columns are
neither read nor returned; ``grown_shard`` is null under this law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranking import running_sum
from quire.session import cut_lineage

SHARDS = 16
ROUNDS = 8
SLACK = 16  # a quota may be exceeded by this part of it until the rounds are over
NODES = 1024  # nodes of a text, besides one per partition of the input
CLASSES = 32  # classes of gain
QUEUES = 64  # parts of a class that are granted one after the other


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _pick(values: list[int], at):
    """The value of a small list at an integer column."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (at + 1).cast("int"))


def nodes_of(facts: DataFrame, shards: int, quota: int) -> DataFrame:
    """(print, part, gid, members, n, shard): the nodes of texts met more than once; ``facts`` (row, print, part).

    A node starts in any shard; those of a group larger than a shard start in as many shards as the group needs.
    """
    nodes = cut_lineage(facts.groupBy("print", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")))
    groups = nodes.groupBy("print").agg(F.sum("n").alias("members"), F.min("first").alias("gid")).where("members > 1")
    met = nodes.join(groups, "print").select("print", "part", "gid", "members", "n")
    needed = F.when(F.col("members") > quota, F.least(F.ceil(F.col("members") / max(quota, 1)), F.lit(shards))).otherwise(shards)
    start = F.pmod(F.xxhash64("gid"), F.lit(shards)) + F.pmod(F.xxhash64("gid", "part"), needed)
    return met.withColumn("shard", F.pmod(start, F.lit(shards)).cast("int"))


def granted(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """Rows that may move from each shard to each: as many as come back, and a share of the target's room."""
    shards = range(len(room))
    may = [[min(asked[a][b], asked[b][a]) for b in shards] for a in shards]
    for b in shards:
        over = [asked[a][b] - may[a][b] for a in shards]
        left, total = max(room[b], 0), sum(over)
        for a in sorted(shards, key=lambda a: -over[a]):
            if over[a]:
                share = min(over[a], -(-left * over[a] // total))
                may[a][b] += share
                left, total = left - share, total - over[a]
    return may


def _asks(state: DataFrame, open_shards: list[int], shards: int, large: int) -> DataFrame:
    """``state`` with the shard each node asks for (null: none) and its place in the queue."""
    votes = state.groupBy("gid", "shard").agg(F.sum("n").alias("c"))
    vote = F.struct("c", F.xxhash64("gid", "shard").alias("h"), "shard")
    usable = F.col("shard").isin(open_shards)
    votes = votes.groupBy("gid").agg(
        F.max(F.when(usable, vote)).alias("best"), F.collect_list(vote).alias("votes")
    )
    met = state.join(votes, "gid").withColumn("own", F.expr("filter(votes, v -> v.shard = shard)[0]"))
    moves = F.col("best").isNotNull() & (F.col("best") > F.col("own"))
    gain = F.col("best.c") - F.col("own.c") + F.col("n")
    rank = F.lit(CLASSES - 1) - F.least(F.floor(F.log2(gain.cast("double"))), F.lit(CLASSES - 1))
    # a group far smaller than a shard moves together, the nodes of a larger one queue by themselves
    spread = F.when(F.col("members") > large, F.xxhash64("gid", "part")).otherwise(F.xxhash64("gid"))
    queue = rank * QUEUES + F.pmod(spread, F.lit(QUEUES))
    return met.select(
        *state.columns, F.when(moves, F.col("best.shard")).alias("to"), F.when(moves, queue).cast("long").alias("queue")
    )


def propagate(state: DataFrame, rows: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``state`` (print, part, gid, members, n, shard) with the shards that label propagation ends in; ``rows`` are the quotas."""
    shards = len(rows)
    state = cut_lineage(state)
    still = 0
    for turn in range(rounds):
        held = [0] * shards
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per shard
            held[r["shard"]] = r["n"]
        if not sum(held):
            return state
        room = [q + q // SLACK + 1 - h for q, h in zip(rows, held, strict=True)]
        with_room = [s for s in range(shards) if room[s] > rows[s] // SLACK] if turn % 2 else []
        asks = cut_lineage(_asks(state, with_room or list(range(shards)), shards, min(rows) // 8))
        demand = asks.where("to is not null").groupBy("shard", "to", "queue").agg(F.sum("n").alias("n"))
        demand = cut_lineage(demand)  # at most shards * shards * CLASSES * QUEUES rows
        asked = [[0] * shards for _ in range(shards)]
        for r in demand.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            asked[r["shard"]][r["to"]] = r["n"]
        may = granted(asked, room)
        flat = [x for line in may for x in line]
        served = Window.partitionBy("shard", "to").orderBy("queue").rowsBetween(Window.unboundedPreceding, 0)
        taken = demand.withColumn("sum", F.sum("n").over(served))
        taken = cut_lineage(taken.where(F.col("sum") <= _pick(flat, F.col("shard") * shards + F.col("to"))))
        if taken.isEmpty():
            still += 1
            if still == 2:
                break
            continue
        still = 0
        taken = taken.select("shard", "to", "queue", F.lit(True).alias("go"))
        moved = asks.join(taken, ["shard", "to", "queue"], "left")
        moved = moved.withColumn("shard", F.when(F.col("go"), F.col("to")).otherwise(F.col("shard")))
        state = cut_lineage(moved.select(*state.columns))
    return state


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, members (rows of its text)."""
    whole = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    facts = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("bytes")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length("bytes") + 1).cast("long").alias("size"),
        F.crc32("bytes").alias("text_crc32"),
        F.unhex(F.sha2("bytes", 256)).alias("print"),
    )
    # written at once: a row must keep its number
    facts = cut_lineage(facts)
    total = facts.count()
    rows = quotas(total, shards)
    step = max((total // NODES).bit_length() - 1, 0)
    facts = facts.withColumn("part", F.shiftright("row", step))
    state = propagate(nodes_of(facts, shards, min(rows)), rows, rounds)

    placed = facts.join(state.select("print", "part", "gid", "members", "shard"), ["print", "part"], "left")
    alone = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    # small groups stand side by side, so that a quota cuts few of them; larger ones stand by their nodes
    small = F.col("members") <= NODES
    stretch = total // (shards * NODES) + 1
    top = (facts.agg(F.max("part")).first()[0] or 0) + 1
    far = F.when(F.col("members").isNull(), F.lit(top)).otherwise(0) + F.col("part") + stretch
    placed = placed.select(
        "row", "doc_id", "size", "text_crc32", F.coalesce("members", F.lit(1)).alias("members"),
        F.coalesce("shard", alone).alias("shard"), F.coalesce("gid", F.lit(0)).alias("gid"),
        F.when(small, F.pmod(F.xxhash64("gid"), F.lit(stretch))).otherwise(far).alias("run"),
    )
    placed = cut_lineage(placed)
    runs = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    runs = running_sum(cut_lineage(runs), ["shard"], "run", F.col("n"), "before").select("shard", "run", "before")
    inside = Window.partitionBy("shard", "run").orderBy("gid", "row")
    placed = placed.withColumn("inside", F.row_number().over(inside) - 1).join(cut_lineage(runs), ["shard", "run"])
    at = F.col("before") + F.col("inside")

    held = [0] * shards
    for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect():  # one row per shard
        held[r["shard"]] = r["n"]
    over = [max(h - q, 0) for h, q in zip(held, rows, strict=True)]
    room = [max(q - h, 0) for h, q in zip(held, rows, strict=True)]
    over_before = [sum(over[:s]) for s in range(shards)]
    room_before = [sum(room[:s]) for s in range(shards)]
    # rows beyond a quota, numbered over all shards, and the shard whose room has that number
    extra = F.when(at >= _pick(rows, F.col("shard")), _pick(over_before, F.col("shard")) + at - _pick(rows, F.col("shard")))
    placed = placed.withColumn("at", at).withColumn("extra", extra)
    other = F.lit(None).cast("int")
    for s in range(shards):
        if room[s]:
            other = F.when(F.col("extra") >= room_before[s], F.lit(s)).otherwise(other)
    placed = placed.withColumn("other", other)
    stays = F.col("extra").isNull()
    slot = F.when(stays, F.col("at")).otherwise(
        _pick(held, F.col("other")) + F.col("extra") - _pick(room_before, F.col("other"))
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(F.col("other")).alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "members",
    )
