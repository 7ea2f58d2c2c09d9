"""Edit history, annotations, expiry and recent turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.folds import fold_sorted
from quire.functions.ranking import last_rows, row_chunks

# --- annotations -------------------------------------------------------------


def annotations_latest(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The last saved list of each wanted (doc_id, page), ``[]`` where none was saved.

    ``log(doc_id, page, saved_at, seq, items)``; the aggregation keeps one row per
    page on every map task, whatever the number of saves.
    """
    latest = log.groupBy("doc_id", "page").agg(F.max_by("items", F.struct("saved_at", "seq")).alias("items"))
    return wanted.join(latest, ["doc_id", "page"], "left").withColumn("items", F.coalesce("items", F.lit("[]")))


def highlight_items(requests: DataFrame) -> DataFrame:
    """One row per rectangle of ``requests(request_id, doc_id, page, rects, color, opacity)``."""
    default = F.array(*[F.lit(v) for v in fv.HIGHLIGHT_COLOR])
    color = F.when(F.size("color") > 0, F.col("color")).otherwise(default)
    opacity = F.when(F.col("opacity") != 0, F.col("opacity")).otherwise(fv.HIGHLIGHT_OPACITY)
    return requests.select(
        "request_id", "doc_id", "page", F.posexplode("rects").alias("idx", "rect"), color.alias("color"), opacity.alias("opacity")
    )


def ink_items(requests: DataFrame) -> DataFrame:
    """One row per path with at least two points of ``requests(request_id, doc_id, page, paths)``.

    A path is a struct of points, color and width.
    """
    default = F.array(*[F.lit(v) for v in fv.INK_COLOR])
    return (
        requests.select("request_id", "doc_id", "page", F.posexplode("paths").alias("idx", "path"))
        .where(F.size("path.points") >= 2)
        .select(
            "request_id",
            "doc_id",
            "page",
            "idx",
            F.col("path.points").alias("points"),
            F.coalesce("path.color", default).alias("color"),
            F.coalesce("path.width", F.lit(fv.INK_WIDTH)).alias("width"),
        )
    )


def annotation_items(highlights: DataFrame, inks: DataFrame) -> DataFrame:
    """Highlight rectangles and ink paths as one table."""
    h = highlight_items(highlights).withColumn("kind", F.lit("highlight"))
    i = ink_items(inks).withColumn("kind", F.lit("ink"))
    return h.unionByName(i, allowMissingColumns=True)


# --- versions ----------------------------------------------------------------


def history_retention(log: DataFrame, n: int = fv.HISTORY_DEPTH) -> DataFrame:
    """The last ``n`` versions of each document in ``log(doc_id, seq, ...)``."""
    return last_rows(log, ["doc_id"], [F.desc("seq")], n)


def history_versions(log: DataFrame, n: int = fv.HISTORY_DEPTH) -> DataFrame:
    """Kept versions with their index, oldest first; the newest is current."""
    kept = history_retention(log, n)
    newest = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    oldest = Window.partitionBy("doc_id").orderBy("seq")
    return kept.withColumn("index", F.row_number().over(oldest) - 1).withColumn(
        "is_current", F.row_number().over(newest) == 1
    )


# An undo history is a stack of versions with a mark: `size` versions are held
# and `done` of them are in effect (a marker entry exists while done < size).
# An edit drops the versions beyond the mark, adds one and keeps the last
# `depth`; undo and redo move the mark. So (size, done) decides every outcome.


class _Stack:
    """One document's history while it is walked; ``refs`` are the versions, oldest first."""

    __slots__ = ("refs", "done", "depth")

    def __init__(self, refs, done, depth):
        self.refs, self.done, self.depth = list(refs), done, depth

    def apply(self, action, ref):
        """(accepted, version undone or restored; MARKER for the marker); ``ref`` is the version an edit makes."""
        if action == "edit":
            del self.refs[self.done :]
            self.refs.append(ref)
            del self.refs[: max(0, len(self.refs) - self.depth)]
            self.done = len(self.refs)
            return True, None
        if action == "undo":
            if self.done == 0:
                return False, None
            self.done -= 1
            return True, self.refs[self.done]
        if self.done == len(self.refs):
            return False, None
        self.done += 1
        return True, self.refs[self.done] if self.done < len(self.refs) else MARKER

    @property
    def entries(self):
        return len(self.refs) + (1 if self.done < len(self.refs) else 0)

    def columns(self):
        """done, sequence numbers and operations of the versions, as columns hold them."""
        return self.done, [seq for seq, _ in self.refs], [name for _, name in self.refs]


MARKER = (None, fv.UNDO_MARKER)
STACK = "done int, seqs array<long>, names array<string>"


class _Effect:
    """What a run of events does to a history whose start is not known.

    Until the first edit only the mark moves: done becomes max(min(low, size), min(done + shift, size - short)),
    where the three numbers follow from the undos and redos so far. What an edit leaves of the start is its versions
    below the mark, so from then on there are no more than depth + 1 cases, one for each number of versions left. Cases
    that have become equal are walked as one. Version i of the start is the reference -(i + 1).
    """

    def __init__(self, depth, first):
        self.depth, self.first, self.events = depth, first, 0
        self.shift = self.short = self.low = 0
        self.stacks, self.of = [], []

    def apply(self, action, ref):
        if action == "edit":
            if not self.stacks:
                self.stacks = [_Stack([-(i + 1) for i in range(p)], p, self.depth) for p in range(self.depth + 1)]
                self.of = list(range(self.depth + 1))
        elif not self.stacks:
            if action == "undo":
                self.shift, self.short, self.low = self.shift - 1, self.short + 1, max(self.low - 1, 0)
            else:
                self.shift, self.short, self.low = self.shift + 1, max(self.short - 1, 0), self.low + 1
            return
        for stack in self.stacks:
            stack.apply(action, ref)
        self.events += 1
        if len(self.stacks) > 1 and self.events % 16 == 0:
            self.merge()

    def merge(self):
        """Keep one of the stacks that are equal."""
        kept, place, at = [], {}, []
        for stack in self.stacks:
            same = (stack.done, tuple(stack.refs))
            if same not in place:
                place[same] = len(kept)
                kept.append(stack)
            at.append(place[same])
        self.stacks, self.of = kept, [at[k] for k in self.of]

    def columns(self):
        """shift, short, low; the case of each number of versions left; the edits left on top; the cases."""
        self.merge()
        edits: dict[tuple, int] = {}
        cases = []
        for stack in self.stacks:
            kept = [ref for ref in stack.refs if isinstance(ref, int)]
            top = [edits.setdefault(ref, len(edits)) for ref in stack.refs[len(kept) :]]
            cases.append({"done": stack.done, "first": -kept[0] - 1 if kept else 0, "kept": len(kept), "top": top})
        named = [{"seq": seq, "name": name} for seq, name in edits]
        return self.shift, self.short, self.low, self.of, named, cases


EFFECT = (
    "doc_id long, chunk_no long, first_seq long, shift int, short int, low int, of array<int>, "
    "edits array<struct<seq: bigint, name: string>>, "
    "cases array<struct<done: int, first: int, kept: int, top: array<int>>>"
)


def _after(effect, stack):
    """The stack that a chunk's effect makes of ``stack``."""
    shift, short, low, of, edits, cases = effect
    size = len(stack.refs)
    left = max(min(low, size), min(stack.done + shift, size - short))
    if not cases:
        return _Stack(stack.refs, left, stack.depth)
    case = cases[of[left]]
    kept = stack.refs[case["first"] : case["first"] + case["kept"]]
    return _Stack(kept + [(edits[k]["seq"], edits[k]["name"]) for k in case["top"]], case["done"], stack.depth)


def replayed(log: DataFrame, depth: int = fv.HISTORY_DEPTH, chunk: int = 1_000_000, start: DataFrame | None = None) -> DataFrame:
    """The outcome of every event of ``log(doc_id, seq, action, operation)``, and the stack each chunk ends with.

    ``start`` (doc_id, done, seqs, names) has the stacks to begin with; a document
    without one begins empty. Rows without ``seq`` are ends; a document's last
    ``chunk_no`` has its final stack.
    """
    cut = row_chunks(log.select("doc_id", "seq", "action", "operation"), ["doc_id"], "seq", chunk, "chunk_no")
    firsts = log.groupBy("doc_id").agg(F.count("*").alias("events"), F.min("seq").alias("seq"))
    several = firsts.where(F.col("events") > chunk).select("doc_id")
    effects = fold_sorted(
        cut.join(several, "doc_id", "left_semi"),
        ["doc_id", "chunk_no"],
        ["seq"],
        lambda row: _Effect(depth, row[1]),
        lambda state, row: state.apply(row[2], (row[1], row[3])),
        EFFECT,
        lambda key, e: (*key, e.first, *e.columns()),
    )
    if start is None:
        none = (f"cast(null as {kind}) AS {name}" for name, kind in (x.split() for x in STACK.split(", ")))
        effects = effects.selectExpr("*", *none)
    else:
        start = start.select("doc_id", "done", "seqs", "names")
        effects = effects.join(start, "doc_id", "left")

    def stack_of(done, seqs, names):
        return _Stack([] if seqs is None else zip(seqs, names, strict=True), done or 0, depth)

    def start_of(state, row):
        """The stack before a chunk, which rides on its first event."""
        before = (row[0], row[2], *state[0].columns())
        state[0] = _after(row[3:9], state[0])
        return before

    starts = fold_sorted(
        effects,
        ["doc_id"],
        ["chunk_no"],
        lambda row: [stack_of(*row[9:12])],
        start_of,
        f"doc_id long, seq long, {STACK}",
    )
    if start is not None:
        once = firsts.select("doc_id", "seq").join(start, "doc_id").join(several, "doc_id", "left_anti")
        starts = starts.unionByName(once)

    def step(stack, row):
        doc, seq, action, name = row[:4]
        ok, target = stack.apply(action, (seq, name))
        now, held = stack.done, len(stack.refs)
        return (
            doc, row[4], seq, action, "ok" if ok else "error", stack.entries, now - 1, now > 0, now < held,
            None if target is None else target[1], None, None, None,
        )

    rides = cut.join(starts, ["doc_id", "seq"], "left")
    return fold_sorted(
        rides.select("doc_id", "seq", "action", "operation", "chunk_no", "done", "seqs", "names"),
        ["doc_id", "chunk_no"],
        ["seq"],
        lambda row: stack_of(*row[5:8]),
        step,
        "doc_id long, chunk_no long, seq long, action string, status string, versions int, current int, can_undo boolean, "
        f"can_redo boolean, target_operation string, {STACK}",
        lambda key, stack: (*key, *[None] * 8, *stack.columns()),
    )


def history_replay(log: DataFrame, depth: int = fv.HISTORY_DEPTH, chunk: int = 1_000_000) -> DataFrame:
    """Outcome of every edit, undo and redo of ``log(doc_id, seq, action, operation)``.

    ``seq`` orders a document's events and is unique in it. A document's log may
    be of any size: one of more than ``chunk`` events is cut into chunks of about
    that many, which run in parallel. For these documents a first pass works out
    what each chunk does to any start state, and a scan of those few summaries
    gives each chunk its true start; the last pass replays all chunks from there.
    All other documents are walked once.
    """
    return replayed(log, depth, chunk).where("seq is not null").drop("chunk_no", "done", "seqs", "names")


# --- expiry and turns ----------------------------------------------------------


def expired(docs: DataFrame, now: str, ttl_h: int = fv.DOCUMENT_TTL_HOURS) -> DataFrame:
    """Documents of ``docs(doc_id, mtime)`` last changed more than ``ttl_h`` hours before ``now``."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(ttl_h))
    return docs.where(F.col("mtime") < cutoff)


def expire_documents(docs: DataFrame, now: str, ttl_h: int = fv.DOCUMENT_TTL_HOURS) -> DataFrame:
    """The documents that stay; drop ``expired(...)`` from other tables with delete_documents."""
    return docs.join(expired(docs, now, ttl_h).select("doc_id"), "doc_id", "left_anti")


def recent_turns(messages: DataFrame, n: int = fv.CONVERSATION_WINDOW) -> DataFrame:
    """The last ``n`` entries per conversation, and of those the user's and assistant's."""
    return last_rows(messages, ["conv_id"], [F.desc("turn")], n).where(F.col("role").isin("user", "assistant"))
