"""History, rates, annotations, expiry, turns, intents and the streaming jobs."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.ranking import running_sum
from quire.operators import history, intent, rates
from quire.sources.store import Store
from quire.streaming import jobs

LOG = "doc_id long, seq long, action string, operation string"


def replayed_by_hand(actions, depth=20):
    """The undo history kept as versions, marker and cursor, step by step."""
    versions, cur, out = [], -1, []
    for seq, action in actions:
        status, target = "ok", None
        if action == "edit":
            versions = versions[: cur + 1] + [f"op{seq}"]
            versions = versions[-depth:]
            cur = len(versions) - 1
        elif action == "undo":
            if cur < 0 or not versions:
                status = "error"
            else:
                target = versions[cur]
                if cur == len(versions) - 1:
                    versions = versions + [fv.UNDO_MARKER]
                cur -= 1
        else:
            if cur + 2 >= len(versions):
                status = "error"
            else:
                target = versions[cur + 2]
                cur += 1
                if cur + 1 == len(versions) - 1 and versions[-1] == fv.UNDO_MARKER:
                    versions = versions[:-1]
                    cur = len(versions) - 1
        out.append((seq, action, status, len(versions), cur, cur >= 0, cur < len(versions) - 1, target))
    return out


def random_log(rnd, n, weights):
    return [(i * 3, rnd.choices(["edit", "undo", "redo"], weights)[0]) for i in range(n)]


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_history_replay(table, chunk):
    rnd = random.Random(3)
    logs = {d: random_log(rnd, 150, w) for d, w in enumerate([(1, 1, 1), (5, 1, 1), (2, 3, 3), (1, 0, 0), (0, 1, 1)])}
    logs[9] = [(i, "edit") for i in range(22)] + [(22 + i, "undo") for i in range(23)] + [(45, "redo"), (46, "edit"), (47, "redo")]
    df = table(LOG, *[(d, s, a, f"op{s}") for d, log in logs.items() for s, a in log])
    got = {}
    for r in history.history_replay(df, chunk=chunk).collect():
        got.setdefault(r.doc_id, []).append(
            (r.seq, r.action, r.status, r.versions, r.current, r.can_undo, r.can_redo, r.target_operation)
        )
    for d, log in logs.items():
        assert sorted(got[d]) == replayed_by_hand(log), d
        assert all(-1 <= x[4] < max(x[3], 1) for x in got[d])


def test_retention_and_versions(table):
    df = table(LOG, *[(1, i, "edit", f"op{i}") for i in range(22)], (2, 5, "edit", "x"))
    got = rows(history.history_versions(df).select("doc_id", "seq", "index", "is_current"), "doc_id", "index")
    assert got[0] == (1, 2, 0, False) and got[19] == (1, 21, 19, True) and got[20] == (2, 5, 0, True)


def admitted_by_hand(stamps, window_us, limit):
    live, out = [], []
    for us, rid in sorted(stamps):
        live = [t for t in live if t >= us - window_us]
        ok = len(live) < limit
        if ok:
            live.append(us)
        out.append((rid, ok))
    return sorted(out)


T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("part_rows", [10_000, 60])
@pytest.mark.parametrize("mean_gap", [0.5, 3.0])
def test_rate_limit(table, part_rows, mean_gap):
    rnd = random.Random(11)
    t, reqs = 0.0, []
    for i in range(600):
        if rnd.random() < 0.8:  # one in five shares its time with the one before
            t += rnd.expovariate(1 / mean_gap)
        reqs.append((i, T0 + timedelta(microseconds=int(t * 1e6))))
    df = table("request_id long, ts timestamp", *reqs)
    got = sorted((r.request_id, r.admitted) for r in rates.rate_limit(df, 60, 30, part_rows=part_rows).collect())
    us = lambda ts: int((ts - T0).total_seconds() * 1e6)
    assert got == admitted_by_hand([(us(ts), i) for i, ts in reqs], 60_000_000, 30)


def test_rate_limit_hot_key_among_others(table):
    rnd = random.Random(2)
    reqs = [(i, T0 + timedelta(seconds=i * 0.7), 0 if rnd.random() < 0.6 else i % 9) for i in range(700)]
    df = table("request_id long, ts timestamp, user_id long", *reqs)
    got = sorted((r.request_id, r.admitted) for r in rates.rate_limit(df, 60, 5, "user_id", part_rows=100).collect())
    want = []
    for user in range(9):
        mine = [(int((ts - T0).total_seconds() * 1e6), i) for i, ts, u in reqs if u == user]
        want += admitted_by_hand(mine, 60_000_000, 5)
    assert got == sorted(want)


def test_rate_limit_edges(table):
    # 31 in a minute: the last is rejected; exactly 60 s after the first it is still counted
    reqs = [(i, T0 + timedelta(seconds=i)) for i in range(31)]
    reqs += [(40, T0 + timedelta(seconds=60)), (41, T0 + timedelta(seconds=60, microseconds=1))]
    df = table("request_id long, ts timestamp", *reqs)
    got = {r.request_id: r.admitted for r in rates.rate_limit(df).collect()}
    assert not got[30] and not got[40] and got[41] and all(got[i] for i in range(30))
    load = {r.request_id: r.load for r in rates.request_rate(df).collect()}
    assert load[0] == 1 and load[30] == 31 and load[40] == 32


def test_many_requests_at_one_time(table):
    df = table("request_id long, ts timestamp", *[(i, T0) for i in range(50)])
    assert sorted(r.request_id for r in rates.rate_limit(df, 60, 30).where("admitted").collect()) == list(range(30))


def test_running_sum_in_chunks(table):
    df = table("k long, i long, v long", *[(k, i, i % 5) for k in (1, 2) for i in range(0, 60, 2)])
    got = {(r.k, r.i): r.s for r in running_sum(df, ["k"], "i", F.col("v"), "s", chunk=7).collect()}
    for k in (1, 2):
        total = 0
        for i in range(0, 60, 2):
            assert got[(k, i)] == total
            total += i % 5


def test_annotations(table):
    log = table(
        "doc_id long, page int, saved_at long, seq long, items string",
        (1, 0, 5, 1, '[{"type":"rect"}]'), (1, 0, 6, 2, '[{"type":"circle"}]'), (1, 0, 6, 1, "[]"),
    )
    wanted = table("doc_id long, page int", (1, 0), (1, 99))
    got = rows(history.annotations_latest(log, wanted).select("page", "items"), "page")
    assert got == [(0, '[{"type":"circle"}]'), (99, "[]")]


def test_annotation_items(table):
    h = table(
        "request_id long, doc_id long, page int, rects array<array<double>>, color array<double>, opacity double",
        (1, 1, 0, [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]], [], 0.0), (2, 1, 0, [[0.0, 0.0, 1.0, 1.0]], [0.0, 0.0, 1.0], 0.8),
    )
    i = table(
        "request_id long, doc_id long, page int, paths array<struct<points:array<array<double>>,color:array<double>,width:double>>",
        (3, 1, 0, [([[0.0, 0.0]], None, None), ([[0.0, 0.0], [1.0, 1.0]], None, None)]),
    )
    got = {(r.request_id, r.idx): r for r in history.annotation_items(h, i).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (3, 1)]
    assert got[(1, 0)].color == [1.0, 0.92, 0.23] and got[(1, 0)].opacity == 0.35 and got[(2, 0)].opacity == 0.8
    assert got[(3, 1)].width == 2.0 and got[(3, 1)].color == [0.0, 0.0, 0.0]


def test_expiry_and_turns(table):
    docs = table("doc_id long, mtime timestamp", (1, T0), (2, T0 + timedelta(hours=1)), (3, T0 + timedelta(hours=2)))
    assert [r.doc_id for r in history.expire_documents(docs, "2024-01-02 01:00:00").orderBy("doc_id").collect()] == [2, 3]
    m = table("conv_id long, turn long, role string", *[(1, i, "system" if i == 20 else "user") for i in range(25)])
    assert [r.turn for r in history.recent_turns(m).orderBy("turn").collect()] == [t for t in range(5, 25) if t != 20]


COMMANDS = [
    ('replace "Hello" with "Goodbye"', "replace", {"find": "Hello", "repl": "Goodbye", "scope": None}),
    ("how many pages does this document have?", "query_pages", {}),
    ("xyzzy plugh", "unknown", {}),
    ("word count", "word_count", {}),
    ("How many times does 'Foo' appear?", "query_count", {"term": "foo"}),
    ("count widgets", "query_count", {"term": "widgets"}),
    ("change the name Ann to Bob", "replace", {"find": "Ann", "repl": "Bob"}),
    ("swap a into b everywhere", "replace", {"find": "a", "repl": "b"}),
    ("remove all instances of \"x y\" from the text", "delete_text", {"find": "x y"}),
    ("delete page 3", "delete_pages", {"start": 2, "end": 2}),
    ("remove pages 2 to 4", "delete_pages", {"start": 1, "end": 3}),
    ("rotate page 2", "rotate_page", {"page": 1}),
    ("please rotate it", "rotate_page", {"page": 7}),
    ("this one: rotate", "rotate_page", {"page": 7}),
    ("pull all the emails", "extract", {"kind": "emails"}),
    ("list phone numbers", "extract", {"kind": "phones"}),
    ("get dates", "extract", {"kind": "dates"}),
    ("redact the social security numbers", "redact", {"kind": "ssn"}),
    ("redact all phone numbers", "redact", {"kind": "phone"}),
    ("add 'DRAFT' on page 1", "add_text", {"new_text": "DRAFT", "page": 0}),
    ("tl;dr", "summarize", {}),
    ("how many words", "word_count", {}),
]
LOOSE = [
    ("send me the link", "extract", {"kind": "urls"}, "unknown", {}),
    ("delete confidential", "delete_text", {"find": "c"}, "delete_text", {"find": "confidential"}),
    ("replace a with b on page 2", "replace", {"repl": "b on page 2", "scope": 1}, "replace", {"repl": "b", "scope": 1}),
]


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_intents(table, mode):
    cases = list(COMMANDS) + [(c[0], *(c[1:3] if mode == "reference" else c[3:5])) for c in LOOSE]
    df = table("i long, text string, current_page int", *[(i, c[0], 7) for i, c in enumerate(cases)])
    got = {r.i: r for r in intent.intents(df, mode).collect()}
    for i, (message, action, args) in enumerate(cases):
        assert got[i].action == action, message
        for name, value in args.items():
            assert got[i][name] == value, (message, name)


def test_intent_region(table):
    c = table(
        "i long, action string, find string, kind string",
        (1, "unknown", None, None), (2, "replace", "", None), (3, "redact", None, ""), (4, "delete_text", "x", None), (5, "unknown", None, None),
    )
    r = table("i long, region_text string", (1, "T"), (2, "T"), (3, "T"), (4, "T"), (5, ""))
    got = {x.i: (x.action, x.find, x.answer) for x in intent.intent_region_context(c, r, ["i"]).collect()}
    assert got == {
        1: ("query_region", None, "T"), 2: ("replace", "T", None), 3: ("delete_text", "T", None),
        4: ("delete_text", "x", None), 5: ("unknown", None, None),
    }


# --- streams over several micro-batches ------------------------------------------


def feed(df, folder, parts, order):
    """``df`` as ``parts`` files in event order."""
    cut = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(order)))
    for p in range(1, parts + 1):
        cut.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, tmp_path, df, parts, order, start):
    """Run ``start(stream, path, checkpoint)`` over ``df`` in ``parts`` micro-batches; the path of its output."""
    feed(df, str(tmp_path / "in"), parts, order)
    stream = jobs.read_folder(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    path = str(tmp_path / "out")
    start(stream, path, str(tmp_path / "check")).awaitTermination()
    return path


@pytest.mark.parametrize("key", ["user_id", None])
def test_stream_rate_limit_equals_batch(spark, table, tmp_path, key):
    rnd = random.Random(4)
    reqs = [(i, T0 + timedelta(seconds=i * 2 + rnd.random()), i % 2) for i in range(200)]
    df = table("request_id long, ts timestamp, user_id long", *reqs)
    path = streamed(spark, tmp_path, df, 4, "ts", lambda s, out, check: jobs.stream_rate_limit(s, out, check, 60, 10, key, part_rows=7))
    assert jobs.too_late(spark, path).count() == 0
    want = rates.rate_limit(df, 60, 10, key)
    assert sorted(rows(jobs.decided(spark, path))) == sorted(rows(want))


def test_stream_rate_limit_out_of_order(spark, table, tmp_path):
    """Every request is decided as the batch operator decides the ones in time, or comes out late; null times are not lost."""
    rnd = random.Random(5)
    reqs = [(i, T0 + timedelta(seconds=i * 3 if i % 9 else i * 3 - 200), i % 3) for i in range(240)]
    df = table("request_id long, ts timestamp, user_id long", *reqs, (999, None, 1), (998, T0, None))
    df = df.withColumn("arrival", F.when(F.col("request_id") < 900, F.col("request_id")).otherwise(F.lit(rnd.randrange(200))))
    start = lambda s, out, check: jobs.stream_rate_limit(s, out, check, 60, 5, "user_id", late_s=90)
    path = streamed(spark, tmp_path, df, 6, "arrival", start)
    got, late = jobs.decided(spark, path), jobs.too_late(spark, path)
    assert got.count() + late.count() == 242 and late.count() > 5
    in_time = df.join(late.select("request_id"), "request_id", "left_anti")
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(rates.rate_limit(in_time, 60, 5, "user_id"))))


def test_a_batch_that_runs_again_gives_the_same_rows(spark, table, tmp_path):
    reqs = [(i, T0 + timedelta(seconds=i), 0) for i in range(90)]
    df = table("request_id long, ts timestamp, user_id long", *reqs)
    path = streamed(spark, tmp_path, df, 3, "ts", lambda s, out, check: jobs.stream_rate_limit(s, out, check, 20, 5))
    before = sorted(rows(jobs.decided(spark, path)))
    # as if the last batch had died before its commit
    commits = tmp_path / "check" / "commits"
    (commits / "2").unlink()
    (commits / ".2.crc").unlink(missing_ok=True)
    stream = jobs.read_folder(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    jobs.stream_rate_limit(stream, path, str(tmp_path / "check"), 20, 5).awaitTermination()
    assert sorted(rows(jobs.decided(spark, path))) == before and len(before) == 90


def test_stream_history_gives_out_what_comes_too_late(spark, table, tmp_path):
    log = [(1, "edit"), (3, "undo"), (2, "edit"), (4, "redo")]
    df = table(LOG + ", ts timestamp", *[(7, s, a, f"op{s}", T0 + timedelta(minutes=i)) for i, (s, a) in enumerate(log)])
    path = streamed(spark, tmp_path, df, 2, "ts", jobs.stream_history)
    assert [r.seq for r in jobs.too_late(spark, path).collect()] == [2]
    want = history.history_replay(df.where("seq <> 2"))
    assert sorted(map(repr, rows(jobs.decided(spark, path)))) == sorted(map(repr, rows(want)))


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_stream_history_equals_batch(spark, table, tmp_path, chunk):
    rnd = random.Random(8)
    df = table(LOG, *[(d, s, a, f"op{s}") for d in range(3) for s, a in random_log(rnd, 60, (3, 2, 2))])
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    path = streamed(spark, tmp_path, df, 4, "seq", lambda s, out, check: jobs.stream_history(s, out, check, chunk=chunk))
    assert sorted(map(repr, rows(jobs.decided(spark, path)))) == sorted(map(repr, rows(history.history_replay(df))))


def test_stream_history_forgets_old_documents(spark, table, tmp_path):
    days = [(1, 1, "edit", 0), (2, 1, "edit", 3), (1, 2, "undo", 3), (2, 2, "undo", 3.1)]
    df = table(LOG + ", ts timestamp", *[(d, s, a, "op", T0 + timedelta(days=t)) for d, s, a, t in days])
    path = streamed(spark, tmp_path, df, 4, "ts", jobs.stream_history)
    got = {(r.doc_id, r.seq): r.status for r in jobs.decided(spark, path).collect()}
    assert got == {(1, 1): "ok", (2, 1): "ok", (1, 2): "error", (2, 2): "ok"}


def test_stream_ingest_drops_redelivered_ids(spark, table, tmp_path):
    times = [T0 + timedelta(minutes=i) for i in range(10)]
    df = table("doc_id long, text string, ts timestamp, n long", *[(i % 5, "t", t, i) for i, t in enumerate(times)], (9, "t", T0, 10))
    start = lambda s, out, check: jobs.stream_ingest(
        s, out, check, lambda b: b.where("doc_id <> 3"), lambda b: b.select("doc_id"), late_s=60
    )
    path = streamed(spark, tmp_path, df, 4, "n", start)
    assert sorted(r.doc_id for r in jobs.decided(spark, path).collect()) == [0, 1, 2, 4]
    assert [r.doc_id for r in jobs.too_late(spark, path).collect()] == [9]


def test_stream_annotations(spark, table, tmp_path):
    saves = [(d, p, T0 + timedelta(minutes=s), s, f"[{s}]") for s, (d, p) in enumerate([(1, 0), (2, 0), (1, 0), (1, 1), (3, 2), (1, 0)])]
    df = table("doc_id long, page int, saved_at timestamp, seq long, items string", *saves).withColumn("n", F.col("seq"))
    # the first save of (1, 0) arrives last
    df = df.withColumn("n", F.when(F.col("seq") == 0, 9).otherwise(F.col("n")))
    start = lambda s, out, check: jobs.stream_annotations(s.drop("n"), out, check, buckets=3, compact_every=2)
    path = streamed(spark, tmp_path, df, 4, "n", start)
    wanted = table("doc_id long, page int", (1, 0), (1, 1), (2, 0), (3, 2), (4, 0))
    got = jobs.saved_annotations(spark, path, wanted, buckets=3)
    assert sorted(rows(got)) == [(1, 0, "[5]"), (1, 1, "[3]"), (2, 0, "[1]"), (3, 2, "[4]"), (4, 0, "[]")]
    assert "Aggregate" not in jobs.annotation_store(spark, path, 3).read()._jdf.queryExecution().toString()


def test_effects_compose(table):
    """A chunk's effect on any start is what walking its events from there gives."""
    rnd = random.Random(12)
    for _ in range(300):
        depth = rnd.choice([1, 3, 20])
        stack = history._Stack([], 0, depth)
        for seq in range(rnd.randrange(60)):
            stack.apply(rnd.choice(["edit", "edit", "undo", "redo"]), (seq, f"op{seq}"))
        effect = history._Effect(depth, 100)
        walked = history._Stack(stack.refs, stack.done, depth)
        for seq in range(100, 100 + rnd.randrange(50)):
            action = rnd.choices(["edit", "undo", "redo"], rnd.choice([(1, 1, 1), (0, 1, 1), (4, 2, 1)]))[0]
            effect.apply(action, (seq, f"op{seq}"))
            walked.apply(action, (seq, f"op{seq}"))
        got = history._after(effect.columns(), stack)
        assert (got.refs, got.done) == (walked.refs, walked.done)


# --- the store ---------------------------------------------------------------------


def test_store(spark, table, tmp_path):
    store = Store(spark, str(tmp_path / "store"), ["k"], buckets=4)
    make = lambda *r: table("k long, v string", *r)
    assert store.read() is None
    store.change(make(*[(k, "a") for k in range(20)]))
    store.change(make((3, "b"), (30, "b")), gone=make((4, "")))
    want = {k: "a" for k in range(20) if k != 4} | {3: "b", 30: "b"}
    assert dict(rows(store.read())) == want
    # the same version again gives the same table
    store.change(make((3, "b"), (30, "b")), gone=make((4, "")), version=1)
    assert dict(rows(store.read())) == want
    # a change that dies before its manifest changes nothing
    store._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.change(make((5, "c")))
    store = Store(spark, str(tmp_path / "store"), ["k"], buckets=4)
    assert dict(rows(store.read())) == want
    assert store.compact() > 0 and dict(rows(store.read())) == want
    assert spark.read.parquet(str(tmp_path / "store" / "data")).count() == len(want)
    store.change(gone=make(*[(k, "") for k in want]))
    assert store.read() is None


def test_store_keeps_the_newest(spark, table, tmp_path):
    store = Store(spark, str(tmp_path / "store"), ["k"], buckets=2)
    make = lambda *r: table("k long, at long, v string", *r)
    store.change(make((1, 5, "new"), (1, 4, "old"), (2, 1, "x")), newest=["at"])
    store.change(make((1, 3, "older"), (2, 2, "y")), newest=["at"])
    assert sorted(rows(store.read())) == [(1, 5, "new"), (2, 2, "y")]


def test_stream_expiry(spark, table, tmp_path):
    df = table(
        "doc_id long, ts timestamp",
        (1, T0), (2, T0), (2, T0 + timedelta(hours=20)), (3, T0 + timedelta(hours=30)), (4, T0 + timedelta(hours=30)),
    )
    feed(df, str(tmp_path / "in"), 5, "ts")
    stream = jobs.read_folder(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    jobs.write_batches(jobs.stream_expiry(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_windows_over_crowded_times(table):
    rnd = random.Random(5)
    reqs = [(i, T0 + timedelta(seconds=rnd.choice((0.25, 1)) * rnd.randrange(900) - 86_400 * 19_800 * (i % 3))) for i in range(1500)]
    df = table("request_id long, ts timestamp", *reqs, (-1, None))
    at = lambda ts: round((ts - T0).total_seconds() * 1e6)
    times = [at(ts) for _, ts in reqs]
    load = {r.request_id: r.load for r in rates.request_rate(df, 60).collect()}
    assert load == {i: sum(at(ts) - 60_000_000 <= x <= at(ts) for x in times) for i, ts in reqs}
    got = {r.request_id: r.admitted for r in rates.rate_limit(df, 60, 20, part_rows=50).collect()}
    assert got == dict(admitted_by_hand([(at(ts), i) for i, ts in reqs], 60_000_000, 20)) | {-1: False}


def test_windows_cost_no_more_when_crowded(table):
    # a range frame that slides is summed anew for every row, so its cost grows with the square of a window's rows
    times = table("key string, us long, n long", *[("all", i, 1) for i in range(50)])
    for df in (rates.window_loads(times, 10), rates.contested(times, 10, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        starts = [part.split(", ")[1] for part in plan.split("specifiedwindowframe(")[1:]]
        assert starts and all(x.startswith("unboundedpreceding") for x in starts)
