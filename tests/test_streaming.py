import datetime
import random

from pyspark.sql import functions as F

from corpusbrief.operators import events, requests
from corpusbrief.operators.generate import ExtractiveProvider
from corpusbrief.plans.briefs import build_bundles
from corpusbrief.sources import queues, tables
from corpusbrief.sources.store import HistoryStore
from corpusbrief.streaming import flow, folds, rates

from . import model
from .test_history import EVENTS, NOW, events_frame, history_frame, random_events

import pytest


def feed(frame, path, name):
    """One file of a queue directory."""
    frame.coalesce(1).write.mode("append").parquet(str(path))


def states(spark, path):
    return {r.analysis_id: (r.status, r.summary_set, r.summary, r.error) for r in folds.read_fold(spark, str(path)).collect()}


def test_stream_fold_equals_batch_and_survives_restart(spark, tmp_path):
    rows = random_events(21, 400)
    inbox, out, ckpt = tmp_path / "in", tmp_path / "out", str(tmp_path / "ckpt")
    for part in range(4):
        feed(events_frame(spark, rows[part * 60:(part + 1) * 60]), inbox, part)
    source = queues.read_queue(spark, str(inbox), EVENTS, files_per_trigger=1)
    folds.stream_fold(source, str(out), ckpt).awaitTermination()
    assert states(spark, out) == model.fold(rows[:240])
    assert len([p for p in out.iterdir() if p.name.startswith("batch_id=")]) == 4

    feed(events_frame(spark, rows[240:]), inbox, 9)
    folds.stream_fold(source, str(out), ckpt).awaitTermination()
    assert states(spark, out) == model.fold(rows)

    compact = tmp_path / "compact"
    folds.compact_states(spark, str(out), str(compact))
    assert states(spark, compact) == model.fold(rows)
    late = [(1000, 3, "FAILED", None, "late")]
    feed(events_frame(spark, late), inbox, 10)
    folds.stream_fold(source, str(compact), ckpt).awaitTermination()
    assert states(spark, compact) == model.fold(rows + late)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    rows = random_events(5, 100)
    frame = events_frame(spark, rows)
    target = str(tmp_path / "out" / "batch_id=0")
    for _ in range(2):
        events.fold_states(frame).write.mode("overwrite").parquet(target)
    assert states(spark, tmp_path / "out") == model.fold(rows)


def test_running_fold_in_complete_mode(spark, tmp_path):
    rows = random_events(6, 200)
    inbox = tmp_path / "in"
    for part in range(2):
        feed(events_frame(spark, rows[part * 100:(part + 1) * 100]), inbox, part)
    source = queues.read_queue(spark, str(inbox), EVENTS, files_per_trigger=1)
    query = (folds.running_fold(source).writeStream.format("memory").queryName("running_fold").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.analysis_id: (r.status, r.summary_set, r.summary, r.error) for r in spark.table("running_fold").collect()}
    assert got == model.fold(rows)


def ended_rows(spark, tmp_path, ended):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    rows = [(n, n % 7 + 1, "COMPLETED" if n % 3 else "PROCESSING", None, None) for n in range(60)]
    for part in range(3):
        feed(events_frame(spark, rows[part * 20:(part + 1) * 20]), inbox, part)
    source = queues.read_queue(spark, str(inbox), EVENTS, files_per_trigger=1)
    queues.write_queue(ended(source).select("analysis_id"), out, str(tmp_path / "ckpt")).awaitTermination()
    return sorted(r.analysis_id for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("ended", [folds.terminal_jobs, folds.ended_jobs])
def test_each_job_becomes_terminal_once(spark, tmp_path, ended):
    assert ended_rows(spark, tmp_path, ended) == list(range(1, 8))


def test_state_of_ended_jobs_goes_away(spark, tmp_path):
    """Each hour ten jobs end, some twice; after two hours their state is gone, and a job that ends again is told again."""
    def hour(h, jobs):
        at = [(100 * h + n, j, "COMPLETED", None, None, NOW + datetime.timedelta(hours=h, seconds=n)) for n, j in enumerate(jobs)]
        feed(spark.createDataFrame(at, EVENTS), tmp_path / "in", h)

    (tmp_path / "in").mkdir()
    source = queues.read_queue(spark, str(tmp_path / "in"), EVENTS, files_per_trigger=1)
    held = []
    for h in range(6):
        jobs = list(range(10 * h + 1, 10 * h + 11))
        hour(h, jobs + jobs[:3] + ([2] if h == 1 else []) + ([1] if h == 5 else []))
        ended = folds.ended_jobs(source, keep=datetime.timedelta(hours=2), delay="1 second")
        query = queues.write_queue(ended.select("analysis_id", "status", "ts"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    told = sorted(r.analysis_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told == sorted([*range(1, 61), 1])
    assert max(held) <= 31 and held[-1] <= 31 and held[0] == 10
    first = spark.read.parquet(str(tmp_path / "out")).where("analysis_id = 5").first()
    assert first.ts == NOW + datetime.timedelta(seconds=4)


def test_ended_jobs_share_parts(spark, tmp_path):
    """Jobs dealt to two parts: each is told once at its first end, and state is two rows, not one for each job."""
    ends = [(n, n % 40 + 1, "FAILED" if n < 40 else "COMPLETED", None, None, NOW + datetime.timedelta(seconds=n)) for n in range(90)]
    (tmp_path / "in").mkdir()
    for part in range(3):
        feed(spark.createDataFrame(ends[part * 30:(part + 1) * 30], EVENTS).repartition(4), tmp_path / "in", part)
    source = queues.read_queue(spark, str(tmp_path / "in"), EVENTS, files_per_trigger=1)
    query = queues.write_queue(folds.ended_jobs(source, parts=2), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    told = sorted((r.analysis_id, r.status, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told == [(j, "FAILED", NOW + datetime.timedelta(seconds=j - 1)) for j in range(1, 41)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


def test_stream_rate_flags_equal_batch_for_closed_minutes(spark, tmp_path):
    at = [NOW + datetime.timedelta(seconds=s) for s in range(0, 900, 11)]
    frame = spark.createDataFrame([(t, "u" if n % 2 else None) for n, t in enumerate(at)], "created_at timestamp_ntz, user_id string")
    feed(frame, tmp_path / "in", 0)
    source = queues.read_queue(spark, str(tmp_path / "in"), "created_at timestamp_ntz, user_id string")
    flags = rates.stream_rate_flags(source, guest=2, user=2, delay="1 minute")
    out = str(tmp_path / "out")
    queues.write_queue(flags, out, str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.minute, r.rate_key, r.n) for r in spark.read.parquet(out).withColumn("minute", F.col("minute").cast("timestamp_ntz")).collect()}
    batch = {(r.minute, r.rate_key, r.n) for r in requests.rate_flags(frame, 2, 2).collect()}
    closed = {b for b in batch if b[0] + datetime.timedelta(minutes=1) <= max(at) - datetime.timedelta(minutes=1)}
    assert got == closed and got


def test_admission_by_minute_over_batches_and_state(spark, tmp_path):
    """The first two of a user's minute and the first of the guests', over batches; state goes with the minute."""
    schema = "id long, user_id string, created_at timestamp_ntz"
    rng, n, expected = random.Random(9), 0, {}
    for batch in range(5):
        rows, taken = [], {}
        for _ in range(60):
            at = NOW + datetime.timedelta(minutes=10 * batch, seconds=rng.randrange(240))
            rows.append((n, rng.choice(["u", "v", None, ""]), at))
            n += 1
        for i, u, at in sorted(rows, key=lambda r: (r[2], r[0])):
            key = (u or "", at.replace(second=0))
            taken[key] = taken.get(key, 0) + 1
            expected[i] = taken[key] <= (2 if u else 1)
        feed(spark.createDataFrame(rows, schema), tmp_path / "in", batch)
        source = queues.read_queue(spark, str(tmp_path / "in"), schema)
        decided = rates.stream_admission(source, guest=1, user=2, delay="1 minute")
        query = queues.write_queue(decided, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination()
    assert {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 3
    every = spark.createDataFrame([(1, "u", None), (2, "u", None), (3, "u", NOW)], schema)
    assert sorted((r.id, r.admitted) for r in requests.admit(every).collect()) == [(1, False), (2, False), (3, True)]


def test_queue_names_and_batch_writes(spark, tmp_path):
    path = queues.queue_path(str(tmp_path), "results")
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    assert queues.write_queue(df, path, fmt="json") is None
    queues.write_queue(df, path, fmt="json")
    assert spark.read.schema(df.schema).json(path).count() == 2
    with pytest.raises(ValueError):
        queues.queue_path(str(tmp_path), "other")
    with pytest.raises(ValueError):
        queues.write_queue(queues.read_queue(spark, path, df.schema, "json"), path)


def test_requests_stream_gives_consecutive_ids(spark, tmp_path):
    schema = "request_id long, url string, repo_id string, lang string, size string, technicality string"
    files = spark.createDataFrame([("r1", "README.md", 20, "Hello there. More it")], "repo_id string, path string, size long, content string")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    (tmp_path / "in").mkdir()
    source = queues.read_queue(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    for part in range(2):
        rows = [(part * 10 + n, "https://github.com/o/r", "r1" if n % 2 else "r2", None, None, None) for n in range(3)]
        feed(spark.createDataFrame(rows, schema), tmp_path / "in", part)
        flow.stream_briefs(source, files, ExtractiveProvider, out, ckpt).awaitTermination()
    got = flow.read_stream_history(spark, out).orderBy("id").collect()
    assert [(r.id, r.status) for r in got] == [(n, "COMPLETED" if n in (2, 5) else "FAILED") for n in range(1, 7)]
    rejected = flow.read_stream_rejects(spark, out).collect()
    assert [(r.request_id, r.url) for r in rejected] == []


def test_repeated_batch_gives_the_same_ids_and_times(spark, tmp_path):
    schema = "request_id long, url string, repo_id string, lang string, size string, technicality string"
    files = spark.createDataFrame([("r1", "README.md", 20, "Hello there. More it")], "repo_id string, path string, size long, content string")
    out, ckpt = str(tmp_path / "out"), tmp_path / "ckpt"
    rows = [(n, "https://github.com/o/r" if n else "ftp://x", "r1", None, None, None) for n in range(3)]
    (tmp_path / "in").mkdir()
    source = queues.read_queue(spark, str(tmp_path / "in"), schema)
    feed(spark.createDataFrame(rows, schema), tmp_path / "in", 0)
    flow.stream_briefs(source, files, ExtractiveProvider, out, str(ckpt)).awaitTermination()
    first = flow.read_stream_history(spark, out).select("id", "created_at", "updated_at", "summary").collect()
    # a lost commit: the query runs the batch again
    for commit in (ckpt / "commits").iterdir():
        commit.unlink()
    flow.stream_briefs(source, files, ExtractiveProvider, out, str(ckpt)).awaitTermination()
    again = flow.read_stream_history(spark, out).select("id", "created_at", "updated_at", "summary").collect()
    assert sorted(first) == sorted(again) and len(first) == 2
    assert [(r.request_id, r.reject_reason is not None) for r in flow.read_stream_rejects(spark, out).collect()] == [(0, True)]


def scanned_files(df):
    """Files that the scans of a table opened when ``df`` ran, by the plan's own count, and the plan."""
    df.collect()
    executed = df._jdf.queryExecution().executedPlan()
    while executed.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        executed = executed.executedPlan()
    counts, todo = [], [executed]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            counts.append(node.metrics().apply("numFiles").value())
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return counts, executed.toString()


def test_only_buckets_of_the_wanted_repositories_are_read(spark, tmp_path):
    rows = [(f"r{n % 50}", f"src/f{n}.py", 20, "print('hello world')") for n in range(400)]
    files = spark.createDataFrame(rows, "repo_id string, path string, size long, content string")
    tables.store_files(files, str(tmp_path / "files"), buckets=16)
    stored = spark.read.parquet(str(tmp_path / "files"))
    everything = max(scanned_files(stored)[0])
    spark.createDataFrame([("r3",), ("r7",)], "repo_id string").write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.parquet(str(tmp_path / "wanted"))
    found = tables.files_of(stored, wanted, buckets=16)
    assert sorted(found.columns) == ["content", "path", "repo_id", "size"] and found.count() == 16
    counts, plan = scanned_files(found)
    assert "dynamicpruning" in plan.lower() and 3 * max(counts) <= everything
    # the pruning reaches both scans of the bundles
    bundles = build_bundles(found)
    assert sorted(r.repo_id for r in bundles.collect()) == ["r3", "r7"]
    assert "dynamicpruning" in bundles._jdf.queryExecution().executedPlan().toString().lower()


def test_a_drained_queue_is_empty_and_each_message_came_once(spark, tmp_path):
    path, ckpt, seen = tmp_path / "queue with blank", str(tmp_path / "ckpt"), []

    def handle(batch, batch_id):
        if fails and batch_id == fails[0]:
            raise RuntimeError("worker lost")
        seen.append((batch_id, sorted(r.n for r in batch.collect())))

    def messages():
        return [p for p in path.iterdir() if p.name.startswith("part")]

    fails = []
    for n in (1, 2, 3):
        feed(spark.createDataFrame([(n,), (n + 10,)], "n long"), path, n)
    queues.drain_queue(spark, str(path), "n long", handle, ckpt, files_per_trigger=1)
    assert sorted(x for _, ns in seen for x in ns) == [1, 2, 3, 11, 12, 13] and messages() == []
    # a pass that breaks off in its second batch leaves that batch's message and what comes after it
    for n in (4, 5, 6):
        feed(spark.createDataFrame([(n,)], "n long"), path, n)
    fails.append(4)
    with pytest.raises(Exception, match="worker lost"):
        queues.drain_queue(spark, str(path), "n long", handle, ckpt, files_per_trigger=1)
    assert len(messages()) == 2
    fails.clear()
    queues.drain_queue(spark, str(path), "n long", handle, ckpt, files_per_trigger=1)
    assert sorted(x for _, ns in seen for x in ns) == [1, 2, 3, 4, 5, 6, 11, 12, 13] and messages() == []
    queues.drain_queue(spark, str(path), "n long", handle, ckpt, files_per_trigger=1)
    assert len(seen) == 6


def store_rows(store):
    return sorted((r.id, r.status, r.summary, r.error) for r in store.read().collect())


def test_streamed_events_update_the_stored_history(spark, tmp_path):
    """Twenty batches in disorder, a repeated one and events for jobs that are not there, against one batch fold."""
    rows = random_events(31, 400, ids=15)
    jobs = history_frame(spark, [(i, "u", 0, "QUEUED", f"was {i}", None) for i in range(1, 13)])
    store = HistoryStore(spark, str(tmp_path / "store"), buckets=4)
    store.put(jobs)
    order = random.Random(3).sample(range(20), 20)
    for part in order:
        feed(events_frame(spark, rows[part * 20:(part + 1) * 20]), tmp_path / "in", part)
    source = queues.read_queue(spark, str(tmp_path / "in"), EVENTS, files_per_trigger=1)
    bad = tmp_path / "bad"
    folds.stream_history(source, store, str(tmp_path / "ckpt"), rejects_path=str(bad)).awaitTermination()
    expected = sorted(
        (r.id, r.status, r.summary, r.error) for r in events.apply_events(jobs, events.fold_events(events_frame(spark, rows))).collect()
    )
    assert store_rows(store) == expected
    refused = spark.read.parquet(str(bad))
    reasons = {r.reject_reason for r in refused.select("reject_reason").distinct().collect()}
    assert reasons == {"missing id or status", "unknown status", "unknown job"}
    assert {r.analysis_id for r in refused.where("reject_reason = 'unknown job'").collect()} == {13, 14}

    # the folder stays bounded: two copies of a bucket at most, three manifests
    data = [p for p in (tmp_path / "store" / "data").glob("version=*/bucket=*")]
    assert len(data) <= 2 * 4 and len(list((tmp_path / "store" / "manifest").glob("version=*"))) <= 2

    # a lost commit runs the last batch again: it finds itself noted
    version = store._current().version
    last = max((p for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    folds.stream_history(source, store, str(tmp_path / "ckpt"), rejects_path=str(bad)).awaitTermination()
    assert store_rows(store) == expected and store._current().version == version

    # another stream delivers everything once more: the numbers of the events say that nothing is new
    folds.stream_history(queues.read_queue(spark, str(tmp_path / "in"), EVENTS), store, str(tmp_path / "other")).awaitTermination()
    assert store_rows(store) == expected and store._current().version > version
    assert spark.read.parquet(str(bad)).count() == refused.count()


def test_a_stored_history_is_read_where_its_jobs_are(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "store"), buckets=8)
    store.put(history_frame(spark, [(i, "u", 0, "QUEUED", None, None) for i in range(1, 201)]))
    asked = spark.createDataFrame([(1, 17, "u"), (2, 17, "v"), (3, 999, None)], "request_id long, id long, user_id string")
    assert sorted((r.request_id, r.found) for r in store.lookup(asked).collect()) == [(1, True), (2, False), (3, False)]
    near = store.near(asked)
    assert len(near.inputFiles()) <= 2 < len(store.read().inputFiles())
    with pytest.raises(ValueError):
        HistoryStore(spark, str(tmp_path / "store"), buckets=9).read()


def test_a_table_that_was_read_outlives_the_next_change(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "store"), buckets=1)
    for n in range(1, 5):
        store.put(history_frame(spark, [(n, "u", 0, "QUEUED", None, None)]))
    before = store.read()
    store.put(history_frame(spark, [(9, "u", 0, "QUEUED", None, None)]))
    assert before.count() == 4 and store.read().count() == 5


def test_states_compact_while_the_query_lives(spark, tmp_path):
    rows = random_events(23, 350)
    for part in range(7):
        feed(events_frame(spark, rows[part * 50:(part + 1) * 50]), tmp_path / "in", part)
    source = queues.read_queue(spark, str(tmp_path / "in"), EVENTS, files_per_trigger=1)
    out = tmp_path / "out"
    folds.stream_fold(source, str(out), str(tmp_path / "ckpt"), compact_every=3).awaitTermination()
    assert sorted(p.name for p in out.iterdir() if p.name.startswith("batch_id=")) == ["batch_id=5", "batch_id=6"]
    assert states(spark, out) == model.fold(rows)
    # the last merge is run again
    for commit in ("5", "6"):
        (tmp_path / "ckpt" / "commits" / commit).unlink()
        crc = tmp_path / "ckpt" / "commits" / f".{commit}.crc"
        crc.unlink(missing_ok=True)
    folds.stream_fold(source, str(out), str(tmp_path / "ckpt"), compact_every=3).awaitTermination()
    assert states(spark, out) == model.fold(rows)


def test_rejected_events_are_written(spark, tmp_path):
    rows = [(1, 5, "COMPLETED", "s", None), (2, 0, "FAILED", None, "e"), (3, 6, "odd", None, None)]
    feed(events_frame(spark, rows), tmp_path / "in", 0)
    source = queues.read_queue(spark, str(tmp_path / "in"), EVENTS)
    folds.stream_fold(source, str(tmp_path / "out"), str(tmp_path / "ckpt"), rejects_path=str(tmp_path / "bad")).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [2, 3]
