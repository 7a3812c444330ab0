import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusbrief.functions import rules
from corpusbrief.operators import events, history, numbering, requests
from corpusbrief.sources import tables

from . import model

EVENTS = "seq long, analysis_id long, status string, summary string, error string, ts timestamp_ntz"
NOW = datetime.datetime(2024, 1, 1)


def random_events(seed, count, ids=12):
    rng = random.Random(seed)
    pick = [None, "", "completed", "QUEUED", "PROCESSING", "COMPLETED", "FAILED", "FAILED", "COMPLETED"]
    return [(n, rng.choice([None, 0, *range(1, ids)]), rng.choice(pick), rng.choice([None, f"s{n}"]), rng.choice([None, f"e{n}"]))
            for n in range(count)]


def events_frame(spark, rows):
    timed = [(*r, NOW + datetime.timedelta(seconds=r[0])) for r in rows]
    random.Random(1).shuffle(timed)
    return spark.createDataFrame(timed, EVENTS).repartition(5)


def history_frame(spark, rows):
    full = [(i, u, f"https://h/{i}", NOW + datetime.timedelta(minutes=t), NOW, "en", "small", "expert", s, m, e) for i, u, t, s, m, e in rows]
    return spark.createDataFrame(full, tables.HISTORY_SCHEMA)


def test_folds_of_many_equal_summaries_are_not_broadcast(spark, tmp_path):
    """A thousand jobs with one summary of 100 kB: a small file by its dictionary, 100 MB of rows."""
    jobs = history_frame(spark, [(i, "u", i, "QUEUED", None, None) for i in range(1, 1001)])
    ended = spark.range(1, 1001).selectExpr(
        "id AS seq", "id AS analysis_id", "'COMPLETED' AS status", "repeat('summary ', 12500) AS summary",
        "CAST(NULL AS STRING) AS error", "timestamp_ntz'2024-01-01' AS ts",
    )
    ended.write.parquet(str(tmp_path / "events"))
    assert sum(f.stat().st_size for f in (tmp_path / "events").glob("*.parquet")) < 10 << 20
    done = events.apply_events(jobs, events.fold_events(spark.read.parquet(str(tmp_path / "events"))))
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.where("status = 'COMPLETED' AND length(summary) = 100000").count() == 1000


@pytest.mark.parametrize("seed,count", [(1, 0), (2, 30), (3, 600)])
def test_fold_equals_sequential(spark, seed, count):
    rows = random_events(seed, count)
    got = {r.analysis_id: (r.status, r.summary_set, r.summary, r.error) for r in events.fold_events(events_frame(spark, rows)).collect()}
    assert got == model.fold(rows)


def test_states_merge_in_any_order(spark):
    rows = random_events(9, 300)
    thirds = [events.fold_states(events_frame(spark, rows[n::3])) for n in range(3)]
    merged = events.folded(events.merge_states(thirds[2].unionByName(thirds[0]).unionByName(thirds[1])))
    assert {r.analysis_id: (r.status, r.summary_set, r.summary, r.error) for r in merged.collect()} == model.fold(rows)


def test_validation_splits(spark):
    rows = random_events(4, 200)
    ok, bad = events.validate_events(events_frame(spark, rows))
    assert ok.count() + bad.count() == 200
    assert {r.reject_reason for r in bad.collect()} == {"missing id or status", "unknown status"}


def test_apply_keeps_untouched_jobs_and_clears_errors(spark):
    jobs = history_frame(spark, [(1, "u", 0, "FAILED", "old", "bad"), (2, "u", 0, "QUEUED", "keep", None), (3, None, 0, "PROCESSING", "was", None)])
    rows = [(1, 1, "PROCESSING", "x", "y"), (2, 3, "COMPLETED", None, "z"), (3, 99, "FAILED", None, "e")]
    folds = events.fold_events(events_frame(spark, rows))
    updated = {r.id: (r.status, r.summary, r.error) for r in events.apply_events(jobs, folds).collect()}
    assert updated == {1: ("PROCESSING", "old", None), 2: ("QUEUED", "keep", None), 3: ("COMPLETED", None, None)}
    assert [r.analysis_id for r in events.orphan_events(folds, jobs).collect()] == [99]


def test_stage_events(spark):
    schema = ("analysis_id long, ts timestamp_ntz, repo_error_kind string, repo_error_detail string, reached_ai boolean, "
              "ai_error_kind string, ai_error_detail string, finished boolean, summary string")
    rows = [(1, NOW, "clone", "denied", True, None, None, True, "s"), (2, NOW, None, None, True, "api", "ValueError", True, None),
            (3, NOW, None, None, True, None, None, True, "done"), (4, NOW, None, None, None, None, None, None, None)]
    got = events.stage_events(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [(r.analysis_id, r.status, r.summary, r.error) for r in got] == [
        (1, "PROCESSING", None, None), (1, "FAILED", None, "Failed to clone repository: denied"),
        (2, "PROCESSING", None, None), (2, "PROCESSING", None, None), (2, "FAILED", None, rules.API_ERROR + "ValueError"),
        (3, "PROCESSING", None, None), (3, "PROCESSING", None, None), (3, "COMPLETED", "done", None), (4, "PROCESSING", None, None)]


def test_latest_jobs_per_user(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice(["a", "b", None, ""]), rng.randint(0, 30), "QUEUED", None, None) for n in range(1, 300)]
    jobs = history_frame(spark, rows)
    for user in ("a", "b"):
        expected = [r[0] for r in sorted((r for r in rows if r[1] == user), key=lambda r: (-r[2], -r[0]))][:50]
        assert [r.id for r in history.history_for_user(jobs, user).collect()] == expected
        every = history.history_topk(jobs).where(F.col("user_id") == user)
        assert sorted(r.id for r in every.collect()) == sorted(expected)
    plan = history.history_topk(jobs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in history.history_for_user(jobs, "a")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ident,user,found", [
    (1, "u", True), (1, "v", False), (1, None, True), (1, "", True), (2, "u", False), (2, None, True), (9, "u", False), (9, None, False)])
def test_lookup_checks_ownership(spark, ident, user, found):
    jobs = history_frame(spark, [(1, "u", 0, "QUEUED", None, None), (2, None, 0, "QUEUED", None, None)])
    asked = spark.createDataFrame([(7, ident, user)], "request_id long, id long, user_id string")
    row = history.lookup(asked, jobs).first()
    assert row.found == found and (row.repository_url is not None) == found and "user_id" not in row
    message = None if found else "Analysis not found or access denied." if user else "Analysis not found."
    assert row.not_found_message == message


def test_render(spark):
    jobs = history_frame(spark, [(1, "u", 0, "COMPLETED", "<b>", None), (2, "u", 0, "COMPLETED", "", None), (3, "u", 0, "FAILED", None, ""),
                                 (4, "u", 0, "FAILED", None, "why"), (5, "u", 0, "QUEUED", "x", "y")])
    got = history.render_rows(jobs).orderBy("id").collect()
    assert [r.summary_text for r in got] == ["<b>", rules.SUMMARY_MISSING, None, None, None]
    assert [r.failure_text for r in got] == [None, None, rules.FAILURE_UNKNOWN, "why", None]
    assert [r.detail_body for r in got] == [
        '<h4>Summary:</h4><div class="summary-content-box"><b></div>', "", rules.DETAIL_PENDING,
        '<p class="error"><strong>Error:</strong> why</p>', rules.DETAIL_PENDING]
    assert [r.terminal for r in got] == [True, True, True, True, False]
    assert got[0].params_line == "Params: L:en, S:small, T:expert"


def test_projections_hide_the_owner(spark):
    jobs = history_frame(spark, [(1, "u", 0, "QUEUED", None, None)])
    for view in (history.as_list_item, history.as_detail, history.as_status):
        assert "user_id" not in view(jobs).columns


def test_requests_defaults_and_rejects(spark):
    rows = [(1, "https://A.b/x", None, None, None), (2, "git@h:o/r", "fr", "", "x"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "request_id long, url string, lang string, size string, technicality string")
    ok, bad = requests.validate_requests(df)
    assert [tuple(r) for r in ok.select("url", "lang", "size", "technicality").collect()] == [("https://a.b/x", "en", "medium", "technical")]
    assert sorted(r.request_id for r in bad.collect()) == [2, 3]


def test_create_and_take_back_jobs(spark):
    rows = [(n * 7 % 101, f"https://h/{n}", "en", "small", "expert") for n in range(101)]
    df = spark.createDataFrame(rows, "request_id long, url string, lang string, size string, technicality string").repartition(9)
    jobs = requests.create_jobs(df, history_frame(spark, [(41, "u", 0, "QUEUED", None, None)]), now=NOW)
    got = sorted((r.request_id, r.id, r.status, r.created_at == r.updated_at == NOW) for r in jobs.collect())
    assert got == [(n, 42 + n, "QUEUED", True) for n in range(101)]
    assert requests.create_jobs(df).agg(F.min("id"), F.max("id")).first()[:] == (1, 101)
    left = requests.drop_failed(jobs, jobs.where("request_id < 100"))
    assert [r.request_id for r in left.collect()] == [100]


def test_numbered_within_groups(spark):
    df = spark.range(3000).select(F.nullif(F.col("id") % 5 * (F.col("id") % 2), F.lit(0)).alias("g"), ((F.col("id") * 7919) % 3001).alias("v"))
    got = numbering.numbered(df, ["v"], "n", within="g").collect()
    groups = {}
    for row in got:
        groups.setdefault(row.g, []).append((row.n, row.v))
    assert len(got) == 3000 and None in groups
    for rows in groups.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_rate_flags(spark):
    at = [(0, "u"), (10, "u"), (59, "u"), (60, "u"), (5, None), (6, ""), (61, None)]
    df = spark.createDataFrame([(NOW + datetime.timedelta(seconds=s), u) for s, u in at], "created_at timestamp_ntz, user_id string")
    got = {(r.minute, r.rate_key, r.n) for r in requests.rate_flags(df, guest=1, user=2).collect()}
    assert got == {(NOW, "u", 3), (NOW, "guest", 2)}
    assert requests.rate_flags(df).count() == 1


def test_status_counts(spark):
    jobs = history_frame(spark, [(1, "u", 0, "COMPLETED", "s", None), (2, "u", 0, "COMPLETED", None, None), (3, "v", 0, "FAILED", None, "e")])
    assert {tuple(r) for r in history.status_counts(jobs).collect()} == {("COMPLETED", 2, 1, 0), ("FAILED", 1, 0, 1)}
    assert history.status_counts(jobs, "user_id").count() == 2


def test_history_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    jobs = history_frame(spark, [(1, None, 0, "QUEUED", None, None)])
    tables.append_jobs(jobs, path)
    tables.append_jobs(jobs.withColumn("id", F.lit(2).cast("long")).withColumn("extra", F.lit(1)), path)
    assert sorted(r.id for r in tables.read_history(spark, path).collect()) == [1, 2]


def test_files_from_any_table(spark):
    df = spark.createDataFrame([("r", "p", "é")], "a string, b string, c string")
    assert tables.files_from_table(df, "a", "b", "c").first()[:] == ("r", "p", 2, "é")


def test_reads_by_user_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.append_jobs(history_frame(spark, [(1, "u", 0, "QUEUED", None, None)]), path)
    plan = history.history_for_user(tables.read_history(spark, path), "u")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u)" in plan and "summary" not in plan


def test_a_user_named_guest_is_not_a_guest(spark):
    df = spark.createDataFrame([(NOW, "guest"), (NOW, None), (NOW, "")], "created_at timestamp_ntz, user_id string")
    assert {(r.rate_key, r.is_guest, r.n) for r in requests.rate_counts(df).collect()} == {("guest", False, 1), ("guest", True, 2)}


def test_missing_parameters_are_shown(spark):
    kinds = "id long, user_id string, repository_url string, created_at timestamp_ntz, updated_at timestamp_ntz, lang string, size string, technicality string, status string, summary string, error string"
    row = history.render_rows(spark.createDataFrame([(1, None, "u", NOW, NOW, None, "small", None, "QUEUED", None, None)], kinds)).first()
    assert (row.params_line, row.detail_params) == ("Params: L:null, S:small, T:null", "Lang: null, Size: small, Tech: null")


def test_store_changes_touch_their_buckets_only(spark, tmp_path):
    from corpusbrief.sources.store import HistoryStore

    kinds = "id long, user_id string, repository_url string, created_at timestamp_ntz, updated_at timestamp_ntz, lang string, size string, technicality string, status string, summary string, error string"
    jobs = spark.createDataFrame([(i, "u", "r", NOW, NOW, "en", "small", "expert", "QUEUED", None, None) for i in range(1, 41)], kinds)
    store = HistoryStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.read().count() == 0
    store.put(jobs)
    store.put(jobs)
    assert store.read().count() == 40
    folds = events.fold_events(events_frame(spark, [(1, 3, "COMPLETED", "done", None), (2, 99, "FAILED", None, "x")]))
    store.apply(folds)
    written = sorted(p.name for p in (tmp_path / "store" / "data" / "version=3").iterdir() if p.name.startswith("bucket"))
    assert len(written) <= 2
    assert [(r.status, r.summary) for r in store.read().where("id = 3").collect()] == [("COMPLETED", "done")]
    # a change that failed before its manifest leaves the old version, and is made again
    (tmp_path / "store" / "data" / "version=4" / "bucket=0").mkdir(parents=True)
    assert store.read().count() == 40
    store.delete(jobs.where("id <= 10").select("id"))
    assert {r.id for r in store.read().collect()} == set(range(11, 41))
    store.delete(jobs.select("id"))
    assert store.read().count() == 0
    store.put(jobs.limit(2))
    assert store.read().count() == 2


def test_bucketed_tables_join_where_they_lie(spark, tmp_path):
    jobs = history_frame(spark, [(i, "u", 0, "QUEUED", None, None) for i in range(1, 501)])
    stored = tables.store_bucketed(jobs, str(tmp_path / "jobs"), buckets=8)
    asked = spark.range(1, 700).select(F.col("id").alias("request_id"), F.col("id"), F.lit("u").alias("user_id"))
    asked = tables.store_bucketed(asked, str(tmp_path / "asked"), buckets=8)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = history.lookup(asked, stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sum(r.found for r in found.collect()) == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows it
    try:
        one = stored.where("id = 17")
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
