import random

import pytest
from pyspark.sql import functions as F

from corpusbrief.functions import paths, rules
from corpusbrief.operators import assemble, select
from corpusbrief.operators.numbering import sums_before
from corpusbrief.operators.skew import SALT, add_salt, find_hot_keys, first_per_group

from . import model

FILES = "repo_id string, path string, size long, content binary"


def random_repo(rng, count):
    folders = ["", "src/", "src/a/", "Tests/", ".git/", "_p/", "lib/docs/", "é/"]
    names = ["README.md", "LICENSE", "Makefile", "__init__.py", "_x.py", ".env", "a.PY", "b.min.js", "c.go", "d.txt", "e.png", "tool", "f.", "go.mod"]
    bodies = [b"x" * 9, b"x" * 10, b"plain text here\r\nnext\rend\n", b"\xff\xfe" * 8, b"ok\xffok\xc3 bytes", "é€😀 wide text".encode(),
              b"nul \0 in the head", b"x" * 1024 + b"\0", b"   \n \t  \n    "]
    files = {}
    for number in range(count):
        folder, name = rng.choice(folders), rng.choice(names)
        if rng.random() < 0.7:
            stem, dot, tail = name.partition(".")
            name = f"{stem}{number}{dot}{tail}"
        files[folder + name] = rng.choice(bodies) * rng.choice([1, 1, 1, 7])
    return files


def as_frame(spark, repos):
    rows = [(repo, path, len(data), bytearray(data)) for repo, files in repos.items() for path, data in files.items()]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def repos():
    rng = random.Random(3)
    found = {f"r{n}": random_repo(rng, rng.choice([5, 40, 200])) for n in range(12)}
    found["hot"] = random_repo(rng, 900)
    return found


@pytest.fixture(scope="module")
def frame(spark, repos):
    return as_frame(spark, repos).repartition(6).cache()


def bundles_of(files, cap, budget, hot):
    capped = select.cap_sources(select.select_files(files, emitted_only=True), cap, hot)
    return {r.repo_id: (r.text, r.total_chars, r.truncated) for r in assemble.assemble(capped, budget, hot).collect()}


@pytest.mark.parametrize("cap,budget", [(150, 500_000), (3, 500_000), (20, 700), (5, 1), (1000, 20_000)])
@pytest.mark.parametrize("salted", [False, True])
def test_bundles_equal_sequential_model(frame, repos, cap, budget, salted):
    hot = find_hot_keys(frame, "repo_id", each=30) if salted else None
    expected = {repo: model.bundle(files, cap, budget) for repo, files in repos.items()}
    expected = {repo: value for repo, value in expected.items() if value[1] > 0}
    assert bundles_of(frame, cap, budget, hot) == expected


def test_totals_by_class_survive_salting(frame):
    selected = select.select_files(frame, emitted_only=True)
    hot = find_hot_keys(frame, "repo_id", each=30)
    plain = assemble.assemble(select.cap_sources(selected, 10), 300)
    salted = assemble.assemble(select.cap_sources(selected, 10, hot), 300, hot)
    assert sorted(plain.collect()) == sorted(salted.collect())


@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_budget_edge_counts_characters(spark, extra):
    # one wide character sits at the cut
    body = "a" * 30 + "😀" + "b" * 30
    files = {"README.md": body.encode(), "x.py": b"0123456789"}
    total = model.bundle(files, 150, 10_000)[1]
    for budget in (total + extra, 17 + len("README.md") + 31 + extra):
        assert bundles_of(as_frame(spark, {"r": files}), 150, budget, None) == {"r": model.bundle(files, 150, budget)}


def test_size_gate_edges(spark):
    sizes = [9, 10, 1048576, 1048577]
    df = as_frame(spark, {"r": {f"f{n}.py": b"x" * n for n in sizes}})
    assert sorted(r.size for r in select.select_files(df).collect()) == [10, 1048576]


def test_audit_counts_first_failing_gate(frame, repos):
    expected = {}
    for repo, files in repos.items():
        for path, data in files.items():
            key = (repo, model.gate(path, data)[0])
            expected[key] = expected.get(key, 0) + 1
    assert {(r.repo_id, r.reason): r.n for r in select.selection_audit(frame).collect()} == expected


def test_walk_positions(frame, repos):
    got = {(r.repo_id, r.position): r.path for r in select.walk_positions(frame).collect()}
    expected = {(repo, n + 1): path for repo, files in repos.items() for n, path in enumerate(model.walk_sorted(files))}
    assert got == expected


def test_parse_counts_cap_sources_only(frame, repos):
    capped = select.cap_sources(select.select_files(frame), 7)
    for row in select.parse_counts(capped).collect():
        assert row.source <= 7 and row.processed == row.important + row.source


def test_first_per_group_salted_equals_plain(spark):
    key = F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 1).otherwise(0)
    df = spark.range(5000).select(F.nullif(key, F.lit(0)).alias("k"), "id")
    hot = find_hot_keys(df, "k", each=499)
    assert {r.k for r in hot.collect()} == {None, 1, 2}
    assert add_salt(df, "k", F.col("id"), hot).where("k is null").select(SALT).distinct().count() > 1
    order = [F.desc("id")]
    plain = first_per_group(df, "k", order, 50, F.col("id"))
    salted = first_per_group(df, "k", order, 50, F.col("id"), hot)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect())) and salted.count() == 150


def test_hot_keys_are_weighed_and_optional(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"))
    assert find_hot_keys(df, "k", each=11) is None
    assert {r._salts for r in find_hot_keys(df, "k", each=3).collect()} == {4}
    assert [r.k for r in find_hot_keys(df, "k", 500, F.col("k")).orderBy("k").collect()] == list(range(51, 100))


def test_route_blank(spark):
    bundles = spark.createDataFrame([("a", "text"), ("b", " \n\t ")], "repo_id string, text string")
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "id long, repo_id string")
    got = {r.id: (r.route, r.error) for r in assemble.route_blank(jobs, bundles).collect()}
    bad = ("failed", rules.BLANK_REPOSITORY)
    assert got == {1: ("analyse", None), 2: bad, 3: bad, 4: ("analyse", None)}


# --- plans ---------------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cap_limits_groups_before_the_shuffle(frame):
    plan = plan_of(select.cap_sources(select.select_files(frame), 150))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_bundles_shuffle_twice_and_use_no_python(frame):
    selected = select.select_files(frame, emitted_only=True)
    plan = plan_of(assemble.assemble(select.cap_sources(selected), 500_000))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Python" not in plan and "ArrowEval" not in plan


def test_places_give_the_same_bundles(spark, frame, repos):
    selected = select.select_files(frame, emitted_only=True)
    for cap, budget in ((150, 500_000), (3, 200), (1, 90), (7, 1)):
        expected = sorted(assemble.assemble(select.cap_sources(selected, cap), budget).collect())
        assert sorted(assemble.gather(frame, select.capped_places(selected, cap), budget).collect()) == expected


def test_no_text_is_sorted_and_none_moves_but_that_of_the_bundles(frame):
    places = select.capped_places(select.select_files(frame, emitted_only=True), 150)
    plan = plan_of(assemble.gather(frame, places, 500_000))
    assert "ShuffledHashJoin" in plan and "Window" not in plan
    for line in plan.splitlines():
        if " Sort [" in line or "Window [" in line:
            assert "content" not in line and "text" not in line
    measured = plan_of(places)
    assert "content" not in measured and "text" not in measured


def test_a_repository_of_many_important_files_is_spread(spark):
    """One repository with nearly all rows, all of a class without a cap: no task reads more than a share of them."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 59_900, F.lit("big")).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("repo_id"),
        F.concat(F.lit("d"), F.col("id") % 300, F.lit("/"), F.col("id"), F.lit("/README.md")).alias("path"),
        F.lit("important").alias("file_class"), (F.col("id") % 90 + 40).alias("chars"), F.lit(0).cast("long").alias("_source"),
    ).repartition(8)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # so small a table would come to one task
    try:
        placed = sums_before(rows, "repo_id", ["_source", paths.walk_key("path")], {"start": "chars", "_earlier": "_source"})
        shares = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(merged, "true")
    assert max(r["count"] for r in shares) < 20_000
    got = [(r.path, r.start) for r in placed.where("repo_id = 'big'").collect()]
    sizes = {r.path: r.chars for r in rows.where("repo_id = 'big'").collect()}
    assert len(got) == 59_900
    at = 0
    for path, start in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += sizes[path]
    assert [p for p, _ in sorted(got, key=lambda g: g[1])] == model.walk_sorted(list(sizes))


def test_path_queries_do_not_read_content(spark, data_dir):
    from corpusbrief.plans.catalog import queries

    for name in ("q_dir_prune", "q_class", "q_walk_order"):
        plan = plan_of(queries()[name](spark, data_dir))
        assert "text:string" not in plan
