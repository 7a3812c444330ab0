import os

import pytest

from corpusbrief.operators import select
from corpusbrief.sources import tables, tree

from . import model


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    files = {
        "one": {
            "README.md": b"# hello world\r\nline", "pkg/__init__.py": b"import os, sys", "pkg/_x.py": b"x = 1234567",
            ".hidden": b"0123456789", ".git/config": b"0123456789", "Tests/t.py": b"0123456789", "a/b/c/d/e.go": b"package main",
            "small.py": b"x" * 9, "edge.py": b"x" * 10, "big.py": b"x" * 1048576, "huge.py": b"x" * 1048577, "logo.png": b"0123456789",
            "Makefile": b"all: \0 binary", "LICENSE": b"\xff\xfe\xff\xfe\xff\xfe\xff\xfe\xff\xfe",
        },
        "two": {f"src/d{n % 7}/f{n}.py": f"print({n:06d})".encode() for n in range(60)},
    }
    for repo, content in files.items():
        for path, data in content.items():
            full = base / repo / path
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(data)
    os.symlink(base / "two", base / "one" / "linked")
    os.symlink(base / "one" / "gone", base / "one" / "broken.py")
    return {repo: str(base / repo) for repo in files}, files


def scans(spark, roots):
    frame = spark.createDataFrame(list(roots.items()), "repo_id string, root string")
    yield tree.read_trees(spark, roots)
    yield tree.read_trees(spark, roots, split=False)
    yield tree.scan_trees(frame)
    yield tree.scan_trees(frame, tasks=3, entries_per_unit=2)
    yield tree.scan_trees(frame, emitted_only=False, entries_per_unit=1)


def test_every_way_of_scanning_selects_like_the_model(spark, roots):
    paths, files = roots
    expected = {(repo, p, model.gate(p, d)[1]) for repo, content in files.items() for p, d in content.items()
                if model.gate(p, d)[0] == "kept"}
    for scanned in scans(spark, paths):
        got = {(r.repo_id, r.path, r.text) for r in select.select_files(scanned).collect()}
        assert got == expected


def test_unpruned_scan_lists_everything_once(spark, roots):
    paths, files = roots
    frame = spark.createDataFrame(list(paths.items()), "repo_id string, root string")
    listed = [(r.repo_id, r.path) for r in tree.list_trees(frame, prune=False).collect()]
    everything = {(repo, p) for repo, content in files.items() for p in content} | {("one", "broken.py")}
    assert len(listed) == len(set(listed)) and set(listed) == everything


def test_unreadable_file_is_reported_and_skipped(spark, roots):
    paths, _ = roots
    scanned = tree.read_trees(spark, paths)
    errors = tables.read_errors(scanned).collect()
    assert [(e.repo_id, e.path) for e in errors] == [("one", "broken.py")]
    assert errors[0].read_error.startswith("FileNotFoundError")
    assert tables.readable(scanned).where("path = 'broken.py'").count() == 0


def test_audit_of_a_tree_needs_only_the_head_of_large_files(spark, roots):
    paths, _ = roots
    reasons = {(r.reason, r.n) for r in select.selection_audit(tree.read_trees(spark, {"one": paths["one"]}, prune=False)).collect()}
    assert reasons == {("directory", 2), ("name", 1), ("extension", 1), ("binary", 1), ("too_large", 1), ("too_small", 1),
                       ("empty", 1), ("unreadable", 1), ("kept", 6)}


def test_siblings_of_broken_entries_come_back(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "README.md").write_bytes(b"# hello world")
    (root / "src" / "a.py").write_bytes(b"print('hello')")
    os.symlink(root / "self", root / "self")
    bad = os.fsencode(str(root)) + b"/n\xff.py"
    with open(bad, "wb") as stream:
        stream.write(b"print('name')")
    os.makedirs(os.fsencode(str(root)) + b"/d\xfe")
    with open(os.fsencode(str(root)) + b"/d\xfe/in.py", "wb") as stream:
        stream.write(b"print('inside')")
    roots = {"r": str(root), "gone": str(tmp_path / "missing")}
    frame = spark.createDataFrame(list(roots.items()), "repo_id string, root string")
    for scanned in (tree.read_trees(spark, roots), tree.scan_trees(frame), tree.scan_trees(frame, entries_per_unit=1)):
        rows = scanned.collect()
        assert {(r.repo_id, r.path) for r in rows if r.read_error is None} == {("r", "README.md"), ("r", "src/a.py")}
        errors = {(r.repo_id, r.path): r.read_error.split(":")[0] for r in tables.read_errors(scanned).collect()}
        assert errors == {
            ("gone", "."): "FileNotFoundError", ("r", "self"): "OSError", ("r", "n\\xff.py"): "UnicodeDecodeError",
            ("r", "d\\xfe/in.py"): "UnicodeDecodeError",
        }
        assert {r.path for r in select.select_files(scanned).collect()} == {"README.md", "src/a.py"}


def test_unlistable_folder_is_reported(monkeypatch, tmp_path):
    real = os.scandir

    def scandir(path):
        if str(path).endswith("closed"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    (tmp_path / "closed").mkdir()
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "x.py").write_bytes(b"x")
    monkeypatch.setattr(os, "scandir", scandir)
    found = sorted(tree._walk(str(tmp_path), "", True))
    assert found == [("closed", False, "PermissionError: Permission denied"), ("open/x.py", False, None)]


def test_emitted_only_opens_what_a_bundle_can_hold(spark, roots):
    paths, _ = roots
    frame = spark.createDataFrame([("one", paths["one"])], "repo_id string, root string")
    names = {r.path for r in tree.scan_trees(frame, emitted_only=True).collect()}
    assert "README.md" in names and "a/b/c/d/e.go" in names and not any(n.endswith((".csv", ".png")) for n in names)


def test_binary_files_are_not_read_past_the_head(spark, roots):
    paths, _ = roots
    row = tree.read_trees(spark, {"one": paths["one"]}).where("path = 'Makefile'").first()
    assert row.content is None and b"\0" in row.head


def pushed(spark, roots, condition):
    scanned = tree.read_trees(spark, roots).where(condition)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    return sorted((r.repo_id, r.path, r.read_error is None) for r in scanned.select("repo_id", "path", "read_error").collect()), plan


@pytest.mark.parametrize("condition", [
    "repo_id = 'two'", "repo_id IN ('two', 'none')", "path LIKE 'src/d3/%'", "path LIKE '%.py'", "repo_id = 'one' AND path LIKE 'a/b/%.go'",
    "path = 'src/d1/f1.py'", "path IN ('README.md', 'src/d2/f2.py')", "repo_id <=> 'one'", "size > 100 AND repo_id = 'one'", "path LIKE '%e%'",
    "repo_id = 'one' AND repo_id = 'two'", "read_error IS NOT NULL",
])
def test_filters_reach_the_source(spark, roots, condition):
    paths, _ = roots
    everything = spark.createDataFrame(tree.read_trees(spark, paths).collect(), tree.FILES_SCHEMA)
    expected = sorted((r.repo_id, r.path, r.read_error is None) for r in everything.where(condition).collect())
    assert pushed(spark, paths, condition)[0] == expected


def test_other_roots_and_files_are_not_opened(spark, roots, tmp_path):
    paths, _ = roots
    # a root that is not there gives an error row when it is listed, and none when the filter leaves it out
    with_missing = {**paths, "gone": str(tmp_path / "gone")}
    assert ("gone", ".", False) in pushed(spark, with_missing, "true")[0]
    assert {r for r, _, _ in pushed(spark, with_missing, "repo_id = 'two'")[0]} == {"two"}
    assert pushed(spark, with_missing, "path LIKE 'src/%' AND repo_id = 'gone'")[0] == []
    reader = tree._FilteredTreeReader(with_missing, True, True)
    left = reader.pushFilters([tree.EqualTo(("repo_id",), "two"), tree.StringStartsWith(("path",), "src/d3/"), tree.IsNotNull(("path",)),
                               tree.IsNotNull(("size",))])
    assert [type(f).__name__ for f in left] == ["IsNotNull"] and left[0].attribute == ("size",)
    units = reader.partitions()
    assert {u.repo_id for u in units} == {"two"}
    rows = [row for u in units for row in reader.read(u)]
    assert rows and all(row[1].startswith("src/d3/") for row in rows)
    # Spark keeps no filter of its own for what the source took
    plan = pushed(spark, paths, "repo_id = 'two' AND path LIKE 'src/d3/%'")[1]
    assert "Filter (" not in plan


def test_large_files_go_to_spark_few_at_a_time():
    rows = [("r", f"p{n}", 5 << 20, b"", bytes(5 << 20), None) for n in range(3)] + [("r", "lost", None, None, None, "gone")]
    assert [[r[1] for r in block] for block in tree._blocks(iter(rows))] == [["p0", "p1"], ["p2", "lost"]]
    small = [("r", f"p{n}", 1, b"", b"x", None) for n in range(130)]
    assert [len(block) for block in tree._blocks(iter(small))] == [64, 64, 2]
