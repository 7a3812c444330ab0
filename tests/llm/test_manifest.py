"""The Merkle manifest against a level-by-level version, its log order, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusbrief.llm import manifest, queries
from tests.llm.test_edges import ROWS, SCHEMA
from tests.llm.test_registered import low

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text=None):
    values = [row[f] for f in FIELDS[:-1]] + [row["text"] if text is None else text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof_of(levels, i):
    found = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        found.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return found


def expected(rows):
    """What each row gives, by (key, leaf)."""
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row["doc_id"], leaf_of(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[name] = levels_of([leaf for _, leaf, _ in trees[name]])
    upper = levels_of([built[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for i, (key, leaf, row) in enumerate(trees[name]):
            path = proof_of(built[name], i) + proof_of(upper, at)
            changed = zlib.crc32(str("" if key is None else key).encode()) % 5 == 0 and row["text"] is not None
            node = leaf_of(row, low(row["text"])) if changed else leaf
            for place, others in path:
                node = h("".join(others[:place]) + node + "".join(others[place:]))
            root = upper[-1][0]
            out.append((key, leaf, built[name][-1][0], root, h("".join(s for _, o in path for s in o)), node, node == root))
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_the_level_by_level_version(spark, data_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{data_dir}/documents.parquet").select(*FIELDS).collect()]
    assert plain(queries.queries()["op11_manifest"](spark, data_dir)) == expected(rows)


def test_three_rounds_of_builders_and_many_sources(spark):
    """More rows than two rounds hold in one source, and more sources than one run holds."""
    made = [(i, f"Text {i}", "en", "big" if i % 20 else f"s{i % 700}", i) for i in range(70_000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), m)) for m in made]
    assert len([r for r in rows if r["source"] == "big"]) > 65_536
    assert plain(manifest.verify_documents(docs)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256])
def test_log_is_in_completion_order_and_positions_are_closed_form(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    log = manifest.append(leaves, manifest.height(n))
    assert len(log) == sum(map(len, levels)) == manifest.subtree_size(n, manifest.height(n))
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            at = manifest.position(n, level, i)
            assert log[at] == node
            # all children come before their parent, and the parent right after the last of them
            if level:
                last = min(16 * i + 15, len(levels[level - 1]) - 1)
                assert manifest.position(n, level - 1, last) == at - 1
    joined = "".join(log)
    for i in range(n):
        path = manifest.siblings(joined, n, manifest.height(n), i)
        assert path == [(p, "".join(o)) for p, o in proof_of(levels, i)]
        assert manifest.fold(leaves[i], path) == log[-1]


def test_nulls_ties_repeats_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"Leaf": F.lit(1), "root": F.lit("x"), "tree": F.lit(2), "key": F.lit(3)})
    rows = [r.asDict() for r in docs.collect()]
    found = manifest.verify_documents(docs.repartition(4))
    assert plain(found) == expected(rows)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    empty = manifest.verify_documents(docs.where("false"))
    assert empty.collect() == [] and empty.columns == found.columns
    one = docs.where("doc_id = 3")
    r = manifest.verify_documents(one, tampered=F.lit(False)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == h("")


def test_changes_to_any_field_are_found(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(40)], "doc_id int, text string, lang string, source string, n_chars long")
    changes = {"text": F.lit(None), "lang": F.lit(""), "source": F.lit("S"), "n_chars": F.col("n_chars") + 1}
    for name, value in changes.items():
        shown = F.when(F.col("doc_id") == 17, value).otherwise(F.col(name))
        found = manifest.prove(manifest.write_log(docs, {name: shown}), with_path=True).collect()
        assert [r.doc_id for r in found if not r.verified] == [17]
        assert all(manifest.fold(r.leaf, r.path) == r.root for r in found)
