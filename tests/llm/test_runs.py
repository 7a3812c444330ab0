"""Periodic runs against a scan of every period, on random texts, on the tables and on edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbrief.llm import queries, runs
from tests.llm.test_edges import ROWS, SCHEMA
from tests.llm.test_registered import words


def all_runs(found):
    """Every period up to a quarter of the words is scanned; the smallest period of a stretch counts."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(found))}
    ids = np.array([numbers[w] for w in found], np.int64)
    best = {}
    for q in range(1, len(ids) // 4 + 1):
        same = np.r_[False, ids[q:] == ids[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for first, end in zip(edges[::2], edges[1::2]):
            spot = (int(first), int(end - first + q))
            if spot[1] >= max(6, 4 * q):
                best.setdefault(spot, q)  # periods ascend
    return sorted((s, n, q) for (s, n), q in best.items())


def expected(doc, text):
    found = words(text)
    n, key = len(found), zlib.crc32(str(doc).encode() if doc is not None else b"")
    g = key // 10
    if key % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]
    every = all_runs(found)
    best = min(every, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = set()
    for s, length, q in every:
        gone |= set(range(s + q, s + length))
    kept = " ".join(w for i, w in enumerate(found) if i not in gone)
    log = "".join(f"{s},{length},{q}\n" for s, length, q in every)
    return (
        len(every), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(log.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_a_scan_of_every_period(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op13_periodic_runs"](spark, data_dir)
    assert got.columns == ["doc_id", *NAMES]
    answers = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert answers == {d: expected(d, t) for d, t in rows}
    periods = [a[3] for a in answers.values() if a[3]]
    assert max(periods) > runs.DIRECT and min(periods) <= runs.DIRECT  # both ways are taken


def random_text(rng):
    """Stretches of periods on both sides of the bound, some with a period of their own inside, and noise between."""
    found = []
    while len(found) < rng.choice([0, 5, 30, 200, 900, 2500]):
        p = rng.choice([1, 2, 3, 7, 20, 24, 25, 26, 31, 32, 33, 50, 64, 100, 199])
        kinds = rng.choice([1, 2, 3, 50, 5000])
        period = [rng.randrange(kinds) for _ in range(p)]
        if rng.random() < 0.3:
            period = [0] * (p - 1) + [1]
        found += (period * 8)[: int(rng.uniform(0.5, 7) * p)]
        found += [rng.randrange(9000) for _ in range(rng.randrange(40) if rng.random() < 0.5 else 0)]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    found_long = 0
    for _ in range(25):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 12))]
        for text, got in zip(texts, runs.find_runs([np.array(t, np.int64) for t in texts]), strict=True):
            assert got == all_runs(text)
            found_long += sum(q > runs.DIRECT for _, _, q in got)
    assert found_long > 20


def test_fibonacci_and_nested_periods():
    """Texts with as many repetitions as words can hold."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    inner = ([0, 1, 2] * 30 + [3]) * 6
    for text in (b, inner, [0] * 5000, (list(range(40)) * 4 + [99]) * 5):
        assert runs.find_runs([np.array(text, np.int64)]) == [all_runs(text)]


def test_one_long_run_in_a_long_text():
    period = list(range(30_000))
    text = [-5, *period * 4, 7]
    assert runs.find_runs([np.array(text, np.int64)]) == [[(1, 120_000, 30_000)]]


def test_nulls_long_texts_repeats_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"N_Runs": F.lit("x"), "START": F.lit(1), "period": F.lit(2)})
    got = runs.describe_runs(docs.repartition(3), plant_by="doc_id", full=True)
    assert got.columns == [c for c in docs.columns if c not in ("N_Runs", "START", "period")] + list(runs.FIELDS)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    small = [r for r in rows if r.text is None or len(r.text) < 10_000]
    assert sorted((repr((r.doc_id, *(r[n] for n in NAMES))) for r in small)) == sorted(
        repr((r[0], *expected(r[0], r[1]))) for r in ROWS if r[1] is None or len(r[1]) < 10_000
    )
    for r in rows:
        assert r.n_runs == len(r.runs) and r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()
    empty = runs.describe_runs(docs.where("false"), full=True)
    assert empty.collect() == [] and empty.columns == got.columns
