"""Each stage of the pipeline against a brute-force version over what the stage before it kept."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusbrief.llm import neardup, passages, queries, similar, substrings, texts
from corpusbrief.session import arrow_batches, landed
from tests.llm.test_registered import low, naive_language, terms, words


@pytest.fixture(scope="module")
def tables(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(landed(stage(spark, made[-1], data_dir)))
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage(tables):
    before, after = rows(tables[0]), rows(tables[1])
    model = queries.fitted_languages(tables[0])
    kept = {d for d, r in before.items() if not naive_language(model, r.text)[2]}
    assert set(after) == kept and all(after[d] == before[d] for d in kept)
    assert len(kept) > 0.95 * len(before)


def similar_groups(texts):
    """Smallest id that chains of pairs with a Jaccard similarity of 0.8 over five-word shingles reach, and the pairs."""
    sets = {}
    for d, t in texts.items():
        found = words(low(t))
        sets[d] = {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()
    ids = sorted(sets)
    pairs = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
        and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    ]
    reach = {d: d for d in ids}
    for a, b in pairs * 3:
        low_, high = sorted((reach[a], reach[b]))
        if low_ != high:
            reach = {d: low_ if r == high else r for d, r in reach.items()}
    return reach, pairs


def test_near_duplicate_stage(tables):
    before, after = rows(tables[1]), rows(tables[2])
    reach, pairs = similar_groups({d: r.text for d, r in before.items()})
    assert all(after[d] == before[d] for d in after)
    # nothing goes but for a similar text, and hardly anything stays beside one
    assert set(reach.values()) <= set(after)
    both = [p for p in pairs if set(p) <= set(after)]
    assert pairs and len(both) <= 0.1 * len(pairs)


def without_passages(texts, n=51):
    """Texts without the words that repeated stretches of ``n`` words cover, and how many words went."""
    split = {d: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for d, t in texts.items()}
    named = {d: [texts[d][a:b] for a, b in bounds] for d, bounds in split.items()}
    seen = Counter(tuple(w[i : i + n]) for w in named.values() for i in range(len(w) - n + 1))
    out = {}
    for d, w in named.items():
        gone = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = b"\x01" * n
        left, at = [], 0
        for i in range(len(w)):
            if gone[i] and not (i and gone[i - 1]):
                left.append(texts[d][at : split[d][i][0]])
            if gone[i]:
                at = split[d][i][1]
        out[d] = (b"".join([*left, texts[d][at:]]), sum(gone))
    return out


def test_passage_stage(tables):
    before, after = rows(tables[2]), rows(tables[3])
    expected = without_passages({d: r.text.encode() for d, r in before.items()})
    assert any(n for _, n in expected.values()) and set(after) <= set(before)
    for d, (left, n) in expected.items():
        left = left.decode()
        assert (d in after) == (not n or bool(words(left)))
        if d in after and n:
            assert (after[d].text, after[d].n_chars) == (left, len(left))
        elif d in after:
            assert after[d] == before[d]


def test_passages_of_short_words_are_found(spark):
    """51 words of one letter are 101 bytes, and passages need not have the same blanks."""
    rng = random.Random(8)
    pool = [chr(97 + i) for i in range(26)]
    passage = [rng.choice(pool) for _ in range(51)]
    noise = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = [
        " ".join(noise(30) + passage + noise(20)), "\n".join(noise(5) + passage + noise(40)), " ".join(noise(9) + passage[:50] + noise(9)),
        " ".join(passage[1:] + noise(60)), None, "", " \t", " ".join(passage + noise(10) + passage), " ".join(noise(400)),
    ]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(8, texts[8], 8)], "doc_id long, text string, Kept long")
    found = passages.remove_passages(docs.repartition(3)).collect()
    given = {i: (r.text or "").encode() for i, r in enumerate(found)}
    expected = without_passages(given)
    assert [(r.kept or "").encode() for r in found] == [expected[i][0] for i in given]
    assert [r.n_removed_words for r in found] == [expected[i][1] for i in given]
    assert {r.doc_id: r.n_removed_words for r in found} == {0: 51, 1: 51, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 102, 8: 400}
    assert {r.doc_id: r.n_passages for r in found}[7] == 2 and found[0].kept is not None
    empty = passages.remove_passages(docs.where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_removed_words", "n_passages", "kept"]


def edited(rng, found, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in found]


def test_edited_copies_meet(spark):
    """Groups of copies of one text, each with words exchanged, beside texts that are alone; a large group too."""
    rng = random.Random(5)
    texts = []
    for size in [2] * 30 + [5] * 5 + [150]:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, 0.012)) for _ in range(size - 1)]
    texts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 200))) for _ in range(150)]
    texts += ["few words", "Few  words", "few words here", "", None, " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.link_similar(docs).collect()}
    reach, pairs = similar_groups({i: t or "" for i, t in enumerate(texts)})
    assert len(pairs) > 1000
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(reach[got[d]] == reach[d] for d in got)  # nothing is joined that is not similar
    n = len(texts)
    assert got[n - 6] == got[n - 5] != got[n - 4] and got[n - 3] == got[n - 2] == got[n - 1]


@pytest.mark.parametrize("held", [similar.HELD, 40])
def test_all_similar_pairs_meet(spark, monkeypatch, held):
    """Texts just similar enough, with stretches that many of them share: the components are those of all pairs."""
    rng = random.Random(11)
    shared = [[f"s{i}_{j}" for j in range(25)] for i in range(4)]
    texts = []
    for group in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 260))]
        base[3:3] = shared[group % 4]
        texts += [" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.025]))) for _ in range(5)]
        texts += [" ".join(base[: len(base) - cut]) for cut in (0, 9, 18, 27)]
    texts += ["a b c", "A  b c", "a b c d", "a b c d e", "a b c d e f", "", None, " \n"]
    monkeypatch.setattr(similar, "HELD", held)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.link_similar(docs).collect()}
    reach, pairs = similar_groups({i: t or "" for i, t in enumerate(texts)})
    assert len(pairs) > 200 and all(got[a] == got[b] for a, b in pairs)
    assert all(reach[got[d]] == reach[d] for d in got)


def test_class_counts_bound_what_sets_share():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        x, y = similar.class_counts(a).astype(int), similar.class_counts(b).astype(int)
        assert x.sum() == len(a) and np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


def test_class_counts_part_large_sets():
    """Sets of many thousands that share little are parted by their counts, similar ones never; sides with other classes too."""
    rng = np.random.default_rng(6)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    for n in (2_000, 4_000, 20_000, 70_000):
        a = draw(n)
        x = similar.class_counts(a)[None]
        assert x.nbytes <= max(128, len(a))
        for share, other in ((0.05, n), (0.05, int(n * 0.82)), (0.97, n), (0.99, int(n * 0.88))):
            b = np.unique(np.r_[rng.permutation(a)[: int(other * share)], draw(int(other * (1 - share)))])
            y = similar.class_counts(b)[None]
            assert (similar.similarity(a, b) >= similar.SIMILARITY) == (share > 0.5)
            for one, two in ((x, y), (y, x)):
                assert similar.can_be_similar(one, two, similar.SIMILARITY).tolist() == [share > 0.5]
    # a class that is full tells nothing
    full = np.zeros((1, 128), np.uint8)
    full[0, 3] = similar.MANY
    assert similar.can_be_similar(full, np.zeros((1, 256), np.uint8), 0.8).all()


def test_long_texts_that_share_one_passage_are_not_compared_whole(spark, monkeypatch):
    """Long texts that share a rare passage meet, but their sets are never fetched; what is written on the way is deleted."""
    rng = random.Random(8)
    shared = [f"s{j}" for j in range(12)]
    texts = [" ".join([f"w{rng.randrange(10**7)}" for _ in range(4000)] + shared) for _ in range(40)]
    texts += [" ".join(edited(rng, texts[0].split(), 0.005))]
    docs = landed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    pairs, paths = [], []
    confirmed, path = similar._confirmed, similar.shared_path

    def noted(found, *more):
        pairs.append(found.count())
        return confirmed(found, *more)

    monkeypatch.setattr(similar, "_confirmed", noted)
    monkeypatch.setattr(similar, "shared_path", lambda *a: paths.append(path(*a)) or paths[-1])
    monkeypatch.setattr(similar, "OFTEN", 10**6)  # the passage is not known to be common
    got = {r.doc_id: r.component_id for r in similar.link_similar(docs).collect()}
    assert got == {i: i for i in range(40)} | {40: 0} and sum(pairs) <= 3
    assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_a_pair_is_proposed_few_times(spark, monkeypatch):
    """Texts that share much and are not similar enough meet by many shingles; each pair is written a few times only, and
    the first round writes none of small buckets."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(edited(rng, base, 0.035)) for _ in range(30)]
    texts += [" ".join(texts[3].split()[:-9]), None, ""]
    sets = [similar.shingle_set(t and t.encode()) for t in texts]
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if similar.similarity(sets[a], sets[b]) >= similar.SIMILARITY}
    assert alike == {(3, 30), (31, 32)}
    written = []

    def noted(df, path=None):
        done = landed(df, path)
        if path and path.endswith("/met"):
            written.append((done.count(), done.distinct().count()))
        return done

    monkeypatch.setattr(similar, "landed", noted)
    monkeypatch.setattr(similar, "COMMON", 0)
    docs = landed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r.doc_id: r.component_id for r in similar.link_similar(docs).collect()}
    assert got == {i: i for i in range(30)} | {30: 3, 31: 31, 32: 31}
    (first, _), (second, pairs) = written
    assert first == 0 and pairs > 200 and second < 5 * pairs


def test_earlier_shingles_are_of_those_before():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        tokens = rng.integers(0, 1 << 32, n).astype(np.int64)
        found = similar.earlier_shingles(tokens)
        assert ((found >> 32) & 0xFFFFFFFF == tokens[0]).all()
        mixed = (tokens * similar._MIXER) & 0xFFFFFFFF
        assert len(set(mixed.tolist())) == n
        assert (found & 0xFFFFFFFF).tolist() == [0, *(int(mixed[:i].min()) for i in range(1, n))]


@pytest.mark.parametrize("most", [25, 8])
def test_may_be_among_loses_none(spark, monkeypatch, most):
    """Every hash in the column passes, however small the table; most others do not where there is room."""
    monkeypatch.setattr(texts, "MOST_PLACES", most)
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    test = texts.may_be_among(hashes.where("id % 10 = 0"), "h")
    may, others = test(hashes, F.col("h"))
    passed = {r.id for r in may.collect()}
    assert {i for i in range(3000) if i % 10 == 0} <= passed and (len(passed) < 500 or most == 8)
    assert sorted(passed) == sorted(set(range(3000)) - {r.id for r in others.collect()}) and others.columns == ["h", "id"]
    none = texts.may_be_among(hashes.where("false"), "h")
    assert [part.count() for part in none(hashes, F.col("h"))] == [0, 3000]


def test_texts_that_do_not_change_are_not_moved(spark, monkeypatch):
    """Few of many long texts lose something or go: only those are asked for by a join, and the result is whole."""
    rng = random.Random(17)
    rows_ = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120)), "s", 0) for i in range(400)]
    passage = rows_[0][1].split()[:60]
    rows_[7] = (7, " ".join(rows_[7][1].split() + passage), "s", 0)
    rows_ += [(400, rows_[5][1], "s", 0), (5, rows_[5][1], "s", 0), (None, rows_[9][1], "s", 0), (401, None, "s", 0), (402, "", "s", 0), (None, "alone", "s", 0)]
    docs = landed(spark.createDataFrame(rows_, "doc_id long, text string, source string, n_chars long").repartition(4))
    asked = []
    whole = texts.may_be_among

    def noted(hashes, name):
        asked.append(hashes.distinct().count())
        return whole(hashes, name)

    for module in (neardup, similar, passages):
        monkeypatch.setattr(module, "may_be_among", noted)
    kept = landed(corpus_pipeline.simhash_dedup(spark, docs, ""))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    gone = {(400, rows_[5][1]), (None, rows_[9][1]), (402, "")}
    left = {(r[0], r[1]) for r in rows_} - gone
    assert got == sorted((d is None, d or 0, t or "") for d, t in left)
    assert len(asked) == 4 and max(asked) <= 8
    asked.clear()
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, kept, "").where("doc_id is not null").collect()}
    assert asked == [2] and cut[0] == " " + " ".join(rows_[0][1].split()[60:]) and cut[7] == " ".join(rows_[7][1].split()[:120]) + " "
    assert all(cut[d] == t for d, t in left if d not in (0, 7, None))


def test_link_similar_and_passages_run_in_small_batches(spark, monkeypatch):
    """Texts of 3 MB in all go to Python in several batches; the session's own size holds again, also after an error."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, ran, seen = spark.conf.get(name), [], spark.sparkContext.accumulator(0)

    def noted(df, *more):
        ran.append(int(spark.conf.get(name).removesuffix("b")))
        return landed(df, *more)

    def count(batches):
        for batch in batches:
            seen.add(1)
            yield batch.slice(0, 0)

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(5000)) for _ in range(100)]
    docs = landed(spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").coalesce(1))
    with arrow_batches(spark, similar.BATCH):
        docs.select("text").coalesce(1).mapInArrow(count, "text string").count()
    assert seen.value > 1
    monkeypatch.setattr(similar, "landed", noted)
    monkeypatch.setattr(substrings, "landed", noted)
    assert len({r.component_id for r in similar.link_similar(docs).collect()}) == 100
    linked = len(ran)
    assert corpus_pipeline.suffix_dedup(spark, docs, "").count() == 100
    assert len(ran) > linked > 0 and set(ran) == {similar.BATCH} and spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, 1):
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


def test_stars_cover_close_members():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flip = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps = np.array([b ^ flip() for b in base for _ in range(20)] + [rng.integers(0, 1 << 63, dtype=np.uint64)], np.uint64)
    found = similar.stars(fps, 8)
    assert {b // 20 == a // 20 for a, b in found} == {True} and len(found) == 6 * 19
    keys = np.sort(np.repeat(np.arange(60), 2))[: len(fps) - 1]
    keys = np.append(keys, 60)
    rows = similar.bucket_stars(keys, fps, 8)
    assert {keys[a] == keys[b] for a, b in rows} == {True} and len(rows) == 60


def test_small_parts_of_a_bucket_keep_their_centres(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [f"{base} end{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(similar, "HELD", 7)
    assert {r.component_id for r in similar.link_similar(docs).collect()} == {0}


def test_benchmark_stage(spark, data_dir, tables):
    before, after = rows(tables[3]), rows(tables[4])
    windows = set()
    for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect():
        found = terms(r.text)
        windows |= {tuple(found[i : i + 10]) for i in range(max(1, len(found) - 9) if found else 0)}
    sizes = {len(w) for w in windows}
    clean = set()
    for d, r in before.items():
        found = terms(r.text)
        if not any(tuple(found[i : i + n]) in windows for n in sizes for i in range(len(found) - n + 1)):
            clean.add(d)
    assert set(after) == clean and all(after[d] == before[d] for d in clean)


def test_mixing_stage(tables):
    before, after = rows(tables[4]), rows(tables[5])
    total, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.values():
        n = len(words(r.text))
        total[r.source] += n
        most[r.source] = max(most[r.source], n)
    for d, r in after.items():
        assert r.taken == r.copies * len(words(before[d].text)) and 1 <= r.copies <= 2
        assert r.text == before[d].text and r.source_size == total[r.source]
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in after.values()}
    assert all(abs(taken[s] - t) <= most[s] for s, t in targets.items())
    assert abs(sum(targets.values()) - 1.5 * sum(total[s] for s in targets)) < 1


def test_run_applies_the_stages(spark, data_dir, tables):
    assert sorted(corpus_pipeline.run(spark, data_dir).collect()) == sorted(tables[-1].collect())
