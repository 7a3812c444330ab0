"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusbrief.llm import contamination, language, licenses, mixing, neardup, quality, scoring, substrings, urls, warc
from corpusbrief.session import landed
from tests.llm.context_tree import weigh
from tests.llm.test_registered import classes, fingerprint, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, __x int"
random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(400)]
LONG = " ".join(random.choices(VOCABULARY, k=200_000))
PROSE = " ".join(random.choices(VOCABULARY, k=120))
TEXTS = [None, "", " \t\n", "a", "a", "Ünïcode \x00 ß 漢字", "1234 !!", PROSE, PROSE, PROSE.replace(VOCABULARY[0], "zz"), LONG]
ROWS = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, None, None, 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], (None, None, None, None, None, None, None, None), (None, PROSE, "de", "é", 1, 0.5, "h", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def licensed(docs):
    return licenses.scan_licenses(docs)


def cut(docs):
    return substrings.remove_repeats(docs, keep_text=True)


def mixed(docs):
    return mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("taken", F.lit("x")))


def archived(docs):
    return warc.round_trip(docs, key="doc_id", url="host", html="text")


def scored(docs):
    return scoring.score_texts(docs, docs.select("text"))


def filtered(docs):
    return urls.filter_urls(docs, urls.repeated_keys(docs, "host"), "host")


def linked(docs):
    return neardup.link_documents(docs.withColumn("fingerprint", F.lit(1)), keep_text=True)


def judged(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    return quality.judge(docs.withColumn("kept", F.lit(5)), quality.fit_decision_list(docs, labels))


def decontaminated(docs):
    return contamination.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id in (3, 7, 9)"))


def identified(docs):
    return language.identify(docs, language.fit_dictionaries(docs))


ALL = [licensed, cut, mixed, archived, scored, filtered, linked, judged, decontaminated, identified]


@pytest.mark.parametrize("operator", ALL)
def test_all_rows_come_back(operator, docs, none):
    full = operator(docs)
    assert len(full.collect()) == len(ROWS)
    assert len(set(full.columns)) == len(full.columns)
    empty = operator(none)
    assert empty.collect() == [] and empty.columns == full.columns


MADE = {
    licensed: licenses.FIELDS, cut: substrings.COLUMNS, mixed: mixing.COLUMNS, scored: scoring.COLUMNS, filtered: urls.COLUMNS,
    linked: neardup.COLUMNS, judged: [*quality.BASE, "base_failed", "rule", "kept"],
    decontaminated: contamination.COLUMNS, identified: language.FIELDS,
}
HELPERS = (
    "__row __s __size __fp __source __key __host __path __rule __of __text __bytes __own __piece __draw __found __like __u __h1 __h2 "
    "__k __l __g __src __bin __rank __total __goal __whole __p __rest __mean __result __removed __left"
).split()


@pytest.mark.parametrize("operator", list(MADE))
def test_names_in_another_case_and_helper_names(operator, docs):
    """Output names in upper case are replaced; columns named like an operator's helpers come back as they were."""
    small = docs.where("coalesce(length(text), 0) < 10000")
    upper = {name.upper(): F.lit("x") for name in MADE[operator] if name.upper() != name}
    named = small.drop("__x").withColumns({**{n: c for n, c in upper.items() if n.lower() not in map(str.lower, docs.columns)}, **{h: F.lit(i) for i, h in enumerate(HELPERS)}})
    full = operator(named)
    assert len({c.lower() for c in full.columns}) == len(full.columns)
    rows = full.collect()
    assert len(rows) == small.count()
    assert all(r[h] == i for r in rows for i, h in enumerate(HELPERS))
    assert {tuple(str(r[c]) for c in MADE[operator] if c in full.columns and c != "score") for r in rows} == {
        tuple(str(r[c]) for c in MADE[operator] if c in full.columns and c != "score") for r in operator(small).collect()}


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def test_null_and_empty_texts(docs):
    assert [(by_id(licensed(docs).collect())[i].n_words, by_id(licensed(docs).collect())[i].labels) for i in (0, 1)] == [(0, "")] * 2
    assert all(by_id(identified(docs).collect())[i].lang_pred == "und" for i in (0, 1, 2, 6))
    found = by_id(scored(docs).collect())
    assert found[0].n_tokens == found[1].n_tokens == 1 and found[0].score == found[1].score < 0
    assert found[10].n_tokens == 200_001
    kept = by_id(judged(docs).collect())
    assert kept[0].base_failed and not kept[0].kept and not kept[10].base_failed


def test_repeats_and_ties(docs):
    rows = cut(docs).collect()
    expected = repeats([(t or "").encode() for _, t, *_ in ROWS], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(expected)
    assert all(r.kept == (r.text or "") for r in rows if not r.n_removed)
    prints = {(i, r[0]): fingerprint(r[1]) for i, r in enumerate(ROWS) if r[0] is not None}
    for r in linked(docs).collect():
        if r.doc_id is not None:
            group = [k for k, v in prints.items() if v == int(r.fingerprint, 16)]
            assert r.component_id <= min(i for _, i in group)
    assert neardup.keep_one(docs).count() == len({r.component_root for r in linked(docs).collect()})


def test_short_windows_match_brute_force(spark):
    random.seed(3)
    for alphabet, length, gram in (("ab", 12, 5), ("abc", 9, 9), ("abé", 16, 3)):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(60)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        expected = repeats([t.encode() for t in texts], length)
        for group in (2, 1024):  # few strings of an anchor at once, so that large groups are dealt by window
            got = substrings.remove_repeats(docs, length=length, gram=gram, group=group).orderBy("doc_id").collect()
            assert [tuple(r)[1:] for r in got] == expected


def test_long_texts_are_cut_in_segments(monkeypatch):
    monkeypatch.setattr(substrings, "_SEGMENT", 64)
    text = random.Random(1).randbytes(1000)
    runs = [r for part in substrings.Anchors(20, 8).runs(text) for r in part.tolist()]
    assert [s for r in runs for s in range(r[2], r[2] + r[3])] == list(range(981))


def test_crowded_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 9), replace=False)) for _ in range(120)}
    fps |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 80)}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    expected = classes({f: f & (1 << 64) - 1 for f in fps})
    for bucket in (4, 1 << 17):
        edges = neardup.linked_fingerprints(table, bucket=bucket)
        roots = {r.node: r.root for r in neardup.components(edges).collect()}
        assert {f: roots.get(f, f) for f in fps} == expected


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in neardup.components(edges).collect()} == {i: 0 for i in range(1, 201)} | {500: 400}


def test_context_tree_is_a_distribution_and_exact():
    texts = [b"abracadabra", b"abrac", b"", "é".encode()]
    counts = {}
    for codes in scoring._grams(texts, 2):
        for c in codes.tolist():
            counts[c] = counts.get(c, 0) + 1
    contexts = [[0], sorted({c >> 8 & 0xFF for c in counts}), sorted({c >> 8 for c in counts})]
    tree = weigh(contexts, [(2, c >> 8, c & 0xFF, n) for c, n in counts.items()], 2)
    assert np.allclose((10 ** tree.log10.astype(float)).sum(axis=1), 1, atol=1e-4)
    # the recursion written out for one context
    kt = lambda z, o: math.exp(math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1)) / math.pi

    def bits(suffix, node):
        zero = one = 0
        depth = node.bit_length() - 1
        for c, n in counts.items():
            byte, before = c & 0xFF, c >> 8
            if (before & (1 << 8 * len(suffix)) - 1) == int.from_bytes(suffix, "big") and (byte | 256) >> 8 - depth == node:
                one, zero = (one + n, zero) if byte >> 7 - depth & 1 else (one, zero + n)
        return zero, one

    def weighted(suffix, node):
        if len(suffix) == 2:
            return kt(*bits(suffix, node))
        return (kt(*bits(suffix, node)) + math.prod(weighted(bytes([b]) + suffix, node) for b in range(256) if sum(bits(bytes([b]) + suffix, node)))) / 2

    def predicted(suffix, node, context):
        z, o = bits(suffix, node)
        own = (o + 0.5) / (z + o + 1)
        if len(suffix) == 2:
            return own
        stay = kt(z, o) / 2 / weighted(suffix, node)
        longer = context[1 - len(suffix) : 2 - len(suffix)] + suffix
        return stay * own + (1 - stay) * predicted(longer, node, context)

    expected, node = 0.0, 1
    for bit in f"{ord('r'):08b}":
        p = predicted(b"", node, b"ab")
        expected += math.log10(p if bit == "1" else 1 - p)
        node = 2 * node + int(bit)
    place = tree.child[tree.child[0, ord("b")], ord("a")]
    assert math.isclose(float(tree.log10[place, ord("r")]), expected, rel_tol=1e-5)


def test_rare_contexts_and_words_are_pooled(spark, docs, monkeypatch):
    plain = scoring.score_texts(docs, docs.select("text")).orderBy("doc_id", "n_tokens").collect()
    monkeypatch.setattr(scoring, "WORD_SHARE", 0.02)
    joined = scoring.score_texts(docs, docs.select("text")).orderBy("doc_id", "n_tokens").collect()
    for a, b in zip(plain, joined):
        assert (a.n_known, a.score) == (b.n_known, b.score) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)


def test_all_contexts_seen_twice_are_weighted(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "zebra", None])], "doc_id long, text string")
    counts = {}
    for codes in scoring._grams([t.encode() for t in texts], scoring.DEPTH):
        for c in codes.tolist():
            counts[c] = counts.get(c, 0) + 1
    contexts, leaves, kept = [[0]], [], [{0}]
    for d in range(1, scoring.DEPTH + 1):
        totals = {}
        for c, n in counts.items():
            totals[c >> 8 & (1 << 8 * d) - 1] = totals.get(c >> 8 & (1 << 8 * d) - 1, 0) + n
        kept.append({c for c, n in totals.items() if n >= scoring.SEEN})
        contexts.append(sorted(kept[-1]))
    for c, n in counts.items():
        d = max(d for d in range(scoring.DEPTH + 1) if c >> 8 & (1 << 8 * d) - 1 in kept[d])
        leaves.append((d, c >> 8 & (1 << 8 * d) - 1, c & 0xFF, n))
    tree = weigh(contexts, leaves, scoring.DEPTH)
    expected = {r.doc_id: tree.score((r.text or "").encode()) for r in docs.collect()}
    for common in (scoring.COMMON_GRAMS, 20):  # most grams are joined
        monkeypatch.setattr(scoring, "COMMON_GRAMS", common)
        got = scoring.score_texts(docs, docs.where("doc_id < 60").select("text")).collect()
        assert len(got) == 62 and all(math.isclose(r.score, expected[r.doc_id], rel_tol=1e-5) for r in got)


def test_counting_grams_holds_little():
    """Sums are those of all numbers, and what a task holds meanwhile is a few times the distinct ones."""
    rng = np.random.default_rng(12)
    parts = [(rng.zipf(1.3, rng.integers(1, 300_000)) % 400_000).astype(np.int64) for _ in range(40)]
    expected = np.unique(np.concatenate(parts), return_counts=True)
    counts = scoring._Counts()
    tracemalloc.start()
    for part in parts:
        counts.add(part)
    found = counts.taken()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(found, expected)) and counts.taken() is None
    assert peak < 30 << 20, peak


def test_scoring_sends_texts_in_small_batches(spark, docs, monkeypatch):
    """All Python of the operator runs with its own batch size, and the session's holds again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, ran = spark.conf.get(name), []

    def noted(df, *more):
        ran.append(int(spark.conf.get(name).removesuffix("b")))
        return landed(df, *more)

    monkeypatch.setattr(scoring, "landed", noted)
    scored = scoring.score_texts(docs, docs.select("text"))
    assert len(ran) == 4 and set(ran) == {2 << 20} and spark.conf.get(name) == before
    assert scored.count() == docs.count() and len(ran) == 4


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_lookup_finds_what_is_there_and_nothing_else(n):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 1 << 48, n))
    rng.shuffle(codes)
    table = scoring.Lookup.of(codes, rng.random(len(codes)))
    asked = np.concatenate([codes, rng.integers(0, 1 << 48, 5000), codes[:10]])
    number = {c: i for i, c in enumerate(codes.tolist())}
    assert table.places(asked).tolist() == [number.get(c, -1) for c in asked.tolist()]


def test_grams_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abC \xc3\xa9", k=rng.choice([0, 1, 5, 90, 700]))) for _ in range(80)]
    for together in (1, 100, 1 << 19):
        monkeypatch.setattr(scoring, "_TOGETHER", together)
        found = [[] for _ in texts]
        for codes, owner in scoring._grams_by_text(texts, scoring.DEPTH):
            for code, who in zip(codes.tolist(), owner.tolist(), strict=True):
                found[who].append(code)
        assert found == [np.concatenate(list(scoring._grams([t], scoring.DEPTH))).tolist() for t in texts]


def test_contexts_grow_with_the_training_texts(spark):
    # each context holds less than 1 / 16,384 of the bytes, and is seen often enough to be learned
    words = [f"{i:05d}" for i in range(0, 100_000, 5)]
    train = spark.createDataFrame([(" ".join(words) + " ",) for _ in range(4)], "text string")
    docs = spark.createDataFrame([(0, "00005 43210 99995 ")], "doc_id long, text string")
    grams = {r.gram: r.log10 for r in scoring.gram_probabilities(docs, train).collect()}
    for word in ("43210", "99995"):
        code = int.from_bytes(f"{word} ".encode(), "big")
        assert grams[code] > math.log10(0.7)


def test_cascade_is_exact(spark):
    keys = [(f"k{i}", i % 37 == 0) for i in range(20_000)]
    table = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = urls.build_cascade(table)
    got = urls.with_membership(table.drop("listed"), F.col("key"), cascade).collect()
    assert {r.key: r.listed for r in got} == dict(keys) and len(cascade.levels) > 2
    assert urls.build_cascade(table, max_bytes=10) is None
    assert not any(r.listed for r in urls.with_membership(table.drop("listed"), F.col("key"), urls.build_cascade(table.where("NOT listed"))).collect())


def test_large_lists_are_joined(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/p#{i}") for i in range(80)] + [(99, None), (100, "no url")], "page_id long, url string")
    small = urls.filter_urls(pages, urls.repeated_keys(pages)).collect()
    assert sorted(small) == sorted(urls.filter_urls(pages, urls.repeated_keys(pages), max_bytes=0).collect())
    assert sum(r.listed for r in small) == 60


def test_records_survive_what_payloads_hold(spark, tmp_path):
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(3, "http://x/a b\r\nc", odd), (1, None, odd), (None, "u", odd), (5, "http://y/", None), (6, "http://y/", ""), (7, "z", "é" * 9), (7, "z", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), revisit_from_bytes=0)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows)
    got = sorted((r.page_id or 0, r.capture.record_type, r.capture.payload_bytes, (r.origin or [None])[0]) for r in warc.captures(records).collect())
    n = len(odd)
    assert got == [(0, "revisit", n, 1), (1, "response", n, None), (3, "revisit", n, 1), (5, "response", 0, None), (6, "revisit", 0, 5),
                   (7, "response", 18, None), (7, "revisit", 18, 7)]
    payloads = {bytes(r.capture.payload).decode() for r in warc.captures(records).collect() if r.capture.payload is not None}
    assert payloads == {odd, "", "é" * 9}
    warc.write_warc(pages, str(tmp_path / "v"), revisit_from_bytes=10_000)
    assert {r.capture.record_type for r in warc.captures(warc.read_warc(spark, str(tmp_path / "v"))).collect()} == {"response"}


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)"])
def test_keys_of_any_type_come_back(spark, tmp_path, kind):
    made = spark.range(9).select(F.col("id"), F.concat(F.lit("p "), F.col("id") % 4).alias("html"), F.lit("http://h/").alias("url"))
    keys = {"string": F.concat(F.lit("k: é\r\n"), "id"), "date": F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")),
            "decimal(20,3)": F.col("id") / 7}
    pages = made.select(keys[kind].cast(kind).alias("Page"), "url", "html").repartition(2)
    found = warc.round_trip(pages, key="Page").collect()
    ids = sorted(r.Page for r in pages.collect())
    assert sorted(r.page_id for r in found) == ids
    assert {r.page_id: r.origin and r.origin.page_id for r in found} == {k: None if i < 4 else ids[i % 4] for i, k in enumerate(ids)}


def test_archives_are_bounded(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("id").cast("string").alias("html"))
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), records_per_archive=30)
    assert len(list((tmp_path / "w").glob("part-*"))) == 4
    assert warc.captures(warc.read_warc(spark, str(tmp_path / "w"))).count() == 40


def test_gzip_members_are_read():
    import gzip
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    assert len(list(warc.parse_records(gzip.compress(record) + gzip.compress(record)))) == 2
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_several_passes_over_a_large_benchmark(spark, docs):
    items = spark.createDataFrame([(i, " ".join(PROSE.split()[10 * i : 10 * i + 14])) for i in range(10)] + [(None, PROSE), (50, None), (51, "a"), (51, "a")], "item_id long, text string")
    one = contamination.find_contamination(docs, items).collect()
    many = contamination.find_contamination(docs, items, max_pattern_bytes=100).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert by_id(one)[7].n_items == 10 and by_id(one)[3].n_hit == 1


def test_shift_tables_find_all_places():
    rng = random.Random(2)
    for size in (1, 2, 3, 5, 10):
        found = [bytes([97 + rng.randrange(2)]) for _ in range(400)]
        patterns = {tuple(rng.choices([b"a", b"b"], k=size)): {str(i)} for i in range(12)}
        got = sorted(contamination.WuManber(patterns, size).search(found))
        assert got == sorted((i, p) for i in range(len(found) - size + 1) for p in patterns if tuple(found[i : i + size]) == p)


def test_automaton_statistics():
    rng = random.Random(4)
    templates = [[bytes([97 + rng.randrange(3)]) for _ in range(30)] for _ in range(4)]
    machine = licenses.SuffixAutomaton(templates)
    inside = {tuple(t[i:j]) for t in templates for i in range(30) for j in range(i + 1, 31)}
    for _ in range(200):
        probe = tuple(bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(1, 9)))
        state = 0
        for token in probe:
            state = machine.next[state].get(token) if state is not None else None
        assert (state is not None) == (probe in inside)
        if state is not None:
            for number, t in enumerate(templates):
                ends = [i + len(probe) - 1 for i in range(30) if tuple(t[i : i + len(probe)]) == probe]
                assert machine.ends[state].get(number, []) == ends


def naive_spans(scanner, found):
    """Spans by comparing every stretch of the text with every place of every template."""
    spans = []
    for number, template in enumerate(scanner.templates):
        longest = []  # at each word, the most words from there on that stand in any template
        for i in range(len(found)):
            n = 0
            while i + n < len(found) and any(
                t[k : k + n + 1] == found[i : i + n + 1] for t in [*scanner.templates, *scanner.phrases] for k in range(len(t) - n)
            ):
                n += 1
            longest.append(n)
        whole = [(i, i + n) for i, n in enumerate(longest) if n >= scanner.min_match and not (i and longest[i - 1] > n)]
        places = [
            (a, b, k) for a, b in whole for k in range(len(template) - (b - a) + 1) if template[k : k + b - a] == found[a:b]
        ]
        run = []
        for place in [*sorted(places), None]:
            if run and (place is None or place[0] - run[-1][1] > scanner.max_gap):
                best = []
                for a, b, k in run:
                    before = [
                        c + min(b - a, k + b - a - e) for (pa, pb, _), (e, c) in zip(run, best)
                        if (pa, pb) != (a, b) and e < k + b - a
                    ]
                    best.append((k + b - a, max([b - a, *before])))
                cover = max(c for _, c in best) / len(template)
                if cover >= scanner.min_cover:
                    spans.append((number, run[0][0], run[-1][1], min(cover, 1.0)))
                run = []
            if place is not None:
                run.append(place)
    return sorted(spans)


def test_spans_equal_a_plain_search():
    rng = random.Random(11)
    word = lambda k: bytes([97 + rng.randrange(k)])
    for trial in range(60):
        kinds = rng.choice([3, 6, 20])
        templates = [[word(kinds) for _ in range(rng.randint(6, 30))] for _ in range(3)]
        for t in templates:  # stretches that stand in a template twice
            if rng.random() < 0.7:
                t += t[: rng.randint(2, 8)] + [word(kinds)]
        scanner = licenses.LicenseScanner(
            phrases=(("zz zz", "z"),), templates=tuple((f"t{i}", b" ".join(t).decode()) for i, t in enumerate(templates)),
            min_match=rng.choice([2, 3, 5]), max_gap=rng.choice([0, 2, 6]), min_cover=rng.choice([0.3, 0.5]),
        )
        found = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            found += t[a : a + rng.randint(1, 20)] + [word(kinds) for _ in range(rng.randrange(4))]
        _, matches = scanner.read(found)
        got = sorted((t, a, b, c) for t, a, b, c in scanner.chain(matches))
        assert got == [(t, a, b, pytest.approx(c)) for t, a, b, c in naive_spans(scanner, found)], trial


def test_a_stretch_counts_where_it_fits(spark):
    template = "one two three four five six alpha beta gamma delta one two three four five six omega psi chi phi"
    rows = [("mine", template), (None, "x"), ("none", None), ("mine", template)]
    templates = licenses.templates_of(spark.createDataFrame(rows, "label string, text string"))
    assert templates == (("mine", template),)
    row = licenses.LicenseScanner(templates=templates).scan(b"five six alpha beta gamma delta QQ one two three four five six RR")
    assert row[5] == "mine" and row[6] == 0.6 and row[7] == ["mine:0:0:13:0.600"]


def test_templates_are_found_in_pieces():
    scanner = licenses.LicenseScanner()
    label, text = licenses.TEMPLATES[0]
    found = text.split()
    broken = " ".join(found[:30] + ["other"] * 5 + found[33:])
    row = scanner.scan(b"before " + broken.encode() + b" after")
    assert label in row[5].split(",") and 0.8 < row[6] < 1 and row[7][0].startswith("mit:0:1:")


def test_inclusion_follows_the_preference(spark):
    """300 sources with the same documents under other ids: how often each is drawn, against its probability."""
    sizes = [5 + 13 * i % 97 for i in range(60)]
    rows = [(r * 1000 + i, f"s{r}", n) for r in range(300) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("like", mixing.brevity(F.col("size")))
    mixed_ = mixing.mix(docs, preference="like", weights=(1.0,), share=0.4)
    likes = [max(1, 1000 // (n + 10)) for n in sizes]
    mean = sum(n * k for n, k in zip(sizes, likes)) / sum(sizes)
    chance = [min(0.999, 0.4 * k / mean) for k in likes]
    drawn, words_ = [0] * len(sizes), {}
    for r in mixed_.collect():
        drawn[r.doc_id % 1000] += r.copies
        words_[r.source] = words_.get(r.source, 0) + r.taken
    assert max(chance) > 3 * min(chance)
    for d, p in zip(drawn, chance):
        assert abs(d / 300 - p) < 4 * math.sqrt(p * (1 - p) / 300) + 0.03
    assert all(abs(w - 0.4 * sum(sizes)) <= max(sizes) for w in words_.values())


def test_decision_list_learns_thresholds():
    rng = np.random.default_rng(0)
    values = {f: rng.random(3000) for f in quality.FEATURES}
    bad = (values["f_dup_lines"] > 0.7) & (values["f_upper"] > 0.2) | (values["f_digits"] > 0.9)
    rules = quality.learn_decision_list(values, bad)
    guess = np.logical_or.reduce([r.holds(values) for r in rules.rules])
    assert (guess == bad).mean() > 0.95 and all(r.precision >= 0.9 for r in rules.rules)


@pytest.mark.parametrize("none_only", [False, True])
def test_pipeline_stages(spark, docs, none, data_dir, none_only):
    current = (none if none_only else docs).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("kept"), F.lit(2).alias("score"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, current, data_dir)
        if name != "mix_sources":
            assert after.columns == current.columns
            assert {(r.kept, r.score) for r in after.collect()} <= {(1, 2)}
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(after.columns)
        current = spark.createDataFrame(after.collect(), after.schema)
        assert none_only == (current.count() == 0)
