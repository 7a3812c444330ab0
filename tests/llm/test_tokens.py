"""Token counts against the library on every text, and what the cache does and does not encode."""

import json

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from corpusbrief.llm import queries, tokens
from tests.llm.test_edges import ROWS, SCHEMA


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(model, rows):
    out = []
    for doc, text in rows:
        n = len(model.encode(text or ""))
        out.append((doc, len((text or "").encode()), n, n > 4096))
    return sorted(out, key=repr)


def test_query_equals_the_library(spark, data_dir, model):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_token_counts"](spark, data_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(model, rows)


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (4, "")], "doc_id long, text string")
    tokens.count_tokens(first, cache=cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2  # one text and the empty one
    # a stored count is taken as it is: nothing is encoded again
    version = stored.first().version
    planted = spark.createDataFrame([("5" * 64, 7)], "digest string, n_tokens long").withColumn("version", F.lit(version))
    tokens_of_other = spark.createDataFrame([("other text",)], "text string").select(F.sha2("text", 256).alias("digest"))
    planted.crossJoin(tokens_of_other.withColumnRenamed("digest", "d")).select(
        F.col("d").alias("digest"), F.lit(9_999).cast("long").alias("n_tokens"), "version"
    ).write.mode("append").partitionBy("version").parquet(cache)
    second = spark.createDataFrame([(1, "one text"), (5, "other text"), (6, "new text")], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(second, cache=cache).collect()}
    assert got[5].n_tokens == 9_999 and got[5].over_limit
    assert spark.read.parquet(cache).count() == 4
    # a run that stores a text again, as a repeated job or a second writer may, changes nothing
    spark.read.parquet(cache).write.mode("append").partitionBy("version").parquet(str(tmp_path / "twice"))
    spark.read.parquet(cache).write.mode("append").partitionBy("version").parquet(str(tmp_path / "twice"))
    again = tokens.count_tokens(second, cache=str(tmp_path / "twice")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))


def test_versions_do_not_mix(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Some words, <|endoftext|> and more.")], "doc_id long, text string")
    counts = {}
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        counts[name] = tokens.count_tokens(docs, path, cache).first().n_tokens
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert counts["byte_bpe_50k.json"] == len(library.encode("Some words, <|endoftext|> and more.", add_special_tokens=False))
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    # settings in the file do not cut or pad
    changed = json.loads(library.to_str())
    changed["truncation"] = {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}
    other = tmp_path / "cut.json"
    other.write_text(json.dumps(changed))
    assert tokens.count_tokens(docs, str(other), cache).first().n_tokens == counts["byte_bpe_50k.json"]
    assert spark.read.parquet(cache).select("version").distinct().count() == 3


def test_nulls_long_texts_repeats_empty_tables_and_clashing_names(spark, model):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"N_Tokens": F.lit("x"), "digest": F.lit(1), "content": F.lit(2), "version": F.lit(3)})
    got = tokens.count_tokens(docs.repartition(3))
    assert got.columns == [c for c in docs.columns if c != "N_Tokens"] + ["n_bytes", "n_tokens", "over_limit"]
    rows = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()), key=repr)
    assert rows == expected(model, [(r[0], r[1]) for r in ROWS])
    empty = tokens.count_tokens(docs.where("false"))
    assert empty.collect() == [] and empty.columns == got.columns
