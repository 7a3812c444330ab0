import pytest
from pyspark.sql import functions as F

from corpusbrief.functions import rules
from corpusbrief.operators import generate
from corpusbrief.operators.generate import ExtractiveProvider, ProviderConfig
from corpusbrief.plans.briefs import run_briefs


def test_config_is_checked():
    assert ProviderConfig("m").timeout_seconds == 120
    for bad in ({"model": " "}, {"model": "m", "temperature": 2.1}, {"model": "m", "max_output_tokens": 0}):
        with pytest.raises(ValueError):
            ProviderConfig(**bad)


def test_bad_rows_do_not_fail_the_job(spark):
    class Picky:
        def generate(self, prompt):
            if "bad" in prompt:
                raise KeyError("x")
            return f"```html\n{prompt.upper()}```"

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "")], "id long, prompt string")
    got = {r.id: (r.output, r.error_kind, r.error_detail) for r in generate.generate(df, Picky, tasks=2).collect()}
    assert got == {1: ("```html\nOK```", None, None), 2: (None, "api", "KeyError"), 3: (None, "empty_text", None), 4: (None, "empty_text", None)}
    cleaned = {r.id: (r.summary, r.error_kind) for r in generate.generate_distinct(df, Picky).collect()}
    assert cleaned == {1: ("OK", None), 2: (None, "api"), 3: (None, "empty_text"), 4: (None, "empty_text")}


def test_provider_that_cannot_be_made(spark):
    def broken():
        raise RuntimeError("no key")

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {(r.error_kind, r.error_detail) for r in generate.generate(df, broken).collect()} == {("init", "no key")}


def test_one_call_per_distinct_prompt(spark, tmp_path):
    log = str(tmp_path)

    class Logging:
        def generate(self, prompt):
            import os
            import uuid

            open(os.path.join(log, uuid.uuid4().hex), "w").close()
            return prompt

    df = spark.range(60).select("id", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("prompt"))
    got = generate.generate_distinct(df, Logging).collect()
    assert len(got) == 60 and all(r.summary == f"p{r.id % 3}" and len(r.prompt_hash) == 16 for r in got)
    assert len(list(tmp_path.iterdir())) == 3


def test_chat_transport(spark):
    class Echo:
        def __init__(self, config):
            self.timeout = config.timeout_seconds

        def generate(self, body):
            import json

            assert self.timeout == 120
            asked = json.loads(body)
            assert asked["model"] == "m" and asked["max_tokens"] == 9
            text = asked["messages"][0]["content"]
            if text == "down":
                raise ConnectionError
            return json.dumps({"choices": [] if text == "none" else [{"message": {"content": [{"text": text}, "!"]}}]})

    df = spark.createDataFrame([(1, "hi"), (2, "none"), (3, "down"), (4, None)], "id long, prompt string")
    got = generate.chat(df, ProviderConfig("m", max_output_tokens=9), Echo).collect()
    assert {r.id: (r.output, r.error_kind, r.error_detail) for r in got} == {
        1: ("hi!", None, None), 2: (None, "api", "RuntimeError"), 3: (None, "api", "ConnectionError"), 4: (None, "empty_text", None)}


def test_candidate_transport(spark):
    class Candidates:
        def __init__(self, config):
            self.config = config

        def generate(self, body):
            import json

            text = json.loads(body)["messages"][0]["content"]
            if text == "blocked":
                return json.dumps({"block_reason": "SAFETY"})
            return json.dumps({"candidates": [{"parts": [text], "finish_reason": "STOP"}], "text": f" {text}! "})

    df = spark.createDataFrame([(1, "hi"), (2, "blocked")], "id long, prompt string")
    got = generate.chat(df, ProviderConfig("m"), Candidates, answers="candidates").collect()
    assert {r.id: (r.output, r.error_kind, r.error_detail) for r in got} == {1: ("hi!", None, None), 2: (None, "api", "RuntimeError")}
    with pytest.raises(ValueError):
        generate.chat(df, ProviderConfig("m"), Candidates, answers="other")


def test_extractive_provider():
    text = "--- File: a.md ---\nFirst one. Second.\n\n--- File: b.py ---\nx = 1\n\n"
    assert ExtractiveProvider().generate(text) == f"<p>2 files, {len(text)} characters</p><ul><li>a.md: First one.</li><li>b.py: x = 1</li></ul>"


def test_requests_to_history(spark, tmp_path):
    files = spark.createDataFrame(
        [("r1", "README.md", 20, "Hello there. More it"), ("r1", "a.py", 10, "print(1)\n#"), ("r2", "x.png", 10, "0123456789")],
        "repo_id string, path string, size long, content string")
    submitted = spark.createDataFrame(
        [(1, "https://github.com/o/r1", "r1", None, None, None, "u"), (2, "https://github.com/o/r1", "r1", "en", "", "Intermediate", None),
         (3, "https://github.com/o/r2", "r2", "en", "small", "expert", "u"), (4, "nope", "r1", None, None, None, None),
         (5, "https://github.com/o/r3", "r3", None, None, None, None)],
        "request_id long, url string, repo_id string, lang string, size string, technicality string, user_id string")
    done = run_briefs(spark, submitted, files, None, ExtractiveProvider, str(tmp_path / "work"))
    rows = {r.id: r for r in done.history.collect()}
    assert {i: r.status for i, r in rows.items()} == {1: "COMPLETED", 2: "COMPLETED", 3: "FAILED", 4: "FAILED"}
    assert rows[1].summary == rows[2].summary and "README.md: Hello there." in rows[1].summary
    assert rows[3].error == rows[4].error == rules.BLANK_REPOSITORY
    assert [r.request_id for r in done.rejected.collect()] == [4]
    assert done.events.where("analysis_id = 1").count() == 3
    again = run_briefs(spark, submitted, files, done.history, ExtractiveProvider, str(tmp_path / "next"))
    assert sorted(r.id for r in again.jobs.collect()) == [5, 6, 7, 8]


def test_empty_batch(spark, tmp_path):
    files = spark.createDataFrame([], "repo_id string, path string, size long, content string")
    schema = "request_id long, url string, repo_id string, lang string, size string, technicality string"
    done = run_briefs(spark, spark.createDataFrame([], schema), files, None, ExtractiveProvider, str(tmp_path / "work"))
    assert done.history.count() == done.events.count() == done.bundles.count() == 0


def test_no_call_is_repeated_by_later_readers(spark, tmp_path):
    log = str(tmp_path)

    class Logging:
        def generate(self, prompt):
            import os
            import uuid

            open(os.path.join(log, uuid.uuid4().hex), "w").close()
            return prompt

    df = spark.range(20).select("id", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("prompt"))
    done = generate.generate_distinct(df, Logging)
    failing = F.when(F.col("id") == 7, F.raise_error(F.lit("later stage"))).otherwise(F.col("summary"))
    with pytest.raises(Exception, match="later stage"):
        done.select(failing.alias("x")).collect()
    assert done.count() == 20 and done.where("id > 3").count() == 16
    assert len(list(tmp_path.iterdir())) == 4
    assert "MapInPandas" not in done._jdf.queryExecution().executedPlan().toString()


def test_transient_errors_are_tried_again_and_answers_are_not(spark, tmp_path):
    log = str(tmp_path)

    class Failing:
        attempt = 0

        def generate(self, prompt):
            import os
            import uuid

            open(os.path.join(log, f"{prompt}-{self.attempt}-{uuid.uuid4().hex}"), "w").close()
            if prompt == "p3":
                raise KeyError
            if int(prompt[1:]) > self.attempt:
                raise TimeoutError
            return f"{prompt} at {self.attempt}"

    df = spark.range(50).select("id", F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("prompt"))
    done = generate.generate_distinct(df, Failing, attempts=3, pause=0)
    got = {r.id % 5: (r.summary, r.error_detail) for r in done.collect()}
    assert done.count() == 50
    assert got == {0: ("p0 at 0", None), 1: ("p1 at 1", None), 2: ("p2 at 2", None), 3: (None, "KeyError"), 4: (None, "TimeoutError")}
    calls = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert calls == sorted(["p0-0", "p1-0", "p1-1", "p2-0", "p2-1", "p2-2", "p3-0", "p4-0", "p4-1", "p4-2"])
    assert generate.generate_distinct(df.limit(0), Failing, attempts=3, pause=0).count() == 0
