"""Text generation as a Spark job over a pluggable provider."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, responses, rules
from ..session import landed, ship_package

# prompts run to half a million characters, so a batch holds few of them
_PROMPTS_PER_SLICE = 16


@dataclass(frozen=True)
class ProviderConfig:
    """Settings of a provider, checked when they are made."""

    model: str
    temperature: float = 0.6
    max_output_tokens: int | None = None
    timeout_seconds: int = 120

    def __post_init__(self) -> None:
        if not self.model or not self.model.strip():
            raise ValueError("model must be set")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must be between 0 and 2")
        if self.max_output_tokens is not None and self.max_output_tokens <= 0:
            raise ValueError("max_output_tokens must be a positive integer when set")


class Provider(Protocol):
    """One that has an ``attempt`` attribute is told there which try of its prompts it is, from 0."""

    def generate(self, prompt: str) -> str: ...


#: Errors of a provider, by the name of their type, that another try may not meet.
TRANSIENT = ("ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "BrokenPipeError", "TimeoutError")


class ExtractiveProvider:
    """Needs no network: the first sentence after each file header, as HTML list items."""

    _HEADER = re.compile(r"^--- File: (.*) ---$", re.MULTILINE)
    _SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")

    def generate(self, prompt: str) -> str:
        pieces = self._HEADER.split(prompt)
        items = []
        for path, body in zip(pieces[1::2], pieces[2::2]):
            sentence = self._SENTENCE.search(body)
            items.append(f"<li>{path}: {sentence.group().strip() if sentence else ''}</li>")
        return f"<p>{len(items)} files, {len(prompt)} characters</p><ul>{''.join(items)}</ul>"


def generate(
    df: DataFrame, provider_factory: Callable[[], Provider], tasks: int | None = None, attempt: int = 0,
) -> DataFrame:
    """Adds raw ``output`` and ``error`` to a frame with a ``prompt`` column, which is dropped.

    One provider per task. A failing row gives an error and never fails the job; a provider that
    cannot be made fails every row of its task the same way. ``tasks`` sets the concurrency, by
    default the number of shuffle partitions: calls are slow and prompts small, so their bytes, by
    which AQE would merge tasks, say nothing about the work.
    """
    ship_package(df.sparkSession)
    kept = [field for field in df.schema.fields if field.name != "prompt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = f"{schema + ', ' if schema else ''}output string, error_kind string, error_detail string"
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, broken = None, None
        try:
            provider = provider_factory()
            if hasattr(provider, "attempt"):
                provider.attempt = attempt
        except Exception as error:  # noqa: BLE001 - reported per row
            broken = (None, "init", str(error))
        for batch in batches:
            for start in range(0, len(batch), _PROMPTS_PER_SLICE):
                part = batch.iloc[start:start + _PROMPTS_PER_SLICE]
                answers = [broken or _answer(provider, prompt) for prompt in part["prompt"]]
                outcome = pd.DataFrame(answers, columns=["output", "error_kind", "error_detail"], index=part.index)
                yield pd.concat([part[names], outcome], axis=1)

    return df.repartition(tasks or shuffle_partitions(df.sparkSession)).mapInPandas(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a candidate-style transport gives back, as JSON.
CANDIDATES = "block_reason string, candidates array<struct<parts: array<string>, finish_reason: string>>, text string"


def chat(
    df: DataFrame, config: ProviderConfig, transport_factory: Callable[[ProviderConfig], Provider],
    tasks: int | None = None, answers: str = "choices",
) -> DataFrame:
    """Like :func:`generate` over a chat endpoint: tasks only carry request JSON out and response JSON in.

    A transport is made from the config, whose timeout it has to keep. Its ``generate`` takes a
    request body and gives the response body; requests are built and responses parsed as Spark
    expressions. ``answers`` is the response's style: ``choices``, or ``candidates`` (JSON of the
    form CANDIDATES, with the text ready). A response without usable text is an api error.
    """
    if answers not in ("choices", "candidates"):
        raise ValueError("answers must be choices or candidates")
    request = prompts.chat_request("prompt", config.model, config.temperature, config.max_output_tokens)
    asked = df.withColumn("prompt", F.when(F.col("prompt") != "", request))
    answered = generate(asked, lambda: transport_factory(config), tasks)
    if answers == "choices":
        parsed = responses.parse_chat_response("output")
    else:
        parsed = responses.parse_candidates(F.from_json("output", CANDIDATES))
    # written here: reading the parsed fields again repeats no call
    answered = landed(answered.withColumn("_parsed", parsed))
    unusable = F.col("error_kind").isNull() & F.col("_parsed.error").isNotNull()
    return answered.withColumns(
        {
            "output": F.col("_parsed.output"),
            "error_kind": F.when(unusable, F.lit("api")).otherwise(F.col("error_kind")),
            "error_detail": F.when(unusable, F.lit("RuntimeError")).otherwise(F.col("error_detail")),
        }
    ).drop("_parsed")


def _answer(provider: Provider, prompt: str | None) -> tuple[str | None, str | None, str | None]:
    if not prompt:
        return None, "empty_text", None
    try:
        return provider.generate(prompt), None, None
    except Exception as error:  # noqa: BLE001 - one bad row must not fail the job
        return None, "api", type(error).__name__


def generate_in_rounds(
    df: DataFrame, key: str, provider_factory: Callable[[], Provider], tasks: int | None = None, attempts: int = 3,
    pause: float = 1.0, transient: tuple[str, ...] = TRANSIENT,
) -> DataFrame:
    """Like :func:`generate` for rows with a unique ``key``, with further rounds for those that met a transient error.

    Each round is written before the next one starts, and holds only rows without an answer yet, so no prompt
    that was answered, or refused for good, is sent again, by a later round, a lost executor or a second reader.
    ``pause`` seconds lie between rounds, doubled each time. After ``attempts`` rounds an error stays an error.
    """
    waiting, done = df, None
    for attempt in range(attempts):
        answers = landed(generate(waiting, provider_factory, tasks, attempt))
        again = F.lit(False) if attempt + 1 == attempts else F.col("error_kind").eqNullSafe("api") & F.col("error_detail").isin(*transient)
        settled = answers.where(~again)
        done = settled if done is None else done.unionByName(settled)
        left = answers.where(again).select(key)
        if attempt + 1 == attempts or not left.limit(1).count():
            break
        waiting = df.join(left, key, "left_semi")
        time.sleep(pause * 2**attempt)
    return done


def generate_distinct(
    df: DataFrame, provider_factory: Callable[[], Provider], tasks: int | None = None, attempts: int = 1, pause: float = 1.0,
) -> DataFrame:
    """Like :func:`generate` with one provider call per distinct prompt; adds prompt_hash and summary.

    The input is evaluated once: prompts are written with their full hash and a row number, one row
    number is picked for each hash from these two columns alone, and only the picked prompts are
    moved. Provider output is written right after the calls and everything else derives from it, so
    neither a lost executor nor a second reader repeats a call. In the join back AQE splits a prompt
    that very many rows share. With several ``attempts`` transient errors are tried again (see
    :func:`generate_in_rounds`).
    """
    keyed = landed(df.withColumn("_sha", prompts.prompt_sha("prompt")).withColumn("_row", F.monotonically_increasing_id()))
    picked = keyed.groupBy("_sha").agg(F.min("_row").alias("_row")).select("_row")
    unique = keyed.select("_row", "_sha", "prompt").join(picked, "_row", "left_semi")
    answers = generate_in_rounds(unique, "_row", provider_factory, tasks, attempts, pause).drop("_row")
    keyed = keyed.drop("_row")
    answers = answers.withColumn("summary", F.when(F.col("error_kind").isNull(), prompts.clean_output("output")))
    answers = answers.drop("output").withColumnRenamed("_sha", "_answered")
    # null-safe, so that a missing prompt gets its error back as well
    joined = keyed.drop("prompt").join(answers, F.col("_sha").eqNullSafe(F.col("_answered")), "left")
    return joined.withColumn("prompt_hash", F.left("_sha", F.lit(rules.PROMPT_HASH_CHARS))).drop("_sha", "_answered")
