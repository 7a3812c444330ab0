"""Registered queries: one per operator, each over the whole of the tables it reads."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, paths, prompts, responses, rules, text, urls
from ..operators import ai_stage, assemble, events, generate, history, requests, select
from ..operators.skew import find_hot_keys
from .. import session
from ..session import shared_path
from ..sources import queues, tables, tree
from ..sources.store import HistoryStore
from ..streaming import flow, folds, rates
from . import briefs
from .fixtures import spark_view, table, view_of

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# One parameter set per repository of the test corpus; any other takes the defaults.
REPO_PARAMS = {
    "en": ("en", "small", " Beginner "),
    "de": ("de", "LARGE", "expert"),
    "fr": ("fr", "", "weird"),
}
CREATED = datetime(2024, 2, 1, 12, 0, 0)
ONE_USER = "7"
CHAT_MODEL = "local-model"


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = spark_view(spark, sf_dir, "files")
    return tables.files_from_table(view, "repo_id", "path", "content", "size")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_path_parts(_files(spark, sf_dir))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.capped_places(select.select_files(_files(spark, sf_dir), emitted_only=True))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.build_bundles(_files(spark, sf_dir))


def _repo_param(position: int, default: str) -> Column:
    value = F.lit(default)
    for repo, params in REPO_PARAMS.items():
        value = F.when(F.col("repo_id") == repo, F.lit(params[position])).otherwise(value)
    return value


def _with_prompt(bundles: DataFrame) -> DataFrame:
    lang, size, tech = _repo_param(0, "en"), _repo_param(1, "medium"), _repo_param(2, "technical")
    return bundles.select("repo_id", prompts.render_prompt(lang, size, tech, "text").alias("prompt"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "history")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "status_events")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "requests")


# --- files ---------------------------------------------------------------------------------------

@_query
def q_files(spark, sf_dir):
    return _files(spark, sf_dir).select("repo_id", "path", "size", F.md5("content").alias("content_md5"))


@_query
def q_dir_prune(spark, sf_dir):
    return _files(spark, sf_dir).where(paths.keep_dir("path")).select("repo_id", "path")


@_query
def q_name_prune(spark, sf_dir):
    return _parts(spark, sf_dir).where(paths.keep_name("name")).select("repo_id", "path")


@_query
def q_ext_prune(spark, sf_dir):
    return _parts(spark, sf_dir).where(paths.keep_ext("ext")).select("repo_id", "path")


@_query
def q_size_gate(spark, sf_dir):
    return _files(spark, sf_dir).where(paths.size_ok("size")).select("repo_id", "path", "size")


@_query
def q_binary_sniff(spark, sf_dir):
    """Documents with a NUL put after 1,023 or 1,024 bytes, as files with and without a text suffix."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    nul = F.unhex(F.lit("00"))
    pad = F.encode(F.repeat(F.lit("x"), F.when(kind == 1, 1023).otherwise(1024)), "UTF-8")
    body = F.encode("text", "UTF-8")
    content = F.when(kind.isin(1, 2), F.concat(pad, nul, body)).otherwise(body)
    path = F.concat(F.lit("bin/t"), "doc_id", F.when(F.col("doc_id") % 8 >= 4, F.lit(".py")).otherwise(F.lit("")))
    files = select.with_path_parts(
        docs.select("doc_id", F.col("lang").alias("repo_id"), path.alias("path"), content.alias("content"))
    )
    return files.select("doc_id", "path", select.looks_binary(files).alias("is_binary"))


@_query
def q_decode_text(spark, sf_dir):
    """Document bytes with CRLF line ends, stray bytes in front and behind, and a genuine U+FFFD."""
    docs = table(spark, sf_dir, "documents")
    genuine = F.concat(F.lit("\ufffd"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    noisy = F.concat(F.unhex(F.lit("FFC3")), F.encode(genuine, "UTF-8"), F.unhex(F.lit("E282")))
    content = F.when(F.col("doc_id") % 2 == 0, noisy).otherwise(F.encode(F.col("text"), "UTF-8"))
    decoded = docs.select("doc_id", text.decode_text(content).alias("text"))
    return decoded.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@_query
def q_select(spark, sf_dir):
    return select.select_files(_files(spark, sf_dir)).select("repo_id", "path", "category", "file_class")


@_query
def q_selection_audit(spark, sf_dir):
    return select.selection_audit(_files(spark, sf_dir))


@_query
def q_path_parts(spark, sf_dir):
    parts = paths.path_parts("path")
    return _files(spark, sf_dir).select("path", *(column.alias(name) for name, column in parts.items()))


@_query
def q_important(spark, sf_dir):
    return _parts(spark, sf_dir).select("path", "category")


@_query
def q_class(spark, sf_dir):
    return _parts(spark, sf_dir).select("path", "file_class")


@_query
def q_category_counts(spark, sf_dir):
    return select.category_counts(select.select_files(_files(spark, sf_dir)))


@_query
def q_walk_order(spark, sf_dir):
    return select.walk_positions(_files(spark, sf_dir))


@_query
def q_cap_sources(spark, sf_dir):
    return _capped(spark, sf_dir).select("repo_id", "path", "file_class")


@_query
def q_parse_counts(spark, sf_dir):
    return select.parse_counts(_capped(spark, sf_dir))


@_query
def q_segments(spark, sf_dir):
    segments = assemble.segments(select.texts_at(_files(spark, sf_dir), _capped(spark, sf_dir)))
    return segments.select("repo_id", "path", F.md5("segment").alias("segment_md5"), F.length("segment").cast("long").alias("n"))


@_query
def q_assemble(spark, sf_dir):
    return _bundles(spark, sf_dir).select("repo_id", "text", "total_chars", "truncated")


@_query
def q_assemble_salted(spark, sf_dir):
    """The same in one scan, with every repository split into sub-groups of 20,000 bytes."""
    bundles = briefs.build_bundles(_files(spark, sf_dir), one_scan=True, each=20_000)
    return bundles.select("repo_id", "text", "total_chars", "truncated")


@_query
def q_bundle_metrics(spark, sf_dir):
    lang, size, tech = _repo_param(0, "en"), _repo_param(1, "medium"), _repo_param(2, "technical")
    return assemble.bundle_metrics(_bundles(spark, sf_dir), lang, size, tech)


@_query
def q_blank_route(spark, sf_dir):
    """Every repository of the corpus and one 'none-' twin of each, which has no files."""
    repos = table(spark, sf_dir, "documents").select(F.col("lang").alias("repo_id")).distinct()
    jobs = repos.select(F.explode(F.array("repo_id", F.concat(F.lit("none-"), "repo_id"))).alias("repo_id"))
    return assemble.route_blank(jobs, _bundles(spark, sf_dir))


# --- requests ------------------------------------------------------------------------------------

@_query
def q_requests(spark, sf_dir):
    return requests.checked_requests(_requests(spark, sf_dir)).select(
        "request_id", "url", "lang", "size", "technicality", "reject_reason"
    )


@_query
def q_repo_url(spark, sf_dir):
    return requests.repository_identity(_requests(spark, sf_dir)).select(
        "request_id", "owner", "repo", "canonical_url", F.col("url_error").alias("error")
    )


@_query
def q_redact(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", urls.redact_url("url").alias("url"))


@_query
def q_guidance(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_id",
        prompts.length_guidance("size").alias("length_guidance"),
        prompts.norm_technicality("technicality").alias("technicality"),
        prompts.audience_guidance("technicality").alias("audience_guidance"),
    )


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = requests.validate_requests(_requests(spark, sf_dir))
    return requests.create_jobs(accepted, _history(spark, sf_dir), now=CREATED)


@_query
def q_create_jobs(spark, sf_dir):
    return _created(spark, sf_dir).select(
        "id", "request_id", "repository_url", "created_at", "lang", "size", "technicality", "status"
    )


@_query
def q_compensate(spark, sf_dir):
    """Jobs taken back because their URL names no repository, so that nothing could be queued."""
    jobs = _created(spark, sf_dir)
    failed = requests.repository_identity(jobs, "repository_url").where(F.col("url_error").isNotNull())
    return requests.drop_failed(jobs, failed).select("id", "request_id", "repository_url")


@_query
def q_clone_error(spark, sf_dir):
    """Git's standard error around each document's text, or made of its line breaks alone, with and without a token."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 5
    said = F.coalesce("text", F.lit(""))
    stderr = (
        F.when(kind == 0, F.concat(F.lit("fatal: Authentication failed for 'x'\n"), said))
        .when(kind == 1, F.concat(F.lit("fatal: could not read Username for 'x'\n"), said))
        .when(kind == 2, F.concat(said, F.lit("\nremote: Repository not found.\n")))
        .when(kind == 3, F.concat(F.lit("  "), said, F.lit("\n")))
        .otherwise(F.regexp_replace(said, r"[^\n]+", ""))
    )
    url = F.concat(F.lit("https://tok"), "doc_id", F.lit("@github.com/o/r.git"))
    has_token = F.col("doc_id") % 2 == 0
    return docs.select(
        "doc_id",
        urls.clone_error(stderr, has_token, url, F.lit(128)).alias("error"),
        messages.error_message(F.lit("clone"), stderr).alias("stored_error"),
    )


@_query
def q_rate_flags(spark, sf_dir):
    return requests.rate_flags(_history(spark, sf_dir), guest=1, user=1)


@_query
def q_admission(spark, sf_dir):
    """The history's jobs as requests, of which a user may send two a minute and the guests together one."""
    asked = _history(spark, sf_dir).select("id", "user_id", "created_at")
    return requests.admit(asked, guest=1, user=2)


# --- prompts and responses -----------------------------------------------------------------------

@_query
def q_prompt(spark, sf_dir):
    prompted = _with_prompt(_bundles(spark, sf_dir))
    return prompted.select(
        "repo_id", F.length("prompt").cast("long").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"),
        prompts.prompt_hash("prompt").alias("prompt_hash"),
    )


@_query
def q_chat_request(spark, sf_dir):
    prompted = _with_prompt(_bundles(spark, sf_dir))
    return prompted.select(
        "repo_id",
        F.md5(prompts.chat_request("prompt", CHAT_MODEL, 0.6)).alias("open_md5"),
        F.md5(prompts.chat_request("prompt", CHAT_MODEL, 0.6, 2048)).alias("limited_md5"),
    )


def _chat_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat responses around each model output, in every shape they come in."""
    outputs = spark_view(spark, sf_dir, "model_outputs")
    said = F.to_json(F.struct(F.concat(F.lit(" "), "text", F.lit("\n")).alias("v")))
    quoted = F.expr("substring({0}, 6, length({0}) - 6)".replace("{0}", "_said"))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    body = (
        F.when(kind == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), "_q", F.lit('},"finish_reason":"stop"}]}')))
        .when(kind == 1, F.concat(
            F.lit('{"choices":[{"message":{"content":[{"text":'), "_q", F.lit('},{"type":"x"},7,"end"]},"finish_reason":"length"}]}')))
        .when(kind == 2, F.concat(F.lit('{"choices":[{"message":{"content":"  ","reasoning":'), "_q", F.lit("}}]}")))
        .when(kind == 3, F.lit('{"choices":[]}'))
        .when(kind == 4, F.lit('{"choices":[{"message":{"content":null}}]}'))
        .otherwise(F.concat(F.lit('{"choices":['), "_q"))
    )
    return (
        outputs.withColumn("_said", said).withColumn("_q", quoted)
        .select("conv_id", "turn", kind.alias("kind"), body.alias("body"))
    )


@_query
def q_chat_parse(spark, sf_dir):
    parsed = _chat_bodies(spark, sf_dir).withColumn("p", responses.parse_chat_response("body"))
    return parsed.select("conv_id", "turn", "p.output", "p.finish_reason", "p.error")


@_query
def q_probe_health(spark, sf_dir):
    probed = _chat_bodies(spark, sf_dir).withColumn("p", responses.classify_probe("body"))
    return probed.select("conv_id", "turn", "p.healthy", "p.output_mode", "p.message")


@_query
def q_candidates(spark, sf_dir):
    """Candidate-style responses around each model output."""
    outputs = spark_view(spark, sf_dir, "model_outputs")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    one = F.struct(
        F.when(kind == 1, F.array().cast("array<string>")).otherwise(F.array("output")).alias("parts"),
        F.when(kind == 1, F.lit("MAX_TOKENS")).otherwise(F.lit("STOP")).alias("finish_reason"),
    )
    response = F.struct(
        F.when(kind == 0, F.lit("SAFETY")).alias("block_reason"),
        F.when(kind == 2, F.array().cast("array<struct<parts:array<string>,finish_reason:string>>")).otherwise(F.array(one)).alias("candidates"),
        F.col("output").alias("text"),
    )
    parsed = outputs.withColumn("p", responses.parse_candidates(response))
    return parsed.select("conv_id", "turn", "p.output", "p.finish_reason", "p.error")


@_query
def q_clean_output(spark, sf_dir):
    outputs = spark_view(spark, sf_dir, "model_outputs")
    return outputs.select("conv_id", "turn", prompts.clean_output("output").alias("cleaned"))


@_query
def q_ai_payload(spark, sf_dir):
    """Queue payloads around each model output: whole, without parameters, without id, queue or map."""
    outputs = spark_view(spark, sf_dir, "model_outputs")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    ident = F.when(kind == 3, F.lit(0)).otherwise(F.col("conv_id") + 1).cast("string")
    params = (
        F.when(kind == 0, F.lit('{"lang":"es","size":"small","technicality":"expert"}'))
        .when(kind == 1, F.lit('"none"')).when(kind == 2, F.lit('{"lang":null}')).otherwise(F.lit("null"))
    )
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    words = F.when(kind == 1, F.lit("null")).when(kind == 2, F.lit("42.0")).otherwise(quoted)
    queue = F.when(kind == 4, F.lit('""')).otherwise(F.lit('"results"'))
    payload = F.when(kind == 5, F.lit("[1]")).otherwise(
        F.concat(
            F.lit('{"analysis_id":'), ident, F.lit(',"extracted_text":'), words, F.lit(',"analysis_parameters":'),
            params, F.lit(',"result_queue_name":'), queue, F.lit("}"),
        )
    )
    parsed = outputs.withColumn("p", responses.parse_ai_payload(payload))
    return parsed.select(
        "conv_id", "turn", "p.analysis_id", "p.text", "p.lang", "p.size", "p.technicality", "p.reject_reason"
    )


@_query
def q_generate(spark, sf_dir):
    """One provider call per distinct document text; every document gets its summary back."""
    docs = table(spark, sf_dir, "documents")
    prompted = docs.select("doc_id", text.segment(F.lit("doc.md"), "text").alias("prompt"))
    done = generate.generate_distinct(prompted, generate.ExtractiveProvider)
    return done.select("doc_id", "prompt_hash", "summary", "error_kind")


class FlakyProvider(generate.ExtractiveProvider):
    """Times out on three prompts in four at first, one in four for good, and refuses one in sixteen outright."""

    attempt = 0

    def generate(self, prompt: str) -> str:
        digits = hashlib.md5(prompt.encode()).hexdigest()[:2]
        if digits[1] == "0":
            raise ValueError("refused")
        if int(digits[0], 16) % 4 > self.attempt:
            raise TimeoutError
        return f"<p>attempt {self.attempt}</p>" + super().generate(prompt)


@_query
def q_generate_retry(spark, sf_dir):
    """Document texts to a provider that fails by attempt: three rounds, each for what is still without an answer."""
    docs = table(spark, sf_dir, "documents")
    prompted = docs.select("doc_id", text.segment(F.lit("doc.md"), "text").alias("prompt"))
    done = generate.generate_distinct(prompted, FlakyProvider, attempts=3, pause=0)
    return done.select("doc_id", "prompt_hash", "summary", "error_kind", "error_detail")


# --- history and events --------------------------------------------------------------------------

@_query
def q_history_user(spark, sf_dir):
    return history.history_for_user(_history(spark, sf_dir), ONE_USER)


@_query
def q_history_topk(spark, sf_dir):
    jobs = _history(spark, sf_dir)
    return history.history_topk(jobs, hot=find_hot_keys(jobs, "user_id")).select("user_id", "id", "created_at", "status")


@_query
def q_topk_salted(spark, sf_dir):
    """The same with every user split into sub-groups of five jobs."""
    jobs = _history(spark, sf_dir)
    hot = find_hot_keys(jobs, "user_id", each=5)
    return history.history_topk(jobs, hot=hot).select("user_id", "id", "created_at", "status")


@_query
def q_job_status(spark, sf_dir):
    return history.as_status(_history(spark, sf_dir))


@_query
def q_detail(spark, sf_dir):
    return history.as_detail(_history(spark, sf_dir))


@_query
def q_render(spark, sf_dir):
    return history.render_rows(_history(spark, sf_dir))


@_query
def q_status_counts(spark, sf_dir):
    return history.status_counts(_history(spark, sf_dir))


def _asked(jobs: DataFrame) -> DataFrame:
    """Every job asked for by its owner, by someone else, by a guest, or with an empty user; some are not there."""
    kind = F.col("id") % 4
    user = F.when(kind == 0, F.col("user_id")).when(kind == 1, F.lit("nobody")).when(kind == 3, F.lit(""))
    asked_id = F.when(F.col("id") % 11 == 0, -F.col("id")).otherwise(F.col("id"))
    return jobs.select(F.col("id").alias("request_id"), asked_id.alias("id"), user.alias("user_id"))


@_query
def q_lookup(spark, sf_dir):
    jobs = _history(spark, sf_dir)
    return history.lookup(_asked(jobs), jobs).select("request_id", "id", "found", "repository_url", "status", "not_found_message")


@_query
def q_bucket_lookup(spark, sf_dir):
    """The lookups with history and requests as bucketed tables, joined where they lie."""
    jobs = _history(spark, sf_dir)
    stored = tables.store_bucketed(jobs, shared_path(spark, "bucketed-history"), buckets=16)
    asked = tables.store_bucketed(_asked(jobs), shared_path(spark, "bucketed-requests"), buckets=16)
    return history.lookup(asked, stored).select("request_id", "id", "found", "repository_url", "status", "not_found_message")


@_query
def q_event_validate(spark, sf_dir):
    return events.checked_events(_events(spark, sf_dir)).select("seq", "analysis_id", "status", "reject_reason")


@_query
def q_fold_events(spark, sf_dir):
    return events.fold_events(_events(spark, sf_dir))


@_query
def q_apply_events(spark, sf_dir):
    updated = events.apply_events(_history(spark, sf_dir), events.fold_events(_events(spark, sf_dir)))
    return updated.select("id", "updated_at", "status", "summary", "error")


@_query
def q_orphans(spark, sf_dir):
    folds = events.fold_events(_events(spark, sf_dir))
    return events.orphan_events(folds, _history(spark, sf_dir)).select("analysis_id", "status")


def _error_kind(id_column: str) -> Column:
    kinds = ["clone", "internal", "api", "unexpected", "blank_repository"]
    return F.element_at(F.array(*map(F.lit, kinds)), (F.col(id_column) % 5 + 1).cast("int"))


@_query
def q_stage_events(spark, sf_dir):
    """Each job's outcome by its status: completed, failed in either stage, or still running."""
    kind = _error_kind("id")
    failed = F.col("status") == "FAILED"
    in_repo = kind.isin("clone", "internal", "blank_repository")
    outcomes = _history(spark, sf_dir).select(
        F.col("id").alias("analysis_id"), F.col("updated_at").alias("ts"),
        F.when(failed & in_repo, kind).alias("repo_error_kind"), F.col("error").alias("repo_error_detail"),
        (F.col("status") != "QUEUED").alias("reached_ai"),
        F.when(failed & ~in_repo, kind).alias("ai_error_kind"), F.col("error").alias("ai_error_detail"),
        (F.col("status") == "COMPLETED").alias("finished"), "summary",
    )
    return events.stage_events(outcomes).select("seq", "analysis_id", "status", "message", "summary", "error")


@_query
def q_error_map(spark, sf_dir):
    jobs = _history(spark, sf_dir)
    detail = F.repeat(F.concat("repository_url", F.lit(" ")), 20)
    return jobs.select("id", messages.error_message(_error_kind("id"), detail).alias("error"))


# --- sources, sinks and streams ------------------------------------------------------------------

#: Files of a batch that are in Python at a time; the batch itself stays as Arrow.
_FILES_AT_ONCE = 64


def _write_documents(root: str):
    """Writer of one directory tree per language, one file per document."""

    def write(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _FILES_AT_ONCE):
                rows = batch.slice(start, _FILES_AT_ONCE)
                for repo_id, path, content in zip(*(c.to_pylist() for c in rows.columns)):
                    full = os.path.join(root, repo_id, path)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as stream:
                        stream.write(content.encode("utf-8"))
            yield _repos_of(batch)

    return write


def _repos_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["repo_id"])


@_query
def q_tree_scan(spark, sf_dir):
    """The corpus written out as directory trees, then scanned and selected from the trees."""
    root = shared_path(spark, "trees").removeprefix("file:")
    if "://" in root:
        raise ValueError("trees are read from a mounted file system, and the shared folder is not one")
    session.ship_package(spark)
    written = _files(spark, sf_dir).select("repo_id", "path", "content").mapInArrow(_write_documents(root), "repo_id string")
    repos = session.landed(written.distinct())
    roots = repos.select("repo_id", F.concat(F.lit(root + "/"), "repo_id").alias("root"))
    selected = select.select_files(tree.scan_trees(roots))
    return selected.select("repo_id", "path", "file_class", "size", F.md5("text").alias("text_md5"))


def _write_broken_documents(root: str):
    """Like :func:`_write_documents`, but Go files become links to nothing and ``src/m*.py`` links to themselves."""
    plain = _write_documents(root)

    def write(batches):
        for batch in batches:
            lost = pc.ends_with(batch.column(1), ".go")
            looped = pc.starts_with(batch.column(1), "src/m")
            broken = pc.or_(lost, looped)
            for repo_id, path in zip(*(c.to_pylist() for c in batch.select([0, 1]).filter(broken).columns)):
                full = os.path.join(root, repo_id, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if not os.path.lexists(full):
                    os.symlink(full if path.startswith("src/m") else full + ".gone", full)
            yield _repos_of(batch)
            yield from plain([batch.filter(pc.invert(broken))])

    return write


@_query
def q_tree_errors(spark, sf_dir):
    """Trees with broken entries and a missing root: every good file still comes back, every bad one is named."""
    root = shared_path(spark, "broken-trees").removeprefix("file:")
    if "://" in root:
        raise ValueError("trees are read from a mounted file system, and the shared folder is not one")
    session.ship_package(spark)
    files = _files(spark, sf_dir).select("repo_id", "path", "content")
    repos = session.landed(files.mapInArrow(_write_broken_documents(root), "repo_id string").distinct())
    roots = repos.unionByName(repos.select(F.lit("none").alias("repo_id")).distinct())
    scanned = session.landed(tree.scan_trees(roots.select("repo_id", F.concat(F.lit(root + "/"), "repo_id").alias("root"))))
    good = select.select_files(scanned).select("repo_id", "path", F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("error"))
    kind = F.split_part("read_error", F.lit(":"), F.lit(1)).alias("error")
    bad = tables.read_errors(scanned).select("repo_id", "path", F.lit(None).cast("string").alias("text_md5"), kind)
    return good.unionByName(bad)


@_query
def q_history_append(spark, sf_dir):
    """The history appended to a table in two writes and read back."""
    jobs = _history(spark, sf_dir)
    path = shared_path(spark, "history")
    done = F.col("status").isin(*rules.TERMINAL_STATUSES)
    tables.append_jobs(jobs.where(done), path)
    tables.append_jobs(jobs.where(~done), path)
    return tables.read_history(spark, path)


@_query
def q_history_update(spark, sf_dir):
    """The history stored, its events applied twice, every seventh job taken back, and read again."""
    store = HistoryStore(spark, shared_path(spark, "store"), buckets=8)
    jobs = _history(spark, sf_dir)
    store.put(jobs)
    folds = session.landed(events.fold_events(_events(spark, sf_dir)))
    store.apply(folds)
    store.delete(jobs.where(F.col("id") % 7 == 0).select("id"))
    store.apply(folds)
    return store.read()


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a queue of status events."""
    source = table(spark, sf_dir, "events")
    arriving = queues.read_queue(spark, f"{sf_dir}/events.parquet*", source.schema)
    return view_of(arriving, "status_events")


@_query
def q_stream_queue(spark, sf_dir):
    """Status events passed through a queue: stream in, stream out, read back."""
    path = queues.queue_path(shared_path(spark, "queues"), "results")
    arriving = _event_stream(spark, sf_dir)
    queues.write_queue(arriving, path, shared_path(spark, "queue-state")).awaitTermination()
    return spark.read.schema(arriving.schema).parquet(path).select("seq", "ts", "analysis_id", "status", "summary", "error")


@_query
def q_queue_drain(spark, sf_dir):
    """Status events put into a queue in two goes and taken off it in two passes."""
    queue = queues.queue_path(shared_path(spark, "drained"), "results")
    got, ckpt = shared_path(spark, "taken-events"), shared_path(spark, "drain-state")
    arrived = _events(spark, sf_dir)
    early = F.col("seq") % 3 != 0

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(got, f"batch_id={batch_id}"))

    for part in (arrived.where(early), arrived.where(~early)):
        queues.write_queue(part.repartition(3, "seq"), queue)
        queues.drain_queue(spark, queue, arrived.schema, keep, ckpt, files_per_trigger=2)
    return spark.read.schema(arrived.schema).parquet(got).select("seq", "ts", "analysis_id", "status", "summary", "error")


@_query
def q_stream_fold(spark, sf_dir):
    states = shared_path(spark, "fold-states")
    folds.stream_fold(_event_stream(spark, sf_dir), states, shared_path(spark, "fold-state")).awaitTermination()
    return folds.read_fold(spark, states)


@_query
def q_stream_history(spark, sf_dir):
    """The history stored, its status events merged into it from several batches, all delivered twice."""
    store = HistoryStore(spark, shared_path(spark, "stream-store"), buckets=8)
    store.put(_history(spark, sf_dir))
    queue = queues.queue_path(shared_path(spark, "event-queue"), "results")
    arrived = _events(spark, sf_dir)
    # a file for each of four stretches of events
    queues.write_queue(arrived.repartitionByRange(4, "seq"), queue)
    for delivery in range(2):
        arriving = queues.read_queue(spark, queue, arrived.schema, files_per_trigger=1)
        folds.stream_history(arriving, store, shared_path(spark, f"history-state-{delivery}")).awaitTermination()
    return store.read()


@_query
def q_store_lookup(spark, sf_dir):
    """The same lookups against a stored history."""
    store = HistoryStore(spark, shared_path(spark, "lookup-store"), buckets=64)
    jobs = _history(spark, sf_dir)
    store.put(jobs)
    return store.lookup(_asked(jobs)).select("request_id", "id", "found", "repository_url", "status", "not_found_message")


@_query
def q_stream_terminal(spark, sf_dir):
    path = shared_path(spark, "terminal")
    ended = folds.ended_jobs(_event_stream(spark, sf_dir)).select("analysis_id")
    queues.write_queue(ended, path, shared_path(spark, "terminal-state")).awaitTermination()
    return spark.read.schema(ended.schema).parquet(path)


@_query
def q_stream_rate_flags(spark, sf_dir):
    """Rate flags of the minutes the watermark has closed."""
    source = table(spark, sf_dir, "events")
    arriving = view_of(queues.read_queue(spark, f"{sf_dir}/events.parquet*", source.schema), "history")
    flags = rates.stream_rate_flags(arriving, guest=1, user=1)
    path = shared_path(spark, "rate-flags")
    queues.write_queue(flags, path, shared_path(spark, "rate-state")).awaitTermination()
    return spark.read.schema(flags.schema).parquet(path).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@_query
def q_stream_admission(spark, sf_dir):
    """The same requests, arriving as a stream."""
    source = table(spark, sf_dir, "events")
    arriving = view_of(queues.read_queue(spark, f"{sf_dir}/events.parquet*", source.schema), "history")
    decided = rates.stream_admission(arriving.select("id", "user_id", "created_at"), guest=1, user=2)
    path = shared_path(spark, "admissions")
    queues.write_queue(decided, path, shared_path(spark, "admission-state")).awaitTermination()
    return spark.read.schema(decided.schema).parquet(path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def _brief_requests(spark: SparkSession, sf_dir: str, requests_view: DataFrame) -> DataFrame:
    """Each request asks for one repository of the corpus, or for one that has no files."""
    repos = F.array(*(F.lit(r) for r in (*REPO_PARAMS, "es", "none")))
    return requests_view.withColumn("repo_id", F.element_at(repos, (F.col("request_id") % 5 + 1).cast("int")))


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a table that is read by repository."""
    path = shared_path(spark, "corpus")
    tables.store_files(_files(spark, sf_dir), path)
    return spark.read.parquet(path)


@_query
def q_run_briefs(spark, sf_dir):
    """Every request carried from submission to its finished history row."""
    submitted = _brief_requests(spark, sf_dir, _requests(spark, sf_dir))
    done = briefs.run_briefs(
        spark, submitted, _stored_files(spark, sf_dir), _history(spark, sf_dir), generate.ExtractiveProvider,
        shared_path(spark, "briefs"), now=CREATED,
    )
    return done.history.select("id", "repository_url", "lang", "size", "technicality", "status", F.md5("summary").alias("summary_md5"), "error")


@_query
def q_stream_briefs(spark, sf_dir):
    """The same requests arriving as a stream, with ids from 1."""
    source = table(spark, sf_dir, "pages")
    arriving = view_of(queues.read_queue(spark, f"{sf_dir}/pages.parquet*", source.schema), "requests")
    out = shared_path(spark, "brief-stream")
    flow.stream_briefs(
        _brief_requests(spark, sf_dir, arriving), _stored_files(spark, sf_dir), generate.ExtractiveProvider, out,
        shared_path(spark, "brief-state"),
    ).awaitTermination()
    return flow.read_stream_history(spark, out).select(
        "id", "repository_url", "lang", "size", "technicality", "status", F.md5("summary").alias("summary_md5"), "error"
    )


@_query
def q_stream_rejects(spark, sf_dir):
    """Requests that the stream did not accept, and events that its fold did not."""
    source = table(spark, sf_dir, "pages")
    arriving = view_of(queues.read_queue(spark, f"{sf_dir}/pages.parquet*", source.schema), "requests")
    out = shared_path(spark, "reject-stream")
    flow.stream_briefs(
        _brief_requests(spark, sf_dir, arriving), _stored_files(spark, sf_dir), generate.ExtractiveProvider, out,
        shared_path(spark, "reject-state"),
    ).awaitTermination()
    rejects = shared_path(spark, "rejected-events")
    folds.stream_fold(
        _event_stream(spark, sf_dir), shared_path(spark, "reject-folds"), shared_path(spark, "reject-fold-state"),
        rejects_path=rejects,
    ).awaitTermination()
    requests_ = flow.read_stream_rejects(spark, out).select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), "reject_reason")
    events_ = spark.read.parquet(rejects).select(F.lit("event").alias("kind"), F.col("seq").alias("id"), "reject_reason")
    return requests_.unionByName(events_)


@_query
def q_ai_stage(spark, sf_dir):
    """Model outputs as repository texts: payloads out and in again, blank texts, calls, events."""
    outputs = spark_view(spark, sf_dir, "model_outputs")
    kind = (F.col("conv_id") + F.col("turn")) % 7
    words = F.when(kind == 3, F.lit(" \n ")).otherwise(text.segment(F.lit("turn.md"), "text"))
    ident = F.when(kind == 5, F.lit(0)).otherwise(F.col("conv_id") * 1000 + F.col("turn") + 1)
    size = F.when(kind == 1, F.lit("small")).otherwise(F.lit("medium"))
    payload = responses.ai_payload(ident, words, F.lit("en"), size, F.lit("expert"), F.lit("results"))
    emitted, rejected = ai_stage.run_ai_stage(
        outputs.select(payload.alias("payload")), generate.ExtractiveProvider, F.lit(CREATED).cast("timestamp_ntz")
    )
    refused = rejected.select(
        F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("analysis_id"), F.lit("REJECTED").alias("status"),
        F.lit(None).cast("string").alias("summary"), F.col("reject_reason").alias("error"),
    )
    return emitted.select("seq", "analysis_id", "status", "summary", "error").unionByName(refused)
