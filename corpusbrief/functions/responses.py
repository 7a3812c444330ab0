"""Model responses, probes and queue payloads, parsed as VARIANT without any UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import _col
from .text import strip

_CHOICE = "$.choices[0]"


def _is(variant: Column, kind: str) -> Column:
    """Whether a variant is of a kind (STRING, ARRAY, OBJECT, ...); false for a missing value."""
    return F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit(kind)), F.lit(False))


def _get(variant: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(variant, path, kind)


def _truthy(variant: Column) -> Column:
    """Python truth of a JSON value: null, false, 0, '', [] and {} are false."""
    text = variant.cast("string")
    return (
        variant.isNotNull()
        & ~_is(variant, "VOID")
        & ~(_is(variant, "STRING") & (text == ""))
        & ~(_is(variant, "BOOLEAN") & (text == "false"))
        & ~((_is(variant, "BIGINT") | _is(variant, "DECIMAL") | _is(variant, "DOUBLE"))
            & (text.try_cast("double") == 0))
        & ~text.isin("[]", "{}")
    )


def _printed(value: Column) -> Column:
    """A scalar as Python prints it: a fraction keeps its point (7.0), where a variant drops it."""
    text = value.cast("string")
    return (
        F.when(_is(value, "BOOLEAN"), F.initcap(text))
        .when(_is(value, "DECIMAL") & ~F.contains(text, F.lit(".")), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def _part_text(part: Column) -> Column:
    """An object gives its text field ('' without one), anything else its printed form.

    Lists inside a part are printed as JSON."""
    return (
        F.when(_is(part, "OBJECT"), F.coalesce(_get(part, "$.text", "string"), F.lit("")))
        .when(part.isNull() | _is(part, "VOID"), F.lit("None"))
        .otherwise(_printed(part))
    )


def _content(message_path: str, body: Column) -> tuple[Column, Column, Column]:
    content = _get(body, message_path + ".content")
    parts = _get(body, message_path + ".content", "array<variant>")
    joined = F.array_join(F.transform(parts, _part_text), "")
    # the array test comes first: an array asked for as a string gives its JSON text
    text = (
        F.when(_is(content, "ARRAY"), strip(joined))
        .when(_is(content, "STRING"), strip(content.cast("string")))
    )
    thought = _get(body, message_path + ".reasoning")
    reasoning = F.when(_is(thought, "STRING"), strip(thought.cast("string")))
    return content, text, reasoning


def parse_chat_response(body_json: Column | str) -> Column:
    """struct<output, finish_reason, error> of the first choice.

    Content is a string or a list of parts; empty content falls back to the reasoning text.
    """
    body = F.try_parse_json(_col(body_json))
    choices = _get(body, "$.choices")
    content, text, reasoning = _content(_CHOICE + ".message", body)
    output = F.coalesce(F.nullif(text, F.lit("")), F.nullif(reasoning, F.lit("")))
    odd_content = ~(_is(content, "ARRAY") | _is(content, "STRING")) & _truthy(content)
    odd_part = F.exists(
        _get(body, _CHOICE + ".message.content", "array<variant>"),
        lambda part: _is(part, "OBJECT") & _get(part, "$.text").isNotNull() & ~_is(_get(part, "$.text"), "STRING"),
    )
    error = (
        F.when(~_is(body, "OBJECT"), F.lit("Response is not a JSON object."))
        .when(~F.coalesce(_truthy(choices), F.lit(False)), F.lit(rules.NO_CHOICES))
        .when(F.coalesce(odd_content, F.lit(False)), F.lit("Response content is neither text nor a list."))
        .when(_is(content, "ARRAY") & odd_part, F.lit("Response content part is not text."))
        .when(output.isNull(), F.lit(rules.NO_USABLE_CONTENT))
    )
    return F.struct(
        F.when(error.isNull(), output).alias("output"),
        _get(body, _CHOICE + ".finish_reason", "string").alias("finish_reason"),
        error.alias("error"),
    )


def parse_candidates(response: Column | str) -> Column:
    """struct<output, finish_reason, error> of a candidate-style response.

    Input: struct<block_reason string, candidates array<struct<parts array<string>,
    finish_reason string>>, text string>.
    """
    response = _col(response)
    first = F.get(response["candidates"], F.lit(0))
    finish = F.coalesce(first["finish_reason"], F.lit("UNKNOWN"))
    blocked = F.nullif(response["block_reason"], F.lit(""))
    empty = first.isNull() | (F.coalesce(F.size(first["parts"]), F.lit(0)) <= 0)
    error = F.when(blocked.isNotNull(), F.concat(F.lit(rules.BLOCKED), blocked)).when(
        empty, F.concat(F.lit(rules.NO_CANDIDATE), finish)
    )
    return F.struct(
        F.when(error.isNull(), strip(F.coalesce(response["text"], F.lit("")))).alias("output"),
        finish.alias("finish_reason"),
        error.alias("error"),
    )


def classify_probe(body_json: Column | str, failure: Column | str | None = None) -> Column:
    """struct<healthy, output_mode, message> of a probe's response body.

    ``failure`` is the text of a transport error, null when a response came back.
    """
    body = F.try_parse_json(_col(body_json))
    broken = F.lit(None).cast("string") if failure is None else _col(failure)
    broken = F.coalesce(broken, F.when(~_is(body, "OBJECT"), F.lit("ValueError: response is not a JSON object")))
    content = _get(body, _CHOICE + ".message.content")
    thought = _get(body, _CHOICE + ".message.reasoning")
    said = _is(content, "STRING") & (strip(content.cast("string")) != "")
    listed = _is(content, "ARRAY") & (content.cast("string") != "[]")
    reasoned = _is(thought, "STRING") & (strip(thought.cast("string")) != "")
    said, listed, reasoned = (F.coalesce(flag, F.lit(False)) for flag in (said, listed, reasoned))
    healthy = broken.isNull() & (said | listed | reasoned)
    return F.struct(
        healthy.alias("healthy"),
        F.when(healthy, F.when(reasoned & ~said, F.lit("reasoning")).otherwise(F.lit("content"))).alias("output_mode"),
        F.when(broken.isNotNull(), F.concat(F.lit(rules.PROBE_FAILED), broken))
        .when(healthy, F.lit(rules.PROBE_OK))
        .otherwise(F.lit(rules.PROBE_EMPTY))
        .alias("message"),
    )


def provider_health(
    provider: Column | str, has_key: Column | str, base_url: Column | str, model: Column | str,
    body_json: Column | str, failure: Column | str | None = None,
) -> Column:
    """struct<provider, configured, healthy, output_mode, message> for each provider's settings."""
    name = F.lower(strip(F.coalesce(F.nullif(_col(provider), F.lit("")), F.lit("gemini"))))
    probe = classify_probe(body_json, failure)
    no_url = F.coalesce(_col(base_url), F.lit("")) == ""
    no_model = F.coalesce(_col(model), F.lit("")) == ""
    is_chat, is_keyed = name == "lmstudio", name == "gemini"
    probed = is_chat & ~no_url & ~no_model
    key = F.coalesce(_col(has_key), F.lit(False))
    return F.struct(
        name.alias("provider"),
        (probed | (is_keyed & key)).alias("configured"),
        F.when(probed, probe["healthy"]).otherwise(is_keyed & key).alias("healthy"),
        F.when(probed, probe["output_mode"]).alias("output_mode"),
        F.when(is_chat & no_url, F.lit(rules.PROBE_NO_URL))
        .when(is_chat & no_model, F.lit(rules.PROBE_NO_MODEL))
        .when(is_chat, probe["message"])
        .when(is_keyed & key, F.lit(rules.KEY_PRESENT))
        .when(is_keyed, F.lit(rules.KEY_MISSING))
        .otherwise(F.concat(F.lit("Unsupported AI provider '"), name, F.lit("'.")))
        .alias("message"),
    )


def _param(params: Column, name: str, default: str) -> Column:
    """A missing parameter takes the default, an explicit null stays null."""
    value = _get(params, f"$.{name}")
    return (
        F.when(~_is(params, "OBJECT") | value.isNull(), F.lit(default))
        .when(~_is(value, "VOID"), value.cast("string"))
    )


def ai_payload(
    analysis_id: Column | str, text: Column | str, lang: Column | str, size: Column | str,
    technicality: Column | str, queue: Column | str,
) -> Column:
    """The JSON message that hands a repository's text to the AI stage."""
    parameters = F.struct(_col(lang).alias("lang"), _col(size).alias("size"), _col(technicality).alias("technicality"))
    return F.to_json(
        F.struct(
            _col(analysis_id).alias("analysis_id"), _col(text).alias("extracted_text"),
            parameters.alias("analysis_parameters"), _col(queue).alias("result_queue_name"),
        ),
        {"ignoreNullFields": "false"},
    )


def parse_ai_payload(payload_json: Column | str) -> Column:
    """struct<analysis_id, text, lang, size, technicality, result_queue, reject_reason>."""
    payload = F.try_parse_json(_col(payload_json))
    raw_id = _get(payload, "$.analysis_id")
    queue = _get(payload, "$.result_queue_name")
    text = _get(payload, "$.extracted_text")
    params = _get(payload, "$.analysis_parameters")
    # ids are whole numbers here, also when written as text; all else is rejected rather than bent into one
    whole = ~(_is(raw_id, "BOOLEAN") | _is(raw_id, "ARRAY") | _is(raw_id, "OBJECT"))
    number = F.when(whole, raw_id.cast("string").try_cast("decimal(38,10)"))
    analysis_id = F.when(number == F.floor(number), number.try_cast("bigint"))
    reject = (
        F.when(~_is(payload, "OBJECT"), F.lit("payload is not a map"))
        .when(~F.coalesce(_truthy(raw_id), F.lit(False)), F.lit("missing analysis_id"))
        .when(analysis_id.isNull(), F.lit("analysis_id is not a whole number"))
        .when(~F.coalesce(_truthy(queue), F.lit(False)), F.lit("missing result_queue_name"))
    )
    printed = F.when(text.isNull() | _is(text, "VOID"), F.lit("")).otherwise(_printed(text))
    return F.struct(
        analysis_id.alias("analysis_id"),
        F.when(_is(payload, "OBJECT"), printed).alias("text"),
        _param(params, "lang", rules.DEFAULT_LANG).alias("lang"),
        _param(params, "size", rules.DEFAULT_SIZE).alias("size"),
        _param(params, "technicality", rules.DEFAULT_TECHNICALITY).alias("technicality"),
        queue.cast("string").alias("result_queue"),
        reject.alias("reject_reason"),
    )
