"""Prompt guidance, rendering, fingerprints, chat requests and output cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import _col
from .text import strip


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    result = default
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def _or_default(value: Column, default: str) -> Column:
    """Null and '' both take the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def length_guidance(size: Column | str) -> Column:
    key = F.lower(_or_default(_col(size), rules.DEFAULT_SIZE))
    return _lookup(key, rules.LENGTH_GUIDANCE, F.lit(rules.LENGTH_GUIDANCE_OTHER))


def norm_technicality(technicality: Column | str) -> Column:
    key = F.lower(strip(_or_default(_col(technicality), rules.DEFAULT_TECHNICALITY)))
    return _lookup(key, rules.TECHNICALITY_ALIASES, key)


def audience_guidance(technicality: Column | str) -> Column:
    key = norm_technicality(technicality)
    return _lookup(key, rules.AUDIENCE_GUIDANCE, F.lit(rules.AUDIENCE_GUIDANCE_OTHER))


def prompt_from_guidance(lang: Column | str, length: Column | str, audience: Column | str, text: Column | str) -> Column:
    """The template as one concat: the text may hold any character, so no format string."""
    filled = {
        # a null language is printed as Python prints it
        "lang": F.coalesce(_col(lang), F.lit("None")),
        "length": _col(length),
        "audience": _col(audience),
        "text": _col(text),
    }
    pieces = re.split(r"\{(\w+)\}", rules.PROMPT_TEMPLATE)
    return F.concat(*(filled[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def render_prompt(lang: Column | str, size: Column | str, technicality: Column | str, text: Column | str) -> Column:
    return prompt_from_guidance(lang, length_guidance(size), audience_guidance(technicality), text)


def prompt_sha(prompt: Column | str) -> Column:
    return F.sha2(_col(prompt), 256)


def prompt_hash(prompt: Column | str) -> Column:
    """The short fingerprint for display; deduplicate on :func:`prompt_sha`."""
    return F.left(prompt_sha(prompt), F.lit(rules.PROMPT_HASH_CHARS))


def chat_request(prompt: Column | str, model: str, temperature: float = 0.6, max_tokens: int | None = None) -> Column:
    """Request body as JSON; ``max_tokens`` is left out unless set."""
    message = F.struct(F.lit("user").alias("role"), _col(prompt).alias("content"))
    fields = [
        F.lit(model).alias("model"),
        F.array(message).alias("messages"),
        F.lit(temperature).alias("temperature"),
    ]
    if max_tokens is not None:
        fields.append(F.lit(int(max_tokens)).alias("max_tokens"))
    return F.to_json(F.struct(*fields))


def probe_request(model: str) -> Column:
    """The smallest request that shows whether a chat endpoint works."""
    return chat_request(F.lit(rules.PROBE_PROMPT), model, 0, rules.PROBE_MAX_TOKENS)


def clean_output(output: Column | str) -> Column:
    """Strip, then drop one leading fence (```html before ```) and one trailing fence."""
    text = strip(F.coalesce(_col(output), F.lit("")))
    text = F.regexp_replace(text, r"\A```(?:html)?", "")
    return strip(F.regexp_replace(text, r"```\z", ""))
