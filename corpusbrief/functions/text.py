"""Text scalars with Python semantics: strip, blankness, decoding, binary sniff, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import _col

_REPLACEMENT = "\ufffd"
_ESCAPE = "\ue000"


def strip(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(rules.WHITESPACE))


def is_blank(value: Column | str) -> Column:
    """Null or nothing but whitespace; stops at the first other character."""
    value = _col(value)
    return value.isNull() | ~value.rlike(f"[^{rules.WHITESPACE}]")


def universal_newlines(value: Column | str) -> Column:
    crlf = F.replace(_col(value), F.lit("\r\n"), F.lit("\n"))
    return F.replace(crlf, F.lit("\r"), F.lit("\n"))


def drop_invalid_utf8(content: Column | str) -> Column:
    """Bytes to string, leaving out the bytes that are not UTF-8.

    ``make_valid_utf8`` marks bad bytes with U+FFFD. Genuine U+FFFD characters are escaped first,
    so that removing the marks loses none of them; no Python worker is involved.
    """
    raw = _col(content).cast("string")
    escaped = F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "0"))
    escaped = F.replace(escaped, F.lit(_REPLACEMENT), F.lit(_ESCAPE + "1"))
    kept = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    kept = F.replace(kept, F.lit(_ESCAPE + "1"), F.lit(_REPLACEMENT))
    kept = F.replace(kept, F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(kept)


def decode_text(content: Column | str) -> Column:
    return universal_newlines(drop_invalid_utf8(content))


def decodes_to_text(content: Column | str) -> Column:
    """Whether any character is left after decoding; valid UTF-8 is not decoded to find out."""
    content = _col(content)
    valid = F.is_valid_utf8(content.cast("string"))
    return (F.octet_length(content) > 0) & (valid | (drop_invalid_utf8(content) != ""))


def is_binary(content: Column | str, marker: bytes = b"\0") -> Column:
    """The marker occurs in the first 1,024 bytes."""
    head = F.substring(_col(content).cast("binary"), 1, rules.SNIFF_BYTES)
    return F.contains(head, F.lit(bytearray(marker)))


def segment(path: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.lit(rules.SEGMENT_HEAD), _col(path), F.lit(rules.SEGMENT_MID), _col(text),
        F.lit(rules.SEGMENT_TAIL),
    )


def segment_chars(path: Column | str, text: Column | str) -> Column:
    """Length of :func:`segment` without building it."""
    fixed = len(rules.SEGMENT_HEAD) + len(rules.SEGMENT_MID) + len(rules.SEGMENT_TAIL)
    return (F.length(_col(path)) + F.length(_col(text)) + F.lit(fixed)).cast("long")
