"""Language ID by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .texts import LOWER, fraction, table_operator, with_text_columns

UNDETERMINED = "und"
FIELDS = {"lang_pred": "string", "score": "double", "margin_bytes": "long", "rejected": "boolean"}
#: Languages that get a dictionary, the most frequent ones first.
LANGUAGES = 1_000
#: Share of its bytes by which a text must be shorter with the best dictionary than with the next one. Chosen on the
#: learnable rows: right answers lie above it, wrong ones, noise and languages without a dictionary below.
MIN_SHARE = 0.04


@dataclass(frozen=True)
class Dictionaries:
    """Raw-content dictionaries by language; at most 4 x languages x texts x piece bytes."""

    contents: tuple[tuple[str, bytes], ...]
    level: int = 6
    chunk: int = 2048


def fit_dictionaries(
    labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
    texts: int = 600, piece: int = 512, level: int = 6, chunk: int = 2048, languages: int = LANGUAGES,
) -> Dictionaries:
    """Fit one dictionary for each language on a bounded sample of the labelled rows.

    The sample holds up to ``texts`` rows of each language, those with the smallest hash of key and text, and of
    each ``piece`` characters from a place that the hash draws, so that every part of a text can be learned from; a
    dictionary has at most 4 * texts * piece bytes. The languages are counted first, so that only about four times as many
    rows are ranked, however large the table is. Rows with a null text or language are not used; repeated pieces count
    once. Of more than ``languages`` languages the most frequent ones are learned (ties: by name).
    """
    usable = labelled.where(F.col(lang).isNotNull())
    counted = usable.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang")
    counts = counted.limit(languages).collect()
    if not counts:
        return Dictionaries((), level, chunk)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 4 * texts / r["count"])])
    draw = fraction(F.col(key), F.col(text))
    place = fraction(F.col(key), F.col(text), F.lit("place"))
    start = (F.floor(place * F.greatest(F.length(text) - piece + 1, F.lit(1))) + 1).cast("int")
    drawn = W.partitionBy("__lang").orderBy("__draw", "__piece")
    sample = (
        usable.where((F.length(text) > 0) & (draw < F.element_at(shares, F.col(lang))))
        .select(F.col(lang).alias("__lang"), F.substr(F.col(text), start, F.lit(piece)).alias("__piece"), draw.alias("__draw"))
        .withColumn("__rank", F.row_number().over(drawn)).where(F.col("__rank") <= texts)
    )
    pieces: dict[str, dict[bytes, None]] = {}
    for row in sample.orderBy("__lang", "__rank").toLocalIterator():
        pieces.setdefault(row["__lang"], {})[row["__piece"].encode().translate(LOWER)] = None
    contents = tuple((name, b"\n".join(found)) for name, found in sorted(pieces.items()))
    return Dictionaries(contents, level, chunk)


_LETTER = re.compile(rb"[A-Za-z]")
_compressors: dict[Dictionaries, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _compressors_of(model: Dictionaries) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """Made once for each Python worker."""
    if model not in _compressors:
        _compressors.clear()
        made = []
        for name, content in model.contents:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=model.level)
            made.append((name, zstandard.ZstdCompressor(
                level=model.level, dict_data=dictionary, write_content_size=False, write_dict_id=False
            )))
        _compressors[model] = made
    return _compressors[model]


def encoded_sizes(model: Dictionaries, text: bytes) -> list[tuple[int, str]]:
    """Bytes that each language's dictionary needs for the whole text, smallest first."""
    text = text.translate(LOWER)
    chunks = [text[i : i + model.chunk] for i in range(0, len(text), model.chunk)]
    return sorted((sum(len(c.compress(x)) for x in chunks), name) for name, c in _compressors_of(model))


def judge(model: Dictionaries, text: bytes | None, min_share: float = MIN_SHARE) -> tuple[str, float, int, bool]:
    if text is None or not model.contents or not has_letter(text):
        return UNDETERMINED, 0.0, 0, True
    sizes = encoded_sizes(model, text)
    best, second = sizes[0], sizes[1] if len(sizes) > 1 else (2 * sizes[0][0], "")
    margin = second[0] - best[0]
    return best[1], margin / second[0], margin, margin < min_share * second[0] or not margin


@table_operator(FIELDS)
def identify(docs: DataFrame, model: Dictionaries, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Add lang_pred, score (share of bytes saved against the runner-up, 0 to 1), margin_bytes and rejected.

    The whole text is encoded, in chunks that each start from the dictionary, so that the text's own repeats
    don't hide the dictionary's part. ``rejected``: the score is under ``min_share``, or a tie, or there is nothing to judge.
    Null text, a text without a letter, or no learned language: und, score 0, rejected. Ties go to the language
    name that sorts first. Repeated rows get the same answer; columns with these names are replaced, all others
    stay; an empty table stays empty.
    """
    return with_text_columns(docs, text, FIELDS, lambda t: judge(model, t, min_share))
