"""Text preparation as column expressions.

Only Unicode normalisation, entity decoding, case folding and accent removal
have no JVM function; they run as Arrow-batched Python, and only on the rows
that need them: a text of ASCII, plain Latin letters, dashes and quotation
marks without ``&`` passes through JVM expressions alone.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind
from .stopwords import ENGLISH

# Patterns that decide tokens, contact flags and masks.
TOKEN = r"(?<![\p{L}\p{N}_])[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'-]*[\p{L}\p{N}_]"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?iU)\b(?:https?://|www\.)\S+\b"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\d .()/-]{6,}\d)(?!\w)"
ASCII_TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_'-]*[A-Za-z0-9_]"  # what TOKEN finds in an ASCII text
ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
SNIPPET_LIMIT = 360
SNIPPET_CUT = 357
# Characters beyond ASCII that may change under NFKC, combine, count as white space or have a longer lower case. Left out
# are Latin letters, dashes and quotation marks that do none of this; ranges only, since Java matches these fast.
UNUSUAL = r"[\x80-\xBE\u0100-\u2012\u2015-\u2017\u201A-\u201B\u201E-\x{10FFFF}]"
ACCENTED, UNACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
CONVERTED_AT_ONCE = 512


def _clean(text: str) -> str:
    decoded = unicodedata.normalize("NFKC", html.unescape(text))
    return " ".join(decoded.split())


def _without_accents(text: str) -> str | None:
    cleaned = _clean(text)
    if not cleaned:
        return None
    split = unicodedata.normalize("NFKD", cleaned.lower())
    for mark in filter(unicodedata.combining, set(split)):
        split = split.replace(mark, "")
    return split


def _folded(text: str) -> str:
    return _clean(text).casefold()


def _as_udf(convert: Callable[[str], str | None]):
    """An Arrow-batched function the optimizer may neither repeat nor move below a repartition.

    Without the mark, a filter on its result would be pushed to the scan and
    the conversion run once there and once above.
    """

    def some(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else convert(text) for text in texts.to_pylist()], pa.string())

    def batch(texts: pa.Array) -> pa.Array:
        parts = [some(texts.slice(first, CONVERTED_AT_ONCE)) for first in range(0, len(texts), CONVERTED_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "string").asNondeterministic()


def _single_spaced(raw: Column) -> Column:
    """ASCII white space collapsed and trimmed; plain replacements outrun a pattern here."""
    spaced = raw
    for mark in ASCII_SPACES:
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    doubled = lambda s: F.contains(s, F.lit("  "))
    return bind(spaced, lambda s: F.trim(F.when(doubled(s), F.regexp_replace(s, " {2,}", " ")).otherwise(s)))


def _prepared(text: Column | str, convert: Callable[[str], str | None], plain_form: Callable[[Column], Column]) -> Column:
    raw = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    needs_python = F.contains(raw, F.lit("&")) | (~_ascii(raw) & raw.rlike(UNUSUAL))
    plain = plain_form(_single_spaced(raw))
    return F.when(needs_python, _as_udf(convert)(F.when(needs_python, raw))).otherwise(plain)


def normalized(text: Column | str) -> Column:
    """Entities decoded, NFKC, whitespace collapsed and trimmed; null becomes ''."""
    return _prepared(text, _clean, lambda c: c)


def lexical(text: Column | str) -> Column:
    """Normalised text, lower case, without accents: the input of tokenisation; null where blank."""

    def plain(text: Column) -> Column:
        lowered = bind(text, lambda s: F.lower(F.nullif(s, F.lit(""))))
        return bind(lowered, lambda s: F.when(_ascii(s), s).otherwise(F.translate(s, ACCENTED, UNACCENTED)))

    return _prepared(text, _without_accents, plain)


def folded(text: Column | str) -> Column:
    """Normalised text under full case folding: the key of sentiment duplicates."""
    return _prepared(text, _folded, lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def has_email(norm: Column | str) -> Column:
    norm = F.col(norm) if isinstance(norm, str) else norm
    return F.contains(norm, F.lit("@")) & norm.rlike(EMAIL)


def _ascii(norm: Column) -> Column:
    return F.octet_length(norm) == F.char_length(norm)


def _url_begun(norm: Column) -> Column:
    return F.contains(norm, F.lit("://")) | F.contains(F.lower(norm), F.lit("www."))


def has_phone(norm: Column | str) -> Column:
    """ASCII texts need no Unicode classes, which are slow to match."""
    norm = F.col(norm) if isinstance(norm, str) else norm
    return F.when(_ascii(norm), norm.rlike(PHONE.removeprefix("(?U)"))).otherwise(norm.rlike(PHONE))


def has_url(norm: Column | str) -> Column:
    """Only texts with one of the two beginnings are searched."""
    norm = F.col(norm) if isinstance(norm, str) else norm
    return _url_begun(norm) & norm.rlike(URL)


def masked(norm: Column | str) -> Column:
    """Normalised text with emails, then URLs, then phone numbers replaced.

    Each is looked for only in texts that can hold it; a mask put in makes none of the later ones possible.
    """
    norm = F.col(norm) if isinstance(norm, str) else norm
    out = F.when(F.contains(norm, F.lit("@")), F.regexp_replace(norm, EMAIL, "[EMAIL]")).otherwise(norm)
    out = F.when(_url_begun(norm), F.regexp_replace(out, URL, "[URL]")).otherwise(out)
    plain = F.regexp_replace(out, PHONE.removeprefix("(?U)"), "[PHONE]")
    return F.when(_ascii(norm), plain).otherwise(F.regexp_replace(out, PHONE, "[PHONE]"))


def snippet(norm: Column | str) -> Column:
    out = masked(norm)
    cut = F.concat(F.rtrim(F.substring(out, 1, SNIPPET_CUT)), F.lit("..."))
    return F.when(F.length(out) > SNIPPET_LIMIT, cut).otherwise(out)


def word_count(norm: Column | str) -> Column:
    norm = F.col(norm) if isinstance(norm, str) else norm
    return F.when(_ascii(norm), F.regexp_count(norm, F.lit(ASCII_TOKEN))).otherwise(F.regexp_count(norm, F.lit(TOKEN)))


def tokens(lexical_text: Column | str) -> Column:
    text = F.col(lexical_text) if isinstance(lexical_text, str) else lexical_text
    found = lambda s, pattern: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return bind(text, lambda s: F.when(_ascii(s), found(s, ASCII_TOKEN)).otherwise(found(s, TOKEN)))


def english_stopwords() -> tuple[str, ...]:
    """Spark's own English list."""
    return tuple(ENGLISH)


def stopword_list(english: Iterable[str], custom: Iterable[str]) -> list[str]:
    own = (str(word).strip().casefold() for word in custom)
    return sorted(set(english) | {word for word in own if word})


def without_stopwords(token_array: Column | str, stopwords: list[str]) -> Column:
    if not stopwords:
        return F.col(token_array) if isinstance(token_array, str) else token_array
    return F.filter(token_array, lambda token: ~token.isin(stopwords))


def bigrams(token_array: Column | str) -> Column:
    """Adjacent pairs after stopword removal; empty for fewer than two tokens."""
    array = F.col(token_array) if isinstance(token_array, str) else token_array
    pairs = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(
        F.slice(array, F.lit(1), pairs),
        F.slice(array, F.lit(2), pairs),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def group_label(column: Column | str) -> Column:
    """Trimmed label; null and blank labels become '', which is no level."""
    return F.coalesce(trimmed((F.col(column) if isinstance(column, str) else column).cast("string")), F.lit(""))


def trimmed(column: Column) -> Column:
    """Strip every kind of white space from both ends, not just blanks."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
