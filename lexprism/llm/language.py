"""Language identification by compression with one raw-content dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .quality import in_fold

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCUMENTS = 200
SAMPLE_CHARS = 1_000
CHUNK_BYTES = 2_000
LEVEL = 6
MAX_LANGUAGES = 400


def plain(text: str) -> str:
    """Lower-case words with single blanks between them."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def within_share(draw: Column, share: Column) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` (0 to 1) of its whole range."""
    return draw.cast("double") / float(2**64) + 0.5 <= share


def train_languages(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    id_column: str = "doc_id",
    folds: int = 4,
    held_out_fold: int = 2,
    sample_documents: int = SAMPLE_DOCUMENTS,
) -> dict[str, bytes]:
    """A dictionary of at most 64 KB for each language, from documents outside the held-out fold.

    Each language gives about ``sample_documents`` documents of smallest hash
    and of each a stretch of at most a thousand characters from a hashed place, so what the driver holds is
    bounded by the number of languages (at most 400; more are refused). A share
    chosen from the language's own count thins the rows before they are ranked,
    so a language that holds most rows is never ranked whole. Null languages,
    null or letterless texts and null ids are not learned from.
    """
    usable = docs.where(
        F.col(language).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull()
        & ~in_fold(id_column, folds, held_out_fold)
    )
    counts = usable.groupBy(F.col(language).alias("__lang")).agg(F.count("*").alias("n")).orderBy("__lang").take(MAX_LANGUAGES + 1)
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["__lang"], min(1.0, 3.0 * sample_documents / r["n"])) for r in counts], "__lang string, share double")
    draw = F.xxhash64(F.col(id_column).cast("string"), F.lit(5))
    room = F.greatest(F.char_length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substring(F.col(text), (F.pmod(draw, room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    thin = usable.select(F.col(language).alias("__lang"), draw.alias("draw"), part.alias("part"))
    thin = thin.join(F.broadcast(shares), "__lang").where(within_share(F.col("draw"), F.col("share")))
    nearest = thin.groupBy("__lang").agg(F.sort_array(F.collect_list(F.struct("draw", "part"))).alias("parts"))
    nearest = nearest.select("__lang", F.transform(F.slice("parts", 1, sample_documents), lambda p: p["part"]).alias("parts"))
    out = {}
    for row in nearest.collect():
        content = " ".join(plain(p) for p in row["parts"]).encode("utf-8", "surrogatepass")[:DICTIONARY_BYTES]
        if content.strip():
            out[row["__lang"]] = content
    return dict(sorted(out.items()))


_MADE = Memo()


def _compressors(content: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, text in content:
        dictionary = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))
    return made


def sizes(text: str, content: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Compressed bytes of a whole prepared text under each language's dictionary, chunk by chunk."""
    data = text.encode("utf-8", "surrogatepass")
    parts = [data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
    return np.array([sum(len(c.compress(part)) for part in parts) for c in _MADE.made(content, lambda: _compressors(content))], np.int64)


def identify(text: str | None, content: tuple[tuple[str, bytes], ...], least_margin: float) -> tuple[str, float, bool]:
    """(language, score, accepted): the smallest encoding, its lead, and whether that is wide enough."""
    if text is None or not content or next(filter(str.isalpha, text), None) is None:
        return UNKNOWN, 0.0, False
    prepared = plain(text)
    found = sizes(prepared, content)
    order = np.argsort(found, kind="stable")
    best = int(order[0])
    if len(content) == 1:
        return content[best][0], 1.0, True
    lead = int(found[order[1]] - found[best])
    score = float(1.0 / (1.0 + np.exp2(-min(lead, 60) / 2.0)))  # each two bytes of lead double the odds
    return content[best][0], score, lead / float(found[order[1]]) >= least_margin


def predict_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    least_margin: float = 0.02,
) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1) and accepted of every row's whole text.

    Texts are compressed in chunks of 2,000 bytes with each dictionary; the
    smallest sum wins, ties go to the language first in the alphabet.
    ``accepted`` is false where the lead over the second is below
    ``least_margin`` of it. Null texts and texts without a letter are ``und``
    with score 0, as is everything when no language was learned. Rows are
    independent; nothing is shuffled.
    """
    content = tuple(dictionaries.items())
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify(t.as_py(), content, least_margin) for t in batch.column(batch.num_columns - 1)]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            columns = [*batch.columns[:-1], *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    return chosen.mapInArrow(predict, f"{schema}, lang_pred string, score double, accepted boolean")
