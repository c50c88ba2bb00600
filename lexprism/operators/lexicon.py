"""Sentiment word lists, and lexicons of words, phrases and emoji."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IN_TASK_LEXICON_LIMIT = 200_000
SPREAD = 32
SPELLED_AT_ONCE = 512

# Words that strengthen, weaken or negate what follows (Hutto & Gilbert 2014).
STRENGTHENING = tuple(
    (
        "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous "
        "enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin "
        "frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly "
        "hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so "
        "substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very"
    ).split()
)
WEAKENING = tuple(
    (
        "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly "
        "scarce scarcely slight slightly somewhat sorta sortof sort-of"
    ).split()
)
NEGATING = tuple(
    (
        "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont "
        "hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt "
        "needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't "
        "shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite"
    ).split()
)
# Phrases with a value of their own, and phrases that shift what follows (same source).
PHRASES = (
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("bus stop", 0.0), ("yeah right", -2.0),
    ("kiss of death", -1.5), ("to die for", 3.0), ("beating heart", 3.1), ("broken heart", -2.9),
)
PHRASE_BOOSTS = (("just enough", -0.293), ("kind of", -0.293), ("sort of", -0.293))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, valence`` from tab-separated lines: word, mean valence, anything further."""
    lines = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.col("_c0").alias("word"), F.col("_c1").try_cast("double").alias("valence")).dropna()


def read_emoji(spark: SparkSession, path: str) -> DataFrame:
    """``emoji, description`` from tab-separated lines."""
    lines = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.col("_c0").alias("emoji"), F.col("_c1").alias("description")).dropna()


def with_emoji_words(documents: DataFrame, emoji: DataFrame, limit: int = IN_TASK_LEXICON_LIMIT) -> DataFrame:
    """``norm_text`` with every listed emoji (one character) spelled out, a blank before it where there is none.

    Only texts that hold a listed character are visited. At most ``limit``
    emoji, far above the number there is; repeated ones take the last in order.
    """
    rows = emoji.where(F.char_length("emoji") == 1).groupBy("emoji").agg(F.max("description").alias("description")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} emoji")
    told = {r["emoji"]: r["description"] for r in rows}
    if not told:
        return documents

    def spelled(text: str) -> str:
        out, after_blank = [], True
        for c in text:
            if c in told:
                out.append(told[c] if after_blank else " " + told[c])
                after_blank = False
            else:
                out.append(c)
                after_blank = c == " "
        return "".join(out).strip()

    def some(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spelled(t) for t in texts.to_pylist()], pa.string())

    def spell(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            pieces = [some(part.slice(first, SPELLED_AT_ONCE)) for first in range(0, len(part), SPELLED_AT_ONCE)]
            yield pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())

    spell.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    listed = "[" + "".join("\\x{%x}" % ord(c) for c in sorted(told)) + "]"
    holds = F.coalesce(F.col("norm_text").rlike(listed), F.lit(False))
    found = F.arrow_udf(spell, "string")(F.when(holds, F.col("norm_text")))
    return documents.withColumn("norm_text", F.when(holds, found).otherwise(F.col("norm_text")))


def joined_valences(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``valences``, aligned with ``words``; null where a word is not in the lexicon.

    A lexicon too large for the tasks meets the words by shuffle; a common word
    is spread over ``SPREAD`` copies of its entry.
    """
    lexicon = distinct_words(lexicon)
    each = documents.select("doc_key", F.posexplode("words").alias("at", "word"))
    each = each.withColumn("spread", F.pmod(F.xxhash64("doc_key", "at"), F.lit(SPREAD)))
    copies = lexicon.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    found = each.join(copies, ["word", "spread"]).groupBy("doc_key")
    sparse = found.agg(F.map_from_entries(F.collect_list(F.struct("at", "valence"))).alias("by_place"))
    listed = documents.select("doc_key", "words").join(sparse, "doc_key", "left").select(
        "doc_key", F.transform("words", lambda _, i: F.try_element_at("by_place", i)).alias("found")
    )
    valences = listed.select("doc_key", F.col("found").alias("valences"))
    unlisted = F.transform("words", lambda _: F.lit(None).cast("double"))
    return documents.join(valences, "doc_key", "left").withColumn("valences", F.coalesce("valences", unlisted))


def distinct_words(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word").agg(F.max("valence").alias("valence"))


def listed_words(lexicon: DataFrame, limit: int = IN_TASK_LEXICON_LIMIT) -> tuple[list[str] | None, list[float]]:
    """Words and valences of a lexicon of up to ``limit`` words; no words of a larger one."""
    head = distinct_words(lexicon).limit(limit + 1).collect()
    if len(head) > limit:
        return None, []
    return [r["word"] for r in head], [r["valence"] for r in head]
