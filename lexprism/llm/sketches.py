"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A sketch keeps every shingle hash below a fixed part of the hash range. It so
grows with its document, sketches of parts merge into that of the whole, and
the part of one document found in another is read off however unequal they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

LOWEST = -(2**63)
WORDS_EACH = 5
KEPT_PART = 4  # one hash in so many


def with_sketch(df: DataFrame, text: str, name: str, words_each: int = WORDS_EACH, kept_part: int = KEPT_PART) -> DataFrame:
    """``df`` with the sketch of a text column: ascending 64-bit hashes as array<long>.

    Shingles are runs of ``words_each`` words at ASCII white space; fewer words
    make one shingle, none (also null) an empty sketch. Where no hash falls below
    the bar, the smallest stands for the text, so that only texts without words
    have no hash.
    """
    words, hashes = f"__{name}_words", f"__{name}_hashes"
    bar = LOWEST + 2**64 // kept_part
    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    shingle = F.transform(
        F.sequence(F.lit(0), F.size(words) - words_each),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(words_each)]),
    )
    one = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn(words, split)
    out = out.withColumn(hashes, F.when(F.size(words) >= words_each, shingle).otherwise(one))
    below = f"__{name}_below"
    out = out.withColumn(below, F.filter(hashes, lambda h: h < F.lit(bar)))
    lone = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.col(hashes))
    sketch = F.when(F.size(below) > 0, F.sort_array(F.array_distinct(below))).otherwise(lone)
    return out.withColumn(name, sketch).drop(words, hashes, below)


def merged_sketch(left: Column, right: Column, kept_part: int = KEPT_PART) -> Column:
    """The sketch of two sets of shingles together, from their sketches."""
    bar = LOWEST + 2**64 // kept_part
    both = F.sort_array(F.array_union(left, right))
    below = F.filter(both, lambda h: h < F.lit(bar))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def resemblance(left: Column, right: Column) -> Column:
    """Estimated part of all shingles that both have (0 to 1); 1 where neither has any."""
    together = F.size(F.array_union(left, right))
    return F.when(together > 0, F.size(F.array_intersect(left, right)) / together).otherwise(F.lit(1.0))


def containment(part: Column, whole: Column) -> Column:
    """Estimated part of the first one's shingles that the second has (0 to 1); 1 where the first has none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(1.0))


def sketch_text(sketch: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def successors(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with ``next``, the struct of the ``order`` columns of the following row; after the last comes the first.

    Rows are cut into ranges of their order, as many as the session has shuffle
    partitions; within a range the next row is at
    hand, and for a range's last row it is the first of the next range that has
    rows. Only those first rows, one for each range, are ordered in one place.
    """
    ranged = keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    own = F.struct(*order)
    firsts = ranged.groupBy("range").agg(F.min(own).alias("first"))
    line = Window.partitionBy(F.lit(0)).orderBy("range")  # one row for each range
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first").over(line), F.first("first").over(whole))
    turns = firsts.select("range", following.alias("following"))
    within = Window.partitionBy("range").orderBy(*order)
    found = ranged.withColumn("next", F.lead(own).over(within)).join(F.broadcast(turns), "range")
    return found.withColumn("next", F.coalesce("next", "following")).drop("range", "following")


def fingerprint_edits(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words_each: int = WORDS_EACH, kept_part: int = KEPT_PART
) -> DataFrame:
    """Sketches of every document and of its edited text, and how near they are.

    The edited text is the document without its last quarter of characters
    (rounded down), then as many of the first characters of the next document,
    or all it has. Documents follow each other by id, null ids first, rows of
    one id by the hash of their text; after the last comes the first, so a lone
    document follows itself. Null texts are empty. Rows equal in id and text are
    one document and each get its result. An empty table gives an empty result.

    Columns: the id, n_chars, edited_text, sketch, edited_sketch, next_sketch.
    Whole texts move once, and the wanted beginnings and sketches once more.
    """
    own, content = F.col(id_column), F.coalesce(F.col(text).cast("string"), F.lit(""))
    missing = F.lit(0).cast(df.schema[id_column].dataType)
    # Both uses of these rows need just these columns, so their texts are shuffled once.
    base = df.select(own.isNotNull().cast("int").alias("known"), F.coalesce(own, missing).alias("id"), content.alias("__text"))
    base = base.withColumn("hash", F.xxhash64("__text"))
    order = ["known", "id", "hash"]
    keys = base.select(*order, F.char_length("__text").alias("n")).distinct()
    follow = materialise(successors(keys, order), "follow")

    back = follow.select(*[F.col(f"next.{c}").alias(c) for c in order], *[F.col(c).alias(f"before_{c}") for c in order], F.col("n").alias("before_n"))
    sent = base.join(back, order)
    once = Window.partitionBy(*order).orderBy("known")
    sent = sent.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    sent = with_sketch(sent, "__text", "next_sketch", words_each, kept_part)
    head = F.substring(F.col("__text"), F.lit(1), F.floor(F.col("before_n") / 4).cast("int"))
    sent = sent.select(*[F.col(f"before_{c}").alias(c) for c in order], head.alias("head"), "next_sketch")

    met = base.join(sent, order).withColumn("n_chars", F.char_length("__text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), F.col("n_chars") - quarter), "head")
    met = with_sketch(met.withColumn("edited_text", edited), "__text", "sketch", words_each, kept_part)
    met = with_sketch(met, "edited_text", "edited_sketch", words_each, kept_part)
    return met.select(
        F.when(F.col("known") == 1, F.col("id")).alias(id_column), F.col("n_chars").cast("long"), "edited_text", "sketch", "edited_sketch", "next_sketch"
    )
