"""Chat formatting: one training example for each assistant turn, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, OPEN_END, CLOSE = "<turn ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    r"""A text without ``<`` and ``>``: ``\`` becomes ``\b``, ``<`` becomes ``\l``, ``>`` becomes ``\g``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\g"), F.lit(">"))
    out = F.replace(out, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_examples(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    r"""One row for each example: the conversation, ``example`` (the turns it holds), ``formatted``, ``loss_start``, ``loss_end``.

    Every assistant turn is an example of its own: all turns before it as
    context, then the reply, whose escaped text, characters loss_start to
    loss_end (end exclusive), is all that is trained on. A conversation that does
    not end in an assistant turn has one more example with all its turns and an
    empty mask. A turn is ``<turn role>``, a line break, the text, ``</turn>``
    and a line break; texts and roles are escaped so that neither bracket occurs
    in them.

    Rows are ordered by turn, then role, then text, nulls first; equal turns and
    repeated rows are turns of their own. Null roles and texts are empty; null
    conversations are one conversation. An empty table gives no examples; other
    columns are not read. A conversation is gathered once, as the unit that is
    formatted; its examples together grow with the square of its turns, which is
    what giving each reply its whole context means.
    """
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    whole = df.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(said)).alias("__turns"))
    piece = F.transform(
        "__turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(OPEN_END)).alias("head"),
            escaped(t["text"]).alias("body"),
        ),
    )
    whole = whole.select(conversation, piece.alias("__pieces"))
    laid = F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))
    whole = whole.withColumn("__laid", laid)
    turns = F.size("__pieces")
    replies = F.filter(
        F.sequence(F.lit(1), turns), lambda k: (F.get("__pieces", k - 1)["role"] == ASSISTANT) | (k == turns)
    )
    each = whole.withColumn("example", F.explode(replies))
    target = F.get("__pieces", F.col("example") - 1)
    each = each.withColumn("__context", F.array_join(F.slice("__laid", F.lit(1), F.col("example") - 1), ""))
    start = F.char_length("__context") + F.char_length(target["head"])
    trained = F.when(target["role"] == ASSISTANT, F.char_length(target["body"])).otherwise(F.lit(0))
    return each.select(
        conversation, "example", F.concat("__context", F.get("__laid", F.col("example") - 1)).alias("formatted"),
        start.cast("long").alias("loss_start"), (start + trained).cast("long").alias("loss_end"),
    )


def read_back(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the examples say, from their strings alone: turns of the longest, replies under the masks, characters.

    Columns: the conversation, ``turns`` (array of role and text), ``replies``
    (array of unescaped texts in order), ``formatted_chars``.
    """
    under = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    last_open = F.substring_index("formatted", OPEN, -1)
    masked = F.startswith(last_open, F.lit(ASSISTANT + OPEN_END))
    gathered = examples.groupBy(conversation).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(masked, F.struct("example", unescaped(under).alias("text"))))).alias("replies"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    marks = F.split(F.substring(F.col("longest"), F.lit(len(OPEN) + 1), F.char_length("longest")), OPEN)

    def turn(mark: Column) -> Column:
        role, said = F.substring_index(mark, ">", 1), F.substring_index(mark, "</", 1)
        body = F.substring(said, F.char_length(role) + len(OPEN_END) + 1, F.char_length(said))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    turns = F.transform(marks, turn)
    return gathered.select(
        conversation, turns.alias("turns"), F.transform("replies", lambda r: r["text"]).alias("replies"), "formatted_chars"
    )
