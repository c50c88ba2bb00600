"""Mixing sources to target weights: temperature, and the draw of documents that realises it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .token_counts import token_counts

FEW_SOURCES = 10_000
SALTS = 64
STEPS, GRID = 12, 32  # 32 ** 12 is 2 ** 60: as fine as the halvings
BLOCK_DOCUMENTS = 10_000
HALVINGS = 60
ADDED = ("mix_copy", "mix_block", "mix_tokens", "mix_weight")


def tempered(shares: Sequence[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and scaled to sum 1; a share of 0 stays 0."""
    highest = max(shares)
    raised = [(s / highest) ** exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: Sequence[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: Sequence[float], weights: Sequence[float]) -> float:
    """How often the most repeated source is read while the least repeated is read once."""
    rates = [w / s for w, s in zip(weights, shares) if s > 0]
    return max(rates) / min(rates)


def exponent_for(shares: Sequence[float], target_entropy: float | None, most_repeats: float | None) -> float:
    """The largest exponent in [0, 1] that reaches the entropy target, raised if repeats would pass the limit.

    Entropy (as a part of its highest value, the logarithm of the number of
    sources) and repeats both fall as the exponent rises to 1, where weights are
    the shares themselves. If both cannot hold, the repetition limit does.
    """

    def bisect(holds) -> tuple[float, float]:
        """The last exponent at which a condition holds that holds from 0 on, and the first at which it doesn't."""
        if holds(1.0):
            return 1.0, 1.0
        low, high = 0.0, 1.0
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low, high

    there = [s for s in shares if s > 0]
    exponent = 1.0
    if target_entropy is not None and len(there) > 1:
        goal = target_entropy * math.log(len(there)) - 1e-12
        exponent, _ = bisect(lambda x: entropy(tempered(there, x)) >= goal)
    if most_repeats is not None and there and repetition(there, tempered(there, exponent)) > most_repeats:
        _, exponent = bisect(lambda x: repetition(there, tempered(there, x)) > most_repeats)
    return exponent


def shared_target(shares: Sequence[float], toward_even: float) -> float | None:
    """An entropy (as a part of the highest) that lies this part of the way from that of the shares to that of even ones."""
    there = [s for s in shares if s > 0]
    if len(there) < 2:
        return None
    own = entropy(there) / math.log(len(there))
    return own + toward_even * (1.0 - own)


def exponent_on_table(
    sized: DataFrame, target_entropy: float | None, most_repeats: float | None, toward_even: float | None = None
) -> float:
    """``exponent_for`` where the sources (``total``) are too many for the driver: each step sums over the table.

    A step tries a grid of exponents at once. How often sources repeat depends on the largest and the smallest only.
    """
    there = sized.where("total > 0")
    ends = there.agg(F.max("total").alias("high"), F.min("total").alias("low"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return 1.0
    part = F.log(F.col("total") / F.lit(float(ends["high"])))

    def entropies(exponents: Sequence[float]) -> list[float]:
        raised = [F.exp(part * F.lit(x)) for x in exponents]
        sums = [F.struct(F.sum(r).alias("s"), F.sum(r * part).alias("t")).alias(f"x{i}") for i, r in enumerate(raised)]
        row = there.agg(*sums).first()
        return [math.log(row[f"x{i}"]["s"]) - x * row[f"x{i}"]["t"] / row[f"x{i}"]["s"] for i, x in enumerate(exponents)]

    exponent, highest = 1.0, math.log(ends["n"])
    if ends["n"] > 1 and (target_entropy is not None or toward_even is not None):
        (own,) = entropies([1.0])
        goal = (target_entropy * highest if toward_even is None else own + toward_even * (highest - own)) - 1e-12
        if own < goal:
            low, high = 0.0, 1.0
            for _ in range(STEPS):
                tried = [low + (high - low) * k / GRID for k in range(1, GRID)]
                held = [x for x, h in zip(tried, entropies(tried)) if h >= goal]
                low = max(held, default=low)
                high = min([x for x in tried if x > low], default=high)
            exponent = low
    if most_repeats is not None and ends["high"] > ends["low"]:
        spread = math.log(ends["high"] / ends["low"])
        exponent = max(exponent, min(1.0, 1.0 - math.log(max(most_repeats, 1.0)) / spread))
    return exponent


def word_total(text: Column | str) -> Column:
    """Words of a text at white space, at least 1: the share measure where no token counts are at hand."""
    column = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.greatest(F.regexp_count(column, F.lit(r"\S+")), F.lit(1)).cast("long")


def with_tokens(df: DataFrame, tokenizer: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row, at least 1: counted once and written, as mixing reads them several times."""
    counted = token_counts(df, tokenizer, text, keep=keep)
    return materialise(counted.select(*keep, F.greatest("n_tokens", F.lit(1).cast("long")).alias("n_tokens")), "mix-tokens")


def mix_sources(
    df: DataFrame,
    source: str = "source",
    id_column: str = "doc_id",
    tokens: Column | None = None,
    target_entropy: float | None = 0.9,
    most_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
    seed: int = 17,
    toward_even: float | None = None,
) -> DataFrame:
    """``df`` drawn to tempered source weights, with ``mix_copy``, ``mix_block``, ``mix_tokens``, ``mix_weight``.

    Source shares of tokens are raised to one exponent, found by bisection, that
    meets ``target_entropy`` (a part of the highest possible) within
    ``most_repeats``. ``toward_even``, where given, takes the place of the
    target: this part of the way from the entropy of the shares themselves to
    the highest, so it asks for something whatever the shares are.

    A source's budget is its weight times ``budget_tokens``;
    by default the budget is the smallest that reads every source at least once
    whole, so no document is lost and small sources repeat.

    A budget is spent in whole passes; the rest of it is the start of one more
    permutation: blocks of about ten thousand documents (by a hash of their ids)
    in hashed order, and in the block where it ends documents in hashed order,
    each taken while the tokens before it are below the budget. A source is thus
    off its budget by less than one document. ``mix_copy`` counts the passes
    from 0 and is the document's how-manyeth copy.

    Null sources are a source of their own; null and empty texts count one
    token. Rows equal in every column are drawn together. An empty table gives an empty result. Columns
    of ``df`` with the four added names give way. Sources are cut into blocks before anything
    is ordered, so one that holds most rows is spread like the others. Up to
    10,000 sources are weighed on the driver and their budgets sent to the
    tasks; more are weighed by sums over their table and joined by shuffle, the
    rows of each over 64 copies of its budget.
    """
    tokens = word_total("text") if tokens is None else tokens
    draw = F.xxhash64(F.col(id_column).cast("string"), F.lit(seed))
    named = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    keyed = df.select(  # whole rows stay in one column, so their names meet none of ours
        F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"), tokens.cast("long").alias("mix_tokens"),
        draw.alias("draw"), F.xxhash64(*_plain(df)).alias("same"), named.alias("named"),
    )

    sized = keyed.groupBy("named").agg(F.sum("mix_tokens").alias("total"), F.count("*").alias("documents"))
    sized = materialise(sized, "mix-sources")
    totals = sized.orderBy("named").take(FEW_SOURCES + 1)
    few = len(totals) <= FEW_SOURCES
    kept = [f"`{name}`" for name in df.columns if name not in ADDED]
    if not totals:
        nothing = {"mix_copy": "int", "mix_block": "long", "mix_tokens": "long", "mix_weight": "double"}
        return df.select(*kept, *[F.lit(0).cast(kind).alias(name) for name, kind in nothing.items()])
    if few:
        budgets = _listed_budgets(df.sparkSession, totals, target_entropy, most_repeats, budget_tokens, toward_even)
    else:
        exponent = exponent_on_table(sized, target_entropy, most_repeats, toward_even)
        budgets = materialise(_budget_table(sized, exponent, budget_tokens), "mix-budgets")

    def of_sources(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with what their source has; one row of ``table`` for each source."""
        if few:
            return rows.join(F.broadcast(table), "named", how)
        copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.withColumn("salt", F.pmod("draw", F.lit(SALTS))).join(copies, ["named", "salt"], how).drop("salt")

    narrow = of_sources(keyed.select("named", "draw", "same", "mix_tokens"), budgets).where("rest > 0")
    narrow = materialise(narrow.withColumn("mix_block", F.pmod("draw", F.col("blocks"))), "mix-rows")
    held = narrow.groupBy("named", "mix_block").agg(F.sum("mix_tokens").alias("held"), F.first("rest").alias("rest"))
    before = Window.partitionBy("named").orderBy("place", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = held.withColumn("place", _block_place(seed)).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    begun = begun.where("before < rest").select(
        "named", F.struct("place", "mix_block", (F.col("rest") - F.col("before")).alias("room")).alias("at")
    )
    ends = materialise(begun.groupBy("named").agg(F.max("at").alias("at")), "mix-ends")

    within = Window.partitionBy("named").orderBy("draw", "same").rowsBetween(Window.unboundedPreceding, -1)
    ending = of_sources(narrow, ends).where("mix_block = at.mix_block")  # one block for each source
    ending = ending.withColumn("spent", F.coalesce(F.sum("mix_tokens").over(within), F.lit(0))).where("spent < at.room")
    last = ending.groupBy("named").agg(F.max(F.struct("at.place", "at.mix_block", "draw", "same")).alias("last"))
    last = materialise(last, "mix-last")

    out = of_sources(of_sources(keyed, budgets), last, "left").withColumn("mix_block", F.pmod("draw", F.col("blocks")))
    own = F.struct(_block_place(seed).alias("place"), "mix_block", "draw", "same")
    extra = F.coalesce(own <= F.col("last"), F.lit(False))
    copies = (F.col("passes") + extra.cast("long")).cast("int")
    out = out.withColumn("copies", copies).where("copies > 0")
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select(*[f"row.{name}" for name in kept], "mix_copy", "mix_block", "mix_tokens", "mix_weight")


PLAN = "named string, mix_weight double, passes long, rest long, blocks long"


def _listed_budgets(
    spark: SparkSession, totals: list[Row], target_entropy: float | None, most_repeats: float | None, budget_tokens: int | None,
    toward_even: float | None,
) -> DataFrame:
    """Weight, whole passes, rest and blocks of each source."""
    whole = sum(r["total"] for r in totals)
    shares = [r["total"] / whole for r in totals]
    target = target_entropy if toward_even is None else shared_target(shares, toward_even)
    weights = tempered(shares, exponent_for(shares, target, most_repeats))
    least = max(range(len(totals)), key=lambda k: totals[k]["total"] / weights[k])
    rows = []
    for k, (r, weight) in enumerate(zip(totals, weights)):
        if budget_tokens is None:  # the least repeated source is read exactly once
            goal = r["total"] if k == least else max(r["total"], round(totals[least]["total"] / weights[least] * weight))
        else:
            goal = round(budget_tokens * weight)
        rows.append((r["named"], weight, goal // r["total"], goal % r["total"], -(-r["documents"] // BLOCK_DOCUMENTS)))
    return spark.createDataFrame(rows, PLAN)


def _budget_table(sized: DataFrame, exponent: float, budget_tokens: int | None) -> DataFrame:
    """The same for sources that stay in their table."""
    high = float(sized.agg(F.max("total")).first()[0])
    raised = F.exp(F.log(F.col("total") / F.lit(high)) * F.lit(exponent))
    whole = sized.agg(F.sum(raised)).first()[0]
    weight = raised / F.lit(whole)
    if budget_tokens is None:  # the largest source is the least repeated and read exactly once
        goal = F.greatest(F.col("total"), F.round(F.lit(high * whole) * weight).cast("long"))
        goal = F.when(F.col("total") == int(high), F.col("total")).otherwise(goal)
    else:
        goal = F.round(F.lit(float(budget_tokens)) * weight).cast("long")
    planned = sized.select("named", weight.alias("mix_weight"), "total", goal.alias("goal"), "documents")
    blocks = F.ceil(F.col("documents") / BLOCK_DOCUMENTS)
    return planned.select("named", "mix_weight", F.floor(F.col("goal") / F.col("total")).alias("passes"), (F.col("goal") % F.col("total")).alias("rest"), blocks.alias("blocks"))


def _block_place(seed: int) -> Column:
    """Where a block stands in its source's permutation."""
    return F.xxhash64("named", "mix_block", F.lit(seed))


def _plain(df: DataFrame) -> list[str]:
    """Columns a hash can take."""
    return [f"`{name}`" for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
