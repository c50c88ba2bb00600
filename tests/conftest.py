from __future__ import annotations

import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


POOLS = {
    "garden": (
        "soil compost tulip shovel mulch watering sprout orchard pruning greenhouse fern lawn hedge seedling blossom "
        "trellis gravel petal root nursery"
    ).split(),
    "harbour": (
        "anchor vessel tide mooring cargo lighthouse sailor dockside rope crane pilot ferry keel ballast pier buoy "
        "captain deck stern voyage"
    ).split(),
    "kitchen": (
        "skillet pepper oven simmer garlic whisk batter ladle pantry roast broth saffron dough grater spice butter "
        "kettle apron sauce platter"
    ).split(),
}
FILLER = "people often mention matters during ordinary weeks around town while waiting for news about plans".split()


def planted_rows(count: int = 240, seed: int = 7) -> list[tuple]:
    """Rows with one dominant word pool each, two stages and three variants with a word of their own."""
    draw = random.Random(seed)
    pools = list(POOLS)
    rows = []
    for i in range(count):
        stage = "early" if i % 2 == 0 else "late"
        variant = ("red", "green", "blue")[i % 3]
        leaning = pools if draw.random() < 0.3 else (pools[:2] if stage == "early" else pools[1:])
        pool = draw.choice(leaning)
        other = draw.choice([p for p in pools if p != pool])
        body = draw.choices(POOLS[pool], k=22) + draw.choices(POOLS[other], k=2) + draw.choices(FILLER, k=8)
        body.append({"red": "scarlet", "green": "emerald", "blue": "cobalt"}[variant])
        draw.shuffle(body)
        rows.append((f"R{i:04d}", stage, variant, f"2024-{1 + i % 12:02d}-05", pool, " ".join(body) + f" note{i}."))
    return rows


PLANTED_SCHEMA = "id string, stage string, variant string, day string, pool string, text string"


@pytest.fixture(scope="session")
def planted(spark):
    return spark.createDataFrame(planted_rows(), PLANTED_SCHEMA).persist()
