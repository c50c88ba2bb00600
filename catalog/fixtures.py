"""Settings the registered queries and their check SQL share."""

from __future__ import annotations

from dataclasses import replace

from lexprism import SentimentConfig, TextConfig
from lexprism.operators.sentiment import ScoreRules

TEXT = TextConfig("text", unit="doc_id", group="lang", planned_topics=3, custom_stopwords=(" Es ", "of the"))
PAIR = TextConfig(
    "text", unit="doc_id", group="lang", focal_group="en", reference_group="fr", planned_topics=3,
    custom_stopwords=(" Es ", "of the"),
)
WORDS_ONLY = TextConfig("text", unit="doc_id", use_english_stopwords=False, ngram_max=1)

# The fixture texts hold no English sentiment words, so frequent fixture words play their part.
LEXICON = {
    "the": 1.9, "of": -1.5, "de": 2.3, "and": 0.4, "la": -2.1, "der": 1.2, "for": -0.8, "que": 3.1, "es": -2.7,
    "to": 0.9, "th": -3.3, "no": -1.2, "und": 2.0, "from": 1.1,
}
RULES = ScoreRules(
    strengthening=("is", "le", "die", "this"),
    weakening=("was", "un", "von"),
    negating=("not", "with", "et", "den"),
    contrast="as",
)
# Frequent word pairs of the fixture texts, with a value of their own or shifting what follows.
PHRASED = replace(
    RULES,
    phrases=(("of the", 3.0), ("la que", -2.5), ("the la", 1.25), ("de la que", 0.5), ("der und", -1.75), ("th of", 2.25)),
    phrase_boosts=(("the of", 0.25), ("de que", -0.5), ("of the and", 0.75)),
)
# Letters of the fixture texts stand in for emoji.
EMOJI = {"ñ": "la no", "ü": "the", "É": "quiet"}
HUMAN = SentimentConfig(
    "text", time_column="o_orderdate", time_grain="quarter", dimensions=("lang", "toxic"),
    human_label_column="quality", positive_label="1", negative_label="0",
)
HUMAN_THREE = SentimentConfig(
    "text", human_label_column="mark", positive_label="1", negative_label="0", neutral_label="2",
)
EMBEDDING_TOPICS = 4
SAMPLES = [(k, i) for k in (2, 3) for i in (1, 2, 3)]
