"""Role declarations and the checks that run before any Spark job starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Numbers that decide whether a result is given or withheld.
MIN_DOCUMENTS = 80
DOCUMENTS_PER_TOPIC = 20
MIN_VOCABULARY = 30
MIN_GROUP_DOCUMENTS = 20
MAX_GROUP_LEVELS = 6
CONTRAST_PRIOR_MASS = 1000.0
SYMMETRIC_TOP_TERMS = 80
VARIANT_TOP_TERMS = 30
MAX_FIT_ITERATIONS = 800
FIT_TOLERANCE = 1e-4
SAMPLE_SHARE = 0.80
MIN_SENTIMENT_DOCUMENTS = 20
TIME_GRAINS = ("day", "week", "month", "quarter")
BOUNDARY_FIELDS = (
    "research_question",
    "corpus_definition",
    "intended_use",
    "unit_definition",
    "language_policy",
    "human_validation_plan",
)


class DataProblem(ValueError):
    """The data or the declared settings do not support the requested result."""


@dataclass(frozen=True)
class TextConfig:
    # The defaults of the settings, but for the seed.
    text_column: str
    unit: str | None = None
    group: str | None = None
    focal_group: str | None = None
    reference_group: str | None = None
    planned_topics: int = 3
    use_english_stopwords: bool = True
    custom_stopwords: tuple[str, ...] = ()
    min_df: int = 3
    max_df: float = 0.90
    ngram_max: int = 2
    max_features: int = 3000
    top_terms: int = 12
    assignment_threshold: float = 0.45
    stability_iterations: int = 10
    seed: int = 4711
    english_stopwords: tuple[str, ...] | None = None

    @property
    def minimum_documents(self) -> int:
        return max(MIN_DOCUMENTS, DOCUMENTS_PER_TOPIC * self.planned_topics)

    @property
    def symmetric(self) -> bool:
        return bool(self.group) and self.focal_group is not None and self.reference_group is not None


@dataclass(frozen=True)
class SentimentConfig:
    text_column: str
    time_column: str | None = None
    time_grain: str = "month"
    dimensions: tuple[str, ...] = ()
    human_label_column: str | None = None
    positive_label: str | None = None
    negative_label: str | None = None
    neutral_label: str | None = None
    voluntary_reviews: bool = False
    time_formats: tuple[str, ...] = ()  # date patterns tried before the usual mixed forms


def require_columns(df: DataFrame, **roles: str | None) -> None:
    """Refuse a declared role whose column is absent; names match case-sensitively."""
    for role, column in roles.items():
        if column and column not in df.columns:
            raise DataProblem(f"No column named {column!r} for the {role.replace('_', ' ')} role.")


def check_text_config(config: TextConfig) -> None:
    # The smallest and the largest value allowed.
    ranges = {
        "planned_topics": (2, 8),
        "min_df": (2, 50),
        "max_df": (0.5, 1.0),
        "ngram_max": (1, 2),
        "max_features": (500, 10_000),
        "top_terms": (5, 20),
        "stability_iterations": (3, 50),
    }
    for name, (low, high) in ranges.items():
        value = getattr(config, name)
        if not low <= value <= high:
            raise DataProblem(f"{name} must lie between {low} and {high}; got {value}.")


def check_sentiment_config(df: DataFrame, config: SentimentConfig) -> None:
    if config.time_grain not in TIME_GRAINS:
        raise DataProblem(f"time_grain must be one of {', '.join(TIME_GRAINS)}.")
    absent = [name for name in config.dimensions if name not in df.columns]
    if absent:
        raise DataProblem(f"Dimension columns not in the data: {', '.join(absent)}.")
    require_columns(
        df,
        text=config.text_column,
        time=config.time_column,
        human_label=config.human_label_column,
    )
    if config.human_label_column and not (config.positive_label and config.negative_label):
        raise DataProblem("Validation needs both a positive and a negative human label.")


def check_contract(contract: dict) -> list[str]:
    """Refuse contradictory roles; return the boundary fields left undocumented."""
    focal, reference = contract.get("focal_group"), contract.get("reference_group")
    if contract.get("group") and focal is not None and focal == reference:
        raise DataProblem("Focal and reference group must differ.")
    negative, positive = contract.get("negative_label"), contract.get("positive_label")
    if contract.get("human_label_column") and negative == positive:
        raise DataProblem("Negative and positive human labels must differ.")
    return [field for field in BOUNDARY_FIELDS if not str(contract.get(field) or "").strip()]
