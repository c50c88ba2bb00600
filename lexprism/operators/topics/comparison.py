"""Fitting every topic count and repetition, and comparing them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...config import DataProblem, TextConfig
from ..vocabulary import Vocabulary
from .factorise import Fit, document_weights, factorise
from .sampling import membership, sample_limits
from .stability import align, stability_by_count, topic_stability
from .start import Spectrum, full_spectrum, sample_spectra, starting_topics
from .tables import component_entries, top_term_diversity

ERROR_SCHEMA = "k int, relative_reconstruction_error double"
LEAST_PASS_TASKS = 64
PASS_TASKS_PER_SLOT = 4


@dataclass
class TopicModel:
    """Fits of all compared counts; components are at most 8 x 10,000 numbers each."""

    fits: dict[tuple[int, int], Fit]
    rows: DataFrame
    documents: int
    planned: int
    full: Spectrum
    samples: list[Spectrum]

    @property
    def unsettled_starts(self) -> int:
        """Starts whose leading singular values were still moving when the passes ran out."""
        return sum(not spectrum.steady for spectrum in [self.full, *self.samples])

    @property
    def start_steps(self) -> int:
        """Passes of the slowest start."""
        return max(spectrum.steps for spectrum in [self.full, *self.samples])

    @property
    def counts(self) -> list[int]:
        return sorted({k for k, _ in self.fits})

    @property
    def fits_at_cap(self) -> int:
        return sum(fit.capped for fit in self.fits.values())

    @property
    def unfinished_rows(self) -> int:
        """Rows whose weights ran out of sweeps in the last pass of a fit, over all fits."""
        return sum(fit.unfinished_rows for fit in self.fits.values())

    @property
    def planned_fit(self) -> Fit:
        return self.fits[self.planned, 0]

    def _topic_rows(self, spark: SparkSession, fits: list[tuple[int, int]]) -> DataFrame:
        """``k, iteration, topic, weights`` of some fits."""
        numbered = [(k, i, topic + 1) for k, i in fits for topic in range(k)]
        vectors = np.vstack([self.fits[fit].components for fit in fits])
        bounds = np.arange(0, vectors.size + 1, vectors.shape[1])
        columns = {
            name: pa.array([row[at] for row in numbered], pa.int32()) for at, name in enumerate(("k", "iteration", "topic"))
        }
        weights = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(vectors.ravel()))
        return spark.createDataFrame(pa.table({**columns, "weights": weights}))

    def components(self, spark: SparkSession) -> DataFrame:
        """``k, topic, weights`` of the full-corpus fits."""
        return self._topic_rows(spark, [(k, 0) for k in self.counts]).drop("iteration")

    def pairs(self, spark: SparkSession) -> DataFrame:
        """Topics of every repetition next to the full-corpus topic of the same number."""
        repeated = self._topic_rows(spark, [fit for fit in self.fits if fit[1] > 0])
        full = self.components(spark).withColumnRenamed("weights", "reference")
        return repeated.withColumnRenamed("weights", "candidate").join(F.broadcast(full), ["k", "topic"])

    def aligned(self, spark: SparkSession) -> DataFrame:
        return align(self.pairs(spark))

    def planned_stability(self, spark: SparkSession) -> DataFrame:
        return topic_stability(self.aligned(spark)).filter(F.col("k") == self.planned).drop("k")

    def document_weights(self) -> DataFrame:
        return document_weights(self.rows, self.planned_fit.components)

    def release(self) -> None:
        self.rows.unpersist()


def compared_counts(planned: int, documents: int, terms: int) -> list[int]:
    most = min(8, max(5, planned + 2), documents - 1, terms - 1)
    if most < 2:
        raise DataProblem("Too few usable documents or terms to compare topic counts.")
    return list(range(2, most + 1))


def _fit_rows(usable: DataFrame, flags) -> DataFrame:
    """Document rows with sample flags, kept for all passes in partitions whose number the session sets, not the rows.

    Each task of a pass returns one partial sum per fit, so more rows make its
    tasks longer, but no more sums travel.
    """
    rows = usable.withColumn("member", flags)
    most = max(LEAST_PASS_TASKS, PASS_TASKS_PER_SLOT * rows.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() > most:
        rows = rows.coalesce(most)
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def fit_topics(
    matrix: DataFrame,
    vocabulary: Vocabulary,
    config: TextConfig,
    documents: int,
    counts: list[int] | None = None,
) -> TopicModel:
    """Fit each count on the full corpus and on ``stability_iterations`` samples.

    ``matrix`` should be a written table; ``documents`` is its number of usable
    rows. A count is fitted once on the full corpus: the comparison, the
    stability reference and the planned solution are the same problem.
    """
    terms = len(vocabulary.terms)
    usable = matrix.filter(F.size("indices") > 0)
    if counts is None:
        counts = compared_counts(config.planned_topics, documents, terms)
    if max(counts) >= min(documents, terms):
        raise DataProblem("The topic count must stay below the number of documents and of terms.")
    repeated = [(k, i) for k in counts for i in range(1, config.stability_iterations + 1)]
    found = sample_limits(usable.select("doc_key"), repeated, documents, config.seed)
    limits = {fit: found[fit] for fit in repeated}
    rows = _fit_rows(usable, membership(F.col("doc_key"), limits, config.seed))

    full = full_spectrum(rows, terms, max(counts), config.seed)
    samples = sample_spectra(rows, full, [k for k, _ in repeated])
    planned = [(k, 0) for k in counts] + repeated
    spectra = [full] * len(counts) + samples
    positions = [-1] * len(counts) + list(range(len(repeated)))
    starts = starting_topics(rows, spectra, [k for k, _ in planned], positions)
    fits = [
        Fit(k, i, position, start, spectrum.square_sum)
        for (k, i), position, start, spectrum in zip(planned, positions, starts, spectra)
    ]
    done = {(fit.topics, fit.iteration): fit for fit in factorise(rows, fits)}
    return TopicModel(done, rows, documents, config.planned_topics, full, samples)


def fit_one(matrix: DataFrame, vocabulary: Vocabulary, config: TextConfig, documents: int) -> TopicModel:
    """Only the planned count on the full corpus, without repetitions."""
    terms = len(vocabulary.terms)
    usable = matrix.filter(F.size("indices") > 0)
    if config.planned_topics >= min(documents, terms):
        raise DataProblem("The topic count must stay below the number of documents and of terms.")
    rows = _fit_rows(usable, F.array(F.lit(True)))
    full = full_spectrum(rows, terms, config.planned_topics, config.seed)
    start = starting_topics(rows, [full], [config.planned_topics], [-1])[0]
    fit = factorise(rows, [Fit(config.planned_topics, 0, -1, start, full.square_sum)])[0]
    return TopicModel({(config.planned_topics, 0): fit}, rows, documents, config.planned_topics, full, [])


def topic_count_comparison(model: TopicModel, vocabulary: Vocabulary, spark: SparkSession) -> DataFrame:
    """One row per topic count: error, stability and term diversity."""
    errors = spark.createDataFrame([(k, model.fits[k, 0].relative_error) for k in model.counts], ERROR_SCHEMA)
    entries = component_entries(model.components(spark), "k")
    diversity = top_term_diversity(entries, vocabulary.table(spark), "k")
    stability = stability_by_count(model.aligned(spark))
    return (
        errors.join(stability, "k")
        .join(diversity, "k")
        .orderBy("k")
        .select(
            F.col("k").alias("topics"),
            (F.col("k") == model.planned).alias("selected_plan"),
            "relative_reconstruction_error",
            "mean_topic_stability",
            "minimum_topic_stability",
            "top_term_diversity",
        )
    )
