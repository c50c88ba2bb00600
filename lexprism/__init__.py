"""Exploratory evidence tables for open-ended text, computed as Spark jobs."""

import sys

from pyspark import cloudpickle

from .config import DataProblem, SentimentConfig, TextConfig
from .operators.audit import audit_corpus
from .plans.evidence import build_evidence_pack
from .plans.sentiment import analyze_sentiment
from .plans.text_analysis import analyze_text

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "DataProblem",
    "SentimentConfig",
    "TextConfig",
    "analyze_sentiment",
    "analyze_text",
    "audit_corpus",
    "build_evidence_pack",
]
