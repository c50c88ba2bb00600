from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry_module
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from lexprism.functions.stopwords import ENGLISH

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_module_loads_without_a_session():
    code = (
        "import __spark_entry__ as e; from pyspark import SparkContext; "
        "assert e.queries() and e.oracle_sql(); assert SparkContext._active_spark_context is None"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_check_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())


def test_english_list_equals_the_library_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH


def test_entry_runs(spark):
    if os.path.isdir(entry_module.SMALL):
        assert entry_module.entry(spark).count() == 50
