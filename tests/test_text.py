from __future__ import annotations

import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexprism.functions import text as T

PYTHON_TOKEN = re.compile(r"(?u)\b[^\W\d_][\w'-]{1,}\b")


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    prepared = df.withColumn("norm", T.normalized("text"))
    return [r[1] for r in sorted(prepared.select("i", expression).collect())]


def reference_norm(value):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(value))).strip()


CASES = [
    "  Café &amp;  notes\n",
    "plain  ascii\ttext \x1c here ",
    "ﬁne ½ x² Ａｂｃ",
    " wide lines ",
    "&lt;b&gt; &#233;t&eacute;",
    "",
    "   ",
    "Straße İstanbul",
]


def test_normalisation_equals_the_definition(spark):
    assert column(spark, CASES, "norm") == [reference_norm(c) for c in CASES]


def test_null_is_blank_and_lexical_of_blank_is_null(spark):
    df = spark.createDataFrame([(None,), (" \n",), ("&nbsp;",)], "text string")
    got = df.select(T.normalized("text").alias("n"), T.lexical("text").alias("l"), T.folded("text").alias("f")).collect()
    assert [tuple(r) for r in got] == [("", None, "")] * 3


def test_a_text_of_marks_only_is_not_blank(spark):
    df = spark.createDataFrame([("\u0301",)], "text string")
    assert df.select(T.lexical("text").alias("l")).first()["l"] == ""


def test_lexical_and_folded_forms(spark):
    df = spark.createDataFrame([("ÉTÉ Straße",), ("Plain TEXT",)], "text string")
    got = df.select(T.lexical("text").alias("l"), T.folded("text").alias("f")).collect()
    assert [tuple(r) for r in got] == [("ete straße", "été strasse"), ("plain text", "plain text")]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=5, max_size=30))
def test_normalisation_on_arbitrary_text(spark, values):
    assert column(spark, values, "norm") == [reference_norm(v) for v in values]


TOKEN_CASES = [
    "don't-stop a- b",
    "1st x²y ab_c _lead trail_ a--b",
    "мир и труд 中文 字",
    "l'été jusqu'à rock'n'roll' -dash",
    "A B cd e1 1e",
]


def test_word_count_and_tokens_equal_the_pattern(spark):
    counts = column(spark, TOKEN_CASES, T.word_count("norm").alias("x"))
    assert counts == [len(PYTHON_TOKEN.findall(reference_norm(c))) for c in TOKEN_CASES]
    found = column(spark, TOKEN_CASES, T.tokens("norm").alias("x"))
    assert found == [PYTHON_TOKEN.findall(reference_norm(c)) for c in TOKEN_CASES]


def test_masks_email_then_url_then_phone(spark):
    texts = [
        "Mail ana.b@example.org, ring +47 912 34 567 or see https://example.org/a?b=1.",
        "WWW.Example.com and call 0123456789x 12-34",
    ]
    assert column(spark, texts, T.masked("norm").alias("x")) == [
        "Mail [EMAIL], ring [PHONE] or see [URL].",
        "[URL] and call 0123456789x 12-34",
    ]


def test_contact_flags(spark):
    texts = ["a@b.io", "call (0123) 456 789", "http://x.y", "nothing 12345"]
    flags = F.concat_ws(",", T.has_email("norm").cast("string"), T.has_phone("norm").cast("string"), T.has_url("norm").cast("string"))
    assert column(spark, texts, flags.alias("x")) == [
        "true,false,false", "false,true,false", "false,false,true", "false,false,false",
    ]


def test_snippet_is_cut_only_when_longer_than_the_limit(spark):
    exact, longer = "x" * 360, "y" * 355 + "  z " + "w" * 20
    got = column(spark, [exact, longer], T.snippet("norm").alias("x"))
    assert got[0] == exact
    assert got[1] == ("y" * 355 + " z")[:357].rstrip() + "..."


def test_pairs_are_formed_after_stopword_removal(spark):
    df = spark.createDataFrame([("one the two of three",), ("single",), ("the",)], "text string")
    stop = T.stopword_list(["the", "of"], [" Four ", "", "two three"])
    assert stop == ["four", "of", "the", "two three"]
    kept = df.select(T.without_stopwords(T.tokens("text"), stop).alias("t"))
    got = kept.select("t", T.bigrams("t").alias("p")).collect()
    assert [tuple(r) for r in got] == [
        (["one", "two", "three"], ["one two", "two three"]), (["single"], []), ([], []),
    ]


@pytest.mark.parametrize("value,label", [(None, ""), ("  ", ""), (" a ", "a"), ("A b", "A b")])
def test_group_label(spark, value, label):
    df = spark.createDataFrame([(value,)], "g string")
    assert df.select(T.group_label("g")).first()[0] == label


LATIN = [chr(c) for c in [*range(0x80, 0x250), *range(0x2000, 0x2070), 0x20AC, 0x300, 0x1E9E, 0x130, 0x3A3, 0xFB01, 0x1F600]]


def test_every_latin_character_is_prepared_as_python_does(spark):
    texts = [f"{c}a {c} E{c}\t{c.upper()}s" for c in LATIN]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = df.select("i", T.normalized("text"), T.lexical("text"), T.folded("text")).collect()
    assert [(n, x, f) for _, n, x, f in sorted(found)] == [(T._clean(t), T._without_accents(t), T._folded(t)) for t in texts]


def test_plain_latin_texts_need_no_python(spark):
    def refused(text):
        raise AssertionError(text)

    texts = ["Straße – “Ñandú” l’été", "plain", "ÀÖØ öøÿ ß"]
    assert column(spark, texts, T._prepared("text", refused, lambda c: c)) == texts


def test_ascii_tokens_equal_those_of_the_whole_pattern(spark):
    texts = ["it's a-b x1 9z _q q_ --a' no'", "", "a", "Ab9_'-c d'", "x" * 40, "1a2 b3-"]
    pattern = F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))
    assert column(spark, texts, T.tokens("text")) == column(spark, texts, pattern)
    assert column(spark, texts, T.word_count("text")) == [len(found) for found in column(spark, texts, pattern)]
