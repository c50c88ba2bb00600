from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexprism import DataProblem, SentimentConfig, analyze_sentiment
from lexprism.functions.stats import period_label, t_quantile
from lexprism.functions import times
from lexprism.operators import scoring as S
from lexprism.operators import sentiment as M
from lexprism.operators import lexicon as L
from lexprism.operators.lexicon import NEGATING, STRENGTHENING, WEAKENING, read_lexicon

WORDS = {"good": 1.9, "bad": -2.5, "great": 3.1, "awful": -2.0, "no": -1.2, "fine": 0.8}
LABELS = dict(human_label_column="human", positive_label="yes", negative_label="no")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, valence double")


def squeeze(total):
    return round(total / math.sqrt(total * total + 15.0), 4)


def compounds(spark, lexicon, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_key int, norm_text string")
    return [r["compound"] for r in M.document_scores(df, lexicon, **options).orderBy("doc_key").collect()]


RULES = [
    ("It was good here", 1.9),
    ("A very good day", 1.9 + 0.293),
    ("A very nice good day", 1.9 + 0.293 * 0.95),
    ("A very nice clean good day", 1.9 + 0.293 * 0.9),
    ("Slightly good", 1.9 - 0.293),
    ("Very bad", -2.5 - 0.293),
    ("That is not good", 1.9 * -0.74),
    ("It isn't really good", (1.9 + 0.293) * -0.74),
    ("never so good", (1.9 + 0.293) * 1.25),
    ("without doubt good", 1.9),
    ("This is GOOD stuff", 1.9 + 0.733),
    ("THIS IS GOOD", 1.9),
    ("a VERY good day", 1.9 + 0.293 + 0.733),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("good, but in the end", 1.9 * 0.5),
    ("good!!", 1.9 + 2 * 0.292),
    ("bad!!!!!!", -2.5 - 4 * 0.292),
    ("good??", 1.9 + 2 * 0.18),
    ("good?????", 1.9 + 0.96),
    ("good?", 1.9),
    ("no good", 1.9 * -0.74),
    ("no thanks", -1.2),
    ("no, thanks", 0.0),
    ("the least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("good bad", 1.9 - 2.5),
    ("kind of good", 1.9),
    ("nothing listed at all", 0.0),
    ("'good'", 1.9),
]


def test_every_rule(spark, lexicon):
    got = compounds(spark, lexicon, [text for text, _ in RULES])
    wrong = [(text, value, squeeze(total)) for (text, total), value in zip(RULES, got) if value != pytest.approx(squeeze(total), abs=1e-4)]
    assert not wrong


def test_a_lexicon_too_large_for_a_task_gives_the_same(spark, lexicon):
    texts = [text for text, _ in RULES]
    assert compounds(spark, lexicon, texts, in_task_limit=2) == compounds(spark, lexicon, texts)


def test_scoring_moves_no_rows(spark, lexicon):
    df = spark.createDataFrame([(1, "good")], "doc_key int, norm_text string")
    plan = M.document_scores(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_proportions(spark, lexicon):
    df = spark.createDataFrame([(1, "good day with bad rain")], "doc_key int, norm_text string")
    row = M.document_scores(df, lexicon).first()
    total = 2.9 + 3.5 + 3
    assert (row["positive"], row["negative"], row["neutral"]) == (round(2.9 / total, 3), round(3.5 / total, 3), round(3 / total, 3))


def test_word_lists_do_not_overlap():
    assert not set(STRENGTHENING) & set(WEAKENING)
    assert len(set(NEGATING)) == len(NEGATING)


@pytest.mark.parametrize("value,two,three", [(0.05, "positive", "positive"), (0.0, "positive", "neutral"), (-0.05, "negative", "negative"), (-0.01, "negative", "neutral")])
def test_label_rule(spark, value, two, three):
    df = spark.createDataFrame([(value,)], "c double")
    row = df.select(M.predicted_label(F.col("c"), True), M.predicted_label(F.col("c"), False)).first()
    assert tuple(row) == (two, three)


def test_summary_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = {"a": rng.uniform(-1, 1, 40).round(4), "b": np.array([0.5]), "c": rng.uniform(-1, 1, 3).round(4)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows + [("a", None), ("a", float("nan"))], "g string, compound double")
    got = {r["g"]: r for r in M.score_summary(df, "g").collect()}
    quantile = {"a": 2.0226909200367604, "c": 4.302652729911275}
    for g, v in values.items():
        row = got[g]
        assert row["documents"] == len(v)
        assert row["mean_compound"] == pytest.approx(v.mean()) and row["median_compound"] == pytest.approx(np.median(v))
        if g == "b":
            assert row["ci_low"] is None and row["ci_high"] is None
            continue
        reach = quantile[g] * v.std(ddof=1) / math.sqrt(len(v))
        assert (row["ci_low"], row["ci_high"]) == pytest.approx((v.mean() - reach, v.mean() + reach), abs=1e-7)
        assert row["positive_share"] == pytest.approx((v >= 0.05).mean())
        assert row["negative_share"] + row["neutral_share"] + row["positive_share"] == pytest.approx(1.0)


def test_t_quantile(spark):
    known = {1: 12.706204736, 10: 2.228138852, 30: 2.042272456, 31: 2.039513446, 100: 1.983971519, 100000: 1.959987709}
    df = spark.createDataFrame([(n,) for n in known], "n long")
    for row in df.select("n", t_quantile(F.col("n")).alias("t")).collect():
        assert row["t"] == pytest.approx(known[row["n"]], abs=1e-7)


@pytest.mark.parametrize("grain,label", [("day", "2024-12-31"), ("week", "2024-12-30/2025-01-05"), ("month", "2024-12"), ("quarter", "2024Q4")])
def test_period_labels(spark, grain, label):
    df = spark.createDataFrame([("2024-12-31 23:59:59",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert df.select(period_label(F.col("t"), grain)).first()[0] == label


def survey(spark, count=120):
    rows = []
    for i in range(count):
        good = i % 2 == 0
        rows.append(
            (
                "a great and good service" if good else "an awful and bad service",
                f"2026-{1 + i % 2:02d}-{1 + i % 20:02d}",
                None if i == 3 else ("" if i == 5 else ("A" if i < 60 else " B ")),
                "yes" if good else "no",
            )
        )
    return spark.createDataFrame(rows, "text string, day string, brand string, human string")


def test_time_dimensions_and_validation(spark, lexicon):
    config = SentimentConfig("text", time_column="day", dimensions=("brand",), **LABELS)
    found = analyze_sentiment(survey(spark), config, lexicon)
    assert [r["period"] for r in found.time_summary.collect()] == ["2026-01", "2026-02"]
    levels = {r["level"]: r["documents"] for r in found.dimension_summary.collect()}
    assert levels == {"(missing)": 1, "": 1, "A": 58, "B": 60}
    row = found.validation_summary.first()
    assert (row["status"], row["labeled_documents"], row["macro_f1"]) == ("LOCALLY SUPPORTED", 120, 1.0)
    assert found.document_scores.count() == 120
    assert "raw_text" not in found.document_scores.columns
    assert found.overall.first()["scope"] == "all usable documents"
    assert [r["code"] for r in found.warnings.collect()] == ["fixed_lexicon", "duplicates"]


def test_without_labels_the_signal_is_unvalidated(spark, lexicon):
    df = spark.createDataFrame([("same great review",)] * 19 + [("Same GREAT review",)], "text string")
    found = analyze_sentiment(df, SentimentConfig("text", voluntary_reviews=True), lexicon)
    assert found.validation_summary.first()["status"] == "UNVALIDATED LEXICON SIGNAL"
    assert found.validation_by_class.count() == 0 and found.confusion.count() == 0
    assert found.time_summary.count() == 0 and found.dimension_summary.count() == 0
    messages = {r["code"]: r["message"] for r in found.warnings.collect()}
    assert "voluntary_reviews" in messages and messages["duplicates"].startswith("100.0%")


def test_unreadable_times_are_counted_and_left_out(spark, lexicon):
    df = survey(spark, 40).withColumn("day", F.when(F.col("human") == "no", "soon").otherwise(F.col("day")))
    found = analyze_sentiment(df, SentimentConfig("text", time_column="day", time_grain="quarter"), lexicon)
    assert [(r["period"], r["documents"]) for r in found.time_summary.collect()] == [("2026Q1", 20)]
    messages = {r["code"]: r["message"] for r in found.warnings.collect()}
    assert "50.0%" in messages["unreadable_times"]


@pytest.mark.parametrize(
    "config",
    [
        SentimentConfig("text", time_grain="year"),
        SentimentConfig("text", dimensions=("nope",)),
        SentimentConfig("nope"),
        SentimentConfig("text", time_column="nope"),
        SentimentConfig("text", human_label_column="nope", positive_label="a", negative_label="b"),
        SentimentConfig("text", human_label_column="human", positive_label="a"),
    ],
)
def test_bad_roles_are_refused(spark, lexicon, config):
    with pytest.raises(DataProblem):
        analyze_sentiment(survey(spark, 30), config, lexicon)


def test_too_few_documents_are_refused(spark, lexicon):
    with pytest.raises(DataProblem, match="20"):
        analyze_sentiment(survey(spark, 19), SentimentConfig("text"), lexicon)


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("good\t1.9\t0.9\t[1, 2]\n:)\t2.0\t0.5\t[2]\nnumber\tx\n")
    assert {tuple(r) for r in read_lexicon(spark, str(tmp_path)).collect()} == {("good", 1.9), (":)", 2.0)}


def test_further_time_formats(spark):
    df = spark.createDataFrame([("2025-01-05",), ("1/6/2025",), ("7 Jan 2025",), ("soon",), (None,)], "t string")
    read = df.select("t", M.parsed_time("t", ("M/d/yyyy", "d MMM yyyy")).cast("date").cast("string").alias("day"))
    assert [r["day"] for r in read.collect()] == ["2025-01-05", "2025-01-06", "2025-01-07", None, None]
    assert M.time_parse_rate(df, "t").first()[0] == 0.2 and M.time_parse_rate(df, "t", ("M/d/yyyy",)).first()[0] == 0.4


def test_summary_is_exact_whatever_the_partitions(spark):
    values = [0.1234, -0.9999, 0.5, 0.0001] * 500
    df = spark.createDataFrame([(v,) for v in values], "compound double")
    one, many = (M.score_summary(df.repartition(n)).first() for n in (1, 7))
    assert one == many
    assert one["mean_compound"] == sum(round(v * 10_000) for v in values) / (10_000 * len(values))


def test_words_join_like_the_lookup_in_the_task(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.5)], "word string, valence double")
    df = spark.createDataFrame([(1, ["good", "x", "bad", "good"]), (2, []), (3, ["y"])], "doc_key long, words array<string>")
    joined = {r["doc_key"]: r["valences"] for r in L.joined_valences(df, lexicon).collect()}
    assert joined == {1: [2.0, None, -1.5, 2.0], 2: [], 3: [None]}


PHRASED = [
    ("it was really the bomb stuff", {"bomb": 1.0}, 3.0),  # the phrase goes over the word and its boosters
    ("it was really the bomb bad stuff", {"bomb": 1.0}, 6.0),  # and over a listed word right behind it
    ("so what about broken heart today", {"heart": 1.0}, -2.9),
    ("one two kiss of death now", {"kiss": 2.0}, 2.0),  # no word three places before it: phrases are not looked at
    ("one two three kiss of death now", {"kiss": 2.0}, -1.5),  # a phrase that begins at the word
    ("we were just enough good", {"good": 2.0}, 2.0 - 0.293),
    ("he is sort of good", {"good": 2.0}, 2.0 - 0.293),
    ("good day is sort of good", {"good": 2.0}, 4.0 - 0.293),
]


@pytest.mark.parametrize("text, words, total", PHRASED)
def test_phrases(spark, text, words, total):
    listed = spark.createDataFrame(list(words.items()) + [("bad", 0.0)], "word string, valence double")
    df = spark.createDataFrame([(1, text)], "doc_key int, norm_text string")
    assert M.document_scores(df, listed).first()["compound"] == pytest.approx(squeeze(total), abs=1e-4)


def test_phrases_have_two_or_three_words(spark, lexicon):
    with pytest.raises(ValueError, match="two or three"):
        S.Rules(M.ScoreRules(phrases=(("one", 1.0),)), ["a"], [1.0]).phrases


def test_emoji_are_spelled_out(spark, lexicon):
    emoji = spark.createDataFrame([("😀", "good face"), ("💔", "broken heart"), ("xy", "two characters")], "emoji string, description string")
    texts = ["plain", "😀", "a😀b", "a 😀😀 c", "x 💔", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_key int, norm_text string")
    read = [r["norm_text"] for r in L.with_emoji_words(df, emoji).orderBy("doc_key").collect()]
    assert read == ["plain", "good face", "a good faceb", "a good face good face c", "x broken heart", None, ""]
    assert [r["norm_text"] for r in L.with_emoji_words(df, emoji.limit(0)).orderBy("doc_key").collect()] == texts


def plain_score(text, words, rules):
    """One word after the other, as the rule is published."""
    tokens = [t if len(t.strip(S.PUNCTUATION)) <= 2 else t.strip(S.PUNCTUATION) for t in text.split(" ")]
    low = [t.lower() for t in tokens]
    boosts = {w: rules.booster for w in rules.strengthening} | {w: -rules.booster for w in rules.weakening}
    loud = [t.upper() == t and t.lower() != t for t in tokens]
    mixed = 0 < sum(loud) < len(tokens)
    phrases, shifts = dict(rules.phrases), dict(rules.phrase_boosts)
    sign = lambda v: -1.0 if v < 0 else 1.0
    out = []
    for i, w in enumerate(low):
        v = words.get(w)
        if v is None or w in boosts or (w == "kind" and low[i + 1 : i + 2] == ["of"]):
            out.append(0.0)
            continue
        back = lambda k: low[i - k] if i >= k else ""
        if "no" in (back(1), back(2)) or (back(3) == "no" and back(1) in ("or", "nor")):
            v *= rules.negation
        elif w == "no" and i + 1 < len(low) and low[i + 1] in words:
            v = 0.0
        if loud[i] and mixed:
            v += rules.capitals * sign(v)
        for k in (1, 2, 3):
            if i < k or back(k) in words:
                continue
            if back(k) in boosts:
                s = sign(v)
                v += (boosts[back(k)] * s + (rules.capitals * s if loud[i - k] and mixed else 0.0)) * rules.distance_scale[k - 1]
            emphatic = k > 1 and back(k) == "never" and back(k - 1) in ("so", "this") or k == 3 and back(1) in ("so", "this")
            sure = k > 1 and back(k) == "without" and "doubt" in [back(j) for j in range(1, k)]
            if emphatic:
                v *= rules.never_so
            elif not sure and (back(k) in rules.negating or "n't" in back(k)):
                v *= rules.negation
            if k == 3:
                joined = lambda a, b: " ".join(low[i + a : i + b + 1])
                for seq in (joined(-1, 0), joined(-2, 0), joined(-2, -1), joined(-3, -1), joined(-3, -2)):
                    if seq in phrases:
                        v = phrases[seq]
                        break
                for far in (1, 2):
                    if i + far < len(low) and joined(0, far) in phrases:
                        v = phrases[joined(0, far)]
                for seq in (joined(-3, -1), joined(-3, -2), joined(-2, -1)):
                    v += shifts.get(seq, 0.0)
        if back(1) == "least" and back(1) not in words and back(2) not in ("at", "very"):
            v *= rules.negation
        out.append(v)
    if rules.contrast in low:
        at = low.index(rules.contrast)
        out = [v * (rules.before_but if i < at else rules.after_but if i > at else 1.0) for i, v in enumerate(out)]
    marks = text.count("?")
    extra = min(text.count("!"), 4) * rules.exclamation + (rules.question_cap if marks > 3 else marks * rules.question if marks > 1 else 0)
    raw = sum(out)
    raw += extra * (raw > 0) - extra * (raw < 0)
    return raw / math.sqrt(raw * raw + rules.normalising)


def test_kernel_equals_word_by_word_scoring(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 700)
    draw = __import__("random").Random(4)
    pool = "good GOOD bad! great, no nor or never so this without doubt kind of least at very VERY but not isn't slightly x Y z. 'no' the bomb sort kiss death été ÉTÉ".split()
    rules = M.ScoreRules(phrases=M.RULES.phrases + (("of least", -1.0), ("very good", 2.5), ("x bad great", 0.5)))
    texts = [" ".join(draw.choices(pool, k=draw.randint(1, 25))) + draw.choice(["", "!", "??", "????"]) for _ in range(400)]
    texts += ["", "good " * 30_000 + "x"]
    words = WORDS | {"least": 0.3, "death": -2.9, "été": 1.1}
    listed = spark.createDataFrame(list(words.items()), "word string, valence double")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_key int, norm_text string").repartition(3)
    near = {r["doc_key"]: r["compound"] for r in M.document_scores(df, listed, rules).collect()}
    far = {r["doc_key"]: r["compound"] for r in M.document_scores(df, listed, rules, in_task_limit=1).collect()}
    assert near == far
    assert all(near[i] == pytest.approx(plain_score(t, words, rules), abs=1e-4) for i, t in enumerate(texts))


FORMS = [
    ("2025-01-05", "2025-01-05 00:00:00"), ("2025/1/5 7:08", "2025-01-05 07:08:00"), ("20250105", "2025-01-05 00:00:00"),
    ("1/5/2025", "2025-01-05 00:00:00"), ("1/25/2025 11:05 PM", "2025-01-25 23:05:00"), ("12/31/2024 12:30:15 am", "2024-12-31 00:30:15"),
    ("5.1.2025", "2025-01-05 00:00:00"), ("31.12.2024 23:59", "2024-12-31 23:59:00"), ("5 Jan 2025", "2025-01-05 00:00:00"),
    ("5-January-2025", "2025-01-05 00:00:00"), ("Jan 5, 2025", "2025-01-05 00:00:00"), ("Sun, 05 Jan 2025 10:20:30 +0200", "2025-01-05 08:20:30"),
    ("2025-01-05T10:20:30.25Z", "2025-01-05 10:20:30.25"), ("2025-01-05 10:20:30+05:30", "2025-01-05 04:50:30"), ("September 3rd, 2024", "2024-09-03 00:00:00"),
    ("13/13/2025", None), ("soon", None), ("", None), (None, None), ("5 Smarch 2025", None), ("2025-02-30", None), ("1/5/2025 25:00", None),
    ("1/5/2025 13:00 PM", None),
]


def test_mixed_time_forms(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "i int, t string")
    days_first = times.day_first(df, "t")
    assert days_first == {"."}  # 31.12. decides for all rows with dots; slashes go by the month first
    read = df.select("i", times.mixed_time("t", days_first).cast("string").alias("at")).orderBy("i").collect()
    assert [r["at"] for r in read] == [at for _, at in FORMS]
    assert times.day_first(df.limit(0), "t") == frozenset()


def test_analysis_reads_mixed_times(spark, lexicon):
    rows = [(f"good day {i}", ["2025-01-05", "1/6/2025", "7 Jan 2025", "soon"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, at string")
    found = analyze_sentiment(df, SentimentConfig("text", time_column="at", time_grain="day"), lexicon)
    assert [r["period"] for r in found.time_summary.collect()] == ["2025-01-05", "2025-01-06", "2025-01-07"]


def test_texts_are_scored_a_megabyte_at_a_time(monkeypatch):
    import pyarrow as pa

    from lexprism.operators import scoring

    held, part = [], scoring._part
    monkeypatch.setattr(scoring, "_part", lambda texts, *rest: held.append(texts.nbytes) or part(texts, *rest))
    ready = scoring.Rules(M.RULES, ["good"], [2.0])
    texts = pa.array(["good bad " * 100] * 5_000)
    found = scoring.score_sums(texts, None, ready)
    assert len(found) == 5_000 and max(held) < 1.2e6
    assert found[0] == found[4_999] == part(texts.slice(0, 1), None, ready)[0]
