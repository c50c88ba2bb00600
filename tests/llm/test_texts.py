"""Quality, language, secrets, chat formatting, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from lexprism.llm.chat import ASSISTANT, escaped, format_examples, read_back, unescaped
from lexprism.llm.language import identify, predict_languages, train_languages
from lexprism.llm.mixing import entropy, exponent_for, mix_sources, repetition, shared_target, tempered
from lexprism.llm.quality import features, in_fold, keep_quality, score_quality, train_quality
from lexprism.llm.secrets import findings, redact_secrets, scan_secrets
from pyspark.sql import functions as F


# --- quality --------------------------------------------------------------


def marked_documents(spark, count: int = 600):
    draw = random.Random(3)
    words = "river stone bridge garden window morning letter answer winter summer people story".split()
    rows, labels = [], []
    for k in range(count):
        good = draw.random() < 0.8
        said = draw.choices(words, k=draw.randint(5, 80))
        text = " ".join(said) if good else draw.choice([" ".join(w + "%%%" for w in said), " ".join([said[0]] * 40), " | ".join(said)])
        rows.append((k, text, 0.5))
        if k % 2 == 0:
            labels.append((k, int(good)))
    labels += [(None, 1), (2, None), (4, labels[2][1]), (99_999, 1)]
    good = {k: t for k, t in enumerate(r[1] for r in rows)}
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int"), good


def test_quality_on_held_out_rows(spark):
    docs, labels, _ = marked_documents(spark)
    model = train_quality(docs, labels)
    truth = labels.where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    scored = score_quality(docs, model).join(truth, "doc_id").where(in_fold("doc_id", 5, 0))
    wrong = scored.where("predicted <> quality").count()
    assert scored.count() > 30 and wrong <= 1
    assert keep_quality(docs, model).columns == docs.columns
    assert keep_quality(docs, model).count() == score_quality(docs, model).where("predicted = 1").count()


def test_quality_never_learns_from_the_held_out_fold(spark):
    docs, labels, _ = marked_documents(spark)
    turned = labels.withColumn("quality", F.when(in_fold("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = train_quality(docs, labels), train_quality(docs.repartition(7), turned)
    assert (first.weights == second.weights).all() and first.constant == second.constant
    assert [r.doc_id for r in docs.where(in_fold("doc_id", 5, 0)).collect()] == [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]


def test_quality_of_odd_texts(spark):
    docs, labels, _ = marked_documents(spark, 200)
    model = train_quality(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "w" * 200_000), (None, "x y"), (4, "w")], "doc_id long, text string")
    scores = [r.score for r in score_quality(odd, model).collect()]
    assert len(scores) == 6 and all(0 <= x <= 1 for x in scores) and scores[0] == scores[1] == scores[2]
    empty = train_quality(docs.limit(0), labels)
    assert empty.score("anything") == 0.5
    assert train_quality(docs, labels.where("quality = 1")).score("anything") > 0.99
    assert score_quality(odd.limit(0), model).count() == 0
    assert len(features("a b a b")[0]) == 4 and len(features(None)[0]) == 0


# --- language -------------------------------------------------------------

SYLLABLES = {"aa": "la mi do re so".split(), "bb": "kra str pff gno zwi".split(), "cc": "euh oui eau tion ent".split()}


def spoken(spark, count: int = 400):
    draw = random.Random(6)
    rows = []
    for k in range(count):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(4, 300))]
        rows.append((k, " ".join(words), lang if k % 9 else None, lang, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, lang_pred string")


def test_languages_on_held_out_rows(spark):
    docs = spoken(spark)
    dictionaries = train_languages(docs)
    assert list(dictionaries) == sorted(SYLLABLES)
    found = predict_languages(docs, dictionaries).join(docs.select("doc_id", "truth"), "doc_id").where(in_fold("doc_id", 4, 2))
    assert found.count() > 60 and found.where("lang_pred = truth").count() >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0
    turned = docs.withColumn("lang", F.when(in_fold("doc_id", 4, 2), "zz").otherwise(F.col("lang")))
    assert train_languages(turned.repartition(5)) == dictionaries


def test_languages_of_odd_texts(spark):
    dictionaries = train_languages(spoken(spark, 120))
    odd = [(1, None), (2, ""), (3, "123 !! ½"), (4, "la " * 50_000), (4, "mi"), (None, "é"), (6, "strstr")]
    found = predict_languages(spark.createDataFrame(odd, "doc_id long, text string"), dictionaries).collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and [r.score for r in found[:3]] == [0.0] * 3
    assert found[3].lang_pred == "aa" and all(r.lang_pred in dictionaries for r in found[3:])
    assert train_languages(spoken(spark, 10).limit(0)) == {} and identify("abc", (), 0.1) == ("und", 0.0, False)


# --- secrets --------------------------------------------------------------


def spans(text):
    return [(f["kind"], f["start"], f["end"]) for f in findings(text, 200)]


def test_base_findings():
    key = "AKIA" + "B" * 14
    text = f'é PassWord = "abcdefghijkl" {key} {"0f" * 8} token: short AKIASHORT {"a" * 15}'
    assert spans(text) == [
        ("assign", 2, 26), ("access", 28, 46), ("hex", 47, 63),
    ]
    assert spans("secret: token: abcdefghijklmnop") == []  # the first match takes the second keyword
    assert spans("api_key='" + "1" * 16 + "'") == [("assign", 0, 25), ("hex", 9, 25)]
    assert spans("tokÅen: abcdefghijklmnop ſecret=abcdefghijklmnop") == []  # letters in either case are ASCII letters
    assert spans(None) == [] and spans("") == []


def test_weak_parts_are_reported_only_together():
    opaque = "Zx9" + "aB3" * 10
    assert spans(f"text {opaque} text") == [] and spans("user: alice_b") == [] and spans("see https://db.example.com/x") == []
    linked = spans(f"user: alice_b\npwd: hunter2!\nhttps://db.example.com/x")
    assert [k for k, *_ in linked] == ["linked_id", "linked_secret", "linked_endpoint"]
    assert spans(f"user: alice_b\n\npwd: hunter2!") == []  # another scope
    assert spans("user: alice_b " + "x " * 200 + "pwd: hunter2!") == []  # out of reach
    assert [k for k, *_ in spans(f"AKIA{'C' * 16} {opaque}")] == ["access", "linked_secret"]


def test_weak_parts_in_env_form():
    value = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzzzzzzzKEY"
    text = f"AWS_ACCESS_KEY_ID=AKIA{'C' * 16}\nexport AWS_SECRET_ACCESS_KEY={value}"
    assert [(k, text[a:b]) for k, a, b in spans(text)] == [("access", "AKIA" + "C" * 16), ("linked_secret", value)]
    for user, secret in [("DB_USER=admin", "DB_PASSWORD=hunter2"), ("mysql-user=root", "MYSQL_PWD=hunter2"), ("SMTP_LOGIN: me_1", "SMTP_PASSWD: hunter2")]:
        assert [k for k, *_ in spans(f"{user}\n{secret}")] == ["linked_id", "linked_secret"]
        assert spans(user) == [] and spans(secret) == []
    urlsafe = "ab-Cd_12" * 4
    assert [k for k, *_ in spans(f"CLIENT_ID=my-app\nKEY={urlsafe}")] == ["linked_id", "linked_secret"]
    assert [k for k, *_ in spans(f"APP_KEY={urlsafe} https://db.example.com/x")] == ["linked_secret", "linked_endpoint"]
    assert spans(f"CLIENT_ID={urlsafe}") == [] and spans(f"KEY={urlsafe}") == []  # one part alone
    assert spans("compass=northern superuser=admin") == []  # other words that end alike


def test_scope_alone_bounds_links(spark):
    settings = "client_id: my_app\n" + "option: on\n" * 100 + "pwd: hunter2!"
    df = spark.createDataFrame([(1, settings), (2, settings.replace("option: on\n", "\n", 2))], "doc_id long, text string")
    found = {r.doc_id: [f.kind for f in r.findings] for r in scan_secrets(df).collect()}
    assert found == {1: ["linked_id", "linked_secret"], 2: []}


def test_scan_and_redact(spark):
    rows = [(1, "pwd token = abcdefghijklmnop end", "k"), (2, None, "k"), (3, "", "k"), (1, "clean text", "k"), (4, "x " * 100_000 + "f" * 20, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings string")
    found = scan_secrets(df).collect()
    assert [[f.kind for f in r.findings] for r in found] == [["assign"], [], [], [], ["hex"]]
    texts = [r.text for r in redact_secrets(df).collect()]
    assert texts[:4] == ["pwd token = [SECRET] end", None, "", "clean text"] and texts[4].endswith("x [SECRET]")
    assert redact_secrets(df).columns == df.columns and scan_secrets(df.limit(0)).count() == 0


# --- chat -----------------------------------------------------------------


def test_escaping_is_reversible(spark):
    texts = ["\\l", "<\\b>", "\\### Assistant: </turn> ok", "<turn assistant>\n", "\\\\<<>>\\g", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<" not in r.e and ">" not in r.e for r in row)


def test_examples_read_back(spark):
    draw = random.Random(7)
    rows = []
    for conversation in [*range(30), None]:
        for turn in range(draw.randint(1, 9)):
            text = draw.choice([None, "", "hi </turn>\n<turn user>\n", "\\l \\b <", "été \U0001f642", "word " * 30])
            rows.append((conversation, turn, draw.choice(["user", "assistant", "system", None, "a>b"]), text, "x"))
    rows += [(40, 1, "assistant", "same", "x"), (40, 1, "assistant", "same", "x"), (40, None, "user", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(4)
    examples = format_examples(df)
    found = {r.conv_id: r for r in read_back(examples).collect()}
    assert set(found) == {r[0] for r in rows}
    for conversation, row in found.items():
        turns = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in rows if t[0] == conversation))
        assert [(t.role, t.text) for t in row.turns] == [(r, t) for _, r, t in turns]
        assert row.replies == [t for _, r, t in turns if r == ASSISTANT]
    for e in examples.where("conv_id = 40").collect():
        under = e.formatted[e.loss_start : e.loss_end]
        assert under == "same" and e.formatted[e.loss_end :] == "</turn>\n"
    assert format_examples(df.limit(0)).count() == 0
    plan = read_back(examples)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- mixing ---------------------------------------------------------------


def test_exponent_meets_entropy_and_repetition():
    shares = [0.6, 0.3, 0.08, 0.02]
    x = exponent_for(shares, 0.9, None)
    assert 0 < x < 1 and abs(entropy(tempered(shares, x)) - 0.9 * math.log(4)) < 1e-9
    y = exponent_for(shares, 0.99, 2.0)
    assert abs(repetition(shares, tempered(shares, y)) - 2.0) < 1e-9
    assert exponent_for(shares, None, None) == 1.0 and exponent_for([1.0], 0.9, 2.0) == 1.0
    assert exponent_for([0.25] * 4, 0.9, 2.0) == 1.0


@pytest.mark.parametrize("pipeline", [False, True])
def test_sources_are_mixed_by_tokens(spark, tmp_path, pipeline):
    """A source of texts without blanks has the share of its tokens, not one word a text."""
    import corpus_pipeline
    from lexprism.llm.queries import QUERIES, TOKENIZER
    from lexprism.llm.token_counts import counted

    rows = [(k, "plain words of prose " * 5, "en", "prose", 105) for k in range(60)]
    rows += [(100 + k, f"{k}Zx9/aB3+" * 60, "en", "dense", 480) for k in range(30)] + [(200, "", "en", "empty", 0), (201, None, "en", "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    n = dict(zip((r[0] for r in rows), counted([r[1] or "" for r in rows], TOKENIZER).tolist()))
    sums: dict = {}
    for doc, _, _, source, _ in rows:
        sums[source] = sums.get(source, 0) + max(1, n[doc])
    shares = [t / sum(sums.values()) for t in sums.values()]
    weights = dict(zip(sums, tempered(shares, exponent_for(shares, shared_target(shares, 0.5), 2.0))))
    if pipeline:
        drawn = corpus_pipeline.mixing(spark, df, "").collect()
        budget = max(sums[s] / w for s, w in weights.items())
        for source, weight in weights.items():
            spent = [max(1, n[r.doc_id]) for r in drawn if r.source == source]
            assert budget * weight - 1 <= sum(spent) < budget * weight + max(spent)
    else:
        df.write.parquet(f"{tmp_path}/documents.parquet")
        drawn = QUERIES["op3_source_mixing"](spark, str(tmp_path)).collect()
        assert all(r.mix_tokens == max(1, n[r.doc_id]) and abs(r.mix_weight - weights[r.source]) < 1e-9 for r in drawn)
    assert {r.doc_id for r in drawn} == set(n)


def test_mixing_meets_its_budgets(spark):
    draw = random.Random(2)
    rows = [(k, "w " * draw.randint(1, 60), "big" if k % 3 else f"s{k % 7}", "x") for k in range(900)]
    rows += [(900, None, None, "x"), (901, "", None, "x"), (5, "w", "big", "x"), (5, "w", "big", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rest string").repartition(5)
    found = mix_sources(df, target_entropy=0.97, most_repeats=3.0)
    assert found.columns == [*df.columns, "mix_copy", "mix_block", "mix_tokens", "mix_weight"]
    drawn = found.toPandas()
    assert set(drawn["doc_id"]) == {r[0] for r in rows}
    tokens: dict = {}
    for _, text, source, _ in rows:
        tokens[source] = tokens.get(source, 0) + max(1, len((text or "").split()))
    whole = sum(tokens.values())
    names = sorted(tokens, key=lambda n: n or "")
    shares = [tokens[n] / whole for n in names]
    weights = tempered(shares, exponent_for(shares, 0.97, 3.0))
    budget = max(t / w for t, w in zip([tokens[n] for n in names], weights))
    drawn["named"] = drawn["source"].fillna("-")
    for name, weight in zip(names, weights):
        part = drawn[drawn["named"] == (name or "-")]
        assert abs(part["mix_weight"].iat[0] - weight) < 1e-9
        assert budget * weight - 1 <= part["mix_tokens"].sum() + 0.5 and part["mix_tokens"].sum() < budget * weight + 62
    copies = drawn[drawn["doc_id"] != 5].groupby("doc_id")["mix_copy"]
    assert (copies.max() + 1 == copies.count()).all()
    again = mix_sources(df.repartition(2), target_entropy=0.97, most_repeats=3.0).toPandas()
    key = ["doc_id", "mix_copy", "mix_tokens"]
    assert again[key].sort_values(key).values.tolist() == drawn[key].sort_values(key).values.tolist()


def test_mixing_with_a_given_budget_and_of_nothing(spark):
    df = spark.createDataFrame([(k, "w " * 10, f"s{k % 2}") for k in range(200)], "doc_id long, text string, source string")
    small = mix_sources(df, budget_tokens=500).groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()
    assert [r.n for r in small] == [250, 250]
    assert mix_sources(df.limit(0)).count() == 0
    clash = mix_sources(df.withColumns({"mix_copy": F.lit("a"), "row": F.lit(1)}))
    assert clash.count() == 200 and clash.schema["mix_copy"].dataType.simpleString() == "int"


# --- pipeline and queries -------------------------------------------------

SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert 0 < docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", ["op1_exact_top_k", "op6_chat_formatting"])
def test_check_sql(spark, name):
    import duckdb
    from lexprism.llm.queries import ORACLES, QUERIES

    base = duckdb.connect()
    for table in ("embeddings", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = base.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(expected.fetchall())


def test_digest_queries_against_plain_code(spark):
    from lexprism.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({keyword})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for row in QUERIES["op10_secret_scan"](spark, SMALL).collect():
        text = texts[row.doc_id]
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        joined = ",".join(f[2] for f in sorted(found))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
    ids = sorted(texts)
    for row in QUERIES["op5_document_fingerprints"](spark, SMALL).collect():
        text, after = texts[row.doc_id], texts[ids[(ids.index(row.doc_id) + 1) % len(ids)]]
        quarter = len(text) // 4
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - quarter] + after[:quarter]).encode()).hexdigest()
