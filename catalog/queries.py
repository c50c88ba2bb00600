"""Registered queries: one per inventory entry, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexprism import SentimentConfig, analyze_sentiment, audit_corpus, build_evidence_pack
from lexprism.config import DataProblem
from lexprism.functions import text as T
from lexprism.functions.times import day_first, mixed_time
from lexprism.operators import audit as A
from lexprism.operators import contrast as C
from lexprism.operators import corpora as K
from lexprism.operators import decision as D
from lexprism.operators import sentiment as M
from lexprism.operators import validation as H
from lexprism.operators import vocabulary as V
from lexprism.operators.documents import keyed_texts, stopwords_of, token_table
from lexprism.operators.topics import comparison as N
from lexprism.operators.topics import sampling as S
from lexprism.operators.topics import stability as B
from lexprism.operators.topics import tables as P
from lexprism.plans.sentiment import scored_documents, sentiment_warnings
from lexprism.plans.evidence import read_json_evidence, write_csv_evidence, write_json_evidence
from lexprism.plans.text_analysis import analyze_text, diagnostics_row, prevalence_table
from lexprism.session import evened, materialise, pin_utc, scratch_path
from lexprism.sources import readers as R
from lexprism.sources import writers as W

from .fixtures import EMBEDDING_TOPICS, EMOJI, HUMAN, HUMAN_THREE, LEXICON, PAIR, PHRASED, RULES, SAMPLES, TEXT, WORDS_ONLY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_KEPT: dict[tuple, object] = {}


def registered(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def kept(function):
    """Reuse an intermediate table or model within one application."""

    def once(spark: SparkSession, sf_dir: str, *args):
        key = (spark.sparkContext.applicationId, sf_dir, function.__name__, *args)
        if key not in _KEPT:
            _KEPT[key] = function(spark, sf_dir, *args)
        return _KEPT[key]

    return once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- shared intermediates -------------------------------------------------


@kept
def tokens(spark, sf_dir, config):
    return materialise(token_table(keyed_texts(table(spark, sf_dir, "documents"), config), config), "tokens")


@kept
def vocabulary(spark, sf_dir, config):
    return V.fit_vocabulary(tokens(spark, sf_dir, config), config)


@kept
def matrix(spark, sf_dir, config):
    return materialise(V.term_matrix(tokens(spark, sf_dir, config), vocabulary(spark, sf_dir, config)), "matrix")


@kept
def profile(spark, sf_dir):
    return materialise(A.document_profile(table(spark, sf_dir, "documents"), "text", "doc_id", "lang"), "profile")


@kept
def model(spark, sf_dir):
    usable = V.coverage(matrix(spark, sf_dir, TEXT)).first()["usable_documents"]
    return N.fit_topics(matrix(spark, sf_dir, TEXT), vocabulary(spark, sf_dir, TEXT), TEXT, usable)


@kept
def single_fit(spark, sf_dir):
    usable = V.coverage(matrix(spark, sf_dir, TEXT)).first()["usable_documents"]
    return N.fit_one(matrix(spark, sf_dir, TEXT), vocabulary(spark, sf_dir, TEXT), TEXT, usable)


@kept
def shares(spark, sf_dir):
    return materialise(P.document_shares(single_fit(spark, sf_dir).document_weights()), "shares")


@kept
def analysis(spark, sf_dir):
    return analyze_text(table(spark, sf_dir, "documents"), TEXT)


@kept
def corpus_audit(spark, sf_dir):
    return audit_corpus(table(spark, sf_dir, "documents"), "text", "doc_id", "lang")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


def described_documents(spark, sf_dir) -> DataFrame:
    """Documents with an order date as time and labels as human marks."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    documents = evened(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return documents.join(orders, "doc_id", "left").join(labels, "doc_id", "left")


@kept
def scores(spark, sf_dir):
    found = scored_documents(described_documents(spark, sf_dir), HUMAN, lexicon(spark), "doc_id", RULES)
    return materialise(found, "scores")


@kept
def event_scores(spark, sf_dir):
    """Scores of documents next to the time of the event with the same number."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "event_type")
    documents = evened(table(spark, sf_dir, "documents").select("doc_id", "text")).join(events, "doc_id", "left")
    config = SentimentConfig("text", time_column="ts", dimensions=("event_type",))
    return materialise(scored_documents(documents, config, lexicon(spark), "doc_id", RULES), "scores")


# --- sources and sinks ----------------------------------------------------


@registered
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "documents.csv")
    options = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    table(spark, sf_dir, "documents").write.options(**options).csv(path)
    return R.read_csv(spark, path).select(
        F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")
    )


def _json_files(df: DataFrame, name: str, wrap: bool) -> str:
    """One JSON file per hundred consecutive keys: an array, or an object holding one."""
    rows = F.collect_list(F.struct(*df.columns))
    chunks = df.groupBy(F.floor(F.col("doc_id") / 100).alias("chunk"))
    content = F.to_json(F.struct(rows.alias("data"))) if wrap else F.to_json(rows)
    path = scratch_path(df.sparkSession, name)
    chunks.agg(content.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@registered
def json_array_source(spark, sf_dir):
    path = _json_files(table(spark, sf_dir, "documents"), "documents.json", wrap=False)
    return R.read_json(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@registered
def json_data_source(spark, sf_dir):
    path = _json_files(table(spark, sf_dir, "documents"), "documents.json", wrap=True)
    return R.read_json(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@registered
def line_source(spark, sf_dir):
    path = scratch_path(spark, "documents.txt")
    ordered = table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select(T.normalized("text").alias("value")).write.text(path)
    return R.read_lines(spark, path)


@registered
def file_fingerprints(spark, sf_dir):
    return R.file_fingerprints(spark, f"{sf_dir}/documents.parquet")


@registered
def written_file_fingerprints(spark, sf_dir):
    """Hashes of written text files that hold the ids of one source each."""
    ids = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("value"), "doc_id")
    path = scratch_path(spark, "ids")
    dealt = ids.repartition("source").sortWithinPartitions("source", "doc_id")
    dealt.select("source", "value").write.partitionBy("source").text(path)
    return R.file_fingerprints(spark, path).select("source_sha256")


@registered
def content_fingerprint(spark, sf_dir):
    return R.content_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@registered
def formula_neutralisation(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (-F.col("doc_id")).alias("negative_number"),
        (-F.col("doc_id")).cast("string").alias("negative_text"),
        F.concat(F.lit(" \t="), "lang").alias("=formula"),
        F.concat(F.lit("@"), "source").alias("mention"),
    )
    return W.neutralize_formulas(cells).withColumnRenamed("'=formula", "safe_formula")


@registered
def json_evidence(spark, sf_dir):
    """Aggregates with non-finite values, written as JSON and read back."""
    by_source = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("documents"),
        F.max("n_chars").alias("longest"),
        F.count_if(F.col("n_chars") < 500).alias("short"),
    )
    infinite = F.when(F.col("short") == 0, F.lit(float("inf"))).otherwise(F.col("documents") / F.col("short"))
    undefined = F.when(F.col("documents") > 45, F.lit(float("nan"))).otherwise(F.lit(0.5))
    made = by_source.select("source", "documents", infinite.alias("per_short"), undefined.alias("undefined"))
    path = scratch_path(spark, "evidence")
    W.write_json_table(made, path)
    read = spark.read.schema("source string, documents long, per_short double, undefined double").json(path)
    return rounded(read, 6, "per_short")


def _pack(spark, sf_dir):
    audit, text = corpus_audit(spark, sf_dir), analysis(spark, sf_dir)
    contract = {"text_column": "text", "unit": "doc_id", "group": "lang", "research_question": "fixture"}
    source = R.content_fingerprint(table(spark, sf_dir, "documents")).first().asDict()
    decision = D.decide(audit.summary, text.diagnostics)
    return build_evidence_pack(
        spark, source=source, contract=contract, audit=audit, analysis=text, decision=decision
    )


@registered
def evidence_manifest(spark, sf_dir):
    path = scratch_path(spark, "evidence")
    write_json_evidence(_pack(spark, sf_dir), path)
    written = spark.read.json(f"{path}/manifest")
    return written.select(
        "schema", *[F.col(f"analysis_diagnostics.{name}") for name in ("source_rows", "nonblank_documents", "vocabulary_size", "contrast_design")],
        F.size("undocumented_fields").alias("undocumented"),
    )


@registered
def evidence_tables(spark, sf_dir):
    """Rows of each table as the manifest of a finished pack lists them, after the check of all digests."""
    path = scratch_path(spark, "evidence")
    write_json_evidence(_pack(spark, sf_dir), path)
    manifest, _ = read_json_evidence(spark, path)
    listed = [(name, told["rows"]) for name, told in manifest["tables"].items()]
    return spark.createDataFrame(listed, "table string, rows long")


@registered
def evidence_csv_bundle(spark, sf_dir):
    """Rows per table of a written bundle."""
    pack, path = _pack(spark, sf_dir), scratch_path(spark, "bundle")
    write_csv_evidence(pack, path)
    files = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True)
    read = None
    for name in pack.tables:
        counted = files.csv(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        read = counted if read is None else read.unionByName(counted)
    return read


# --- text preparation -----------------------------------------------------


@registered
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("norm_text"))


@registered
def normalised_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalized("html").alias("norm_text"))


@registered
def masked_text(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("norm_text"))
    return norm.select("doc_id", T.masked("norm_text").alias("masked"))


@registered
def contact_flags(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("n"))
    return norm.select(
        "doc_id", T.has_email("n").alias("email"), T.has_phone("n").alias("phone"), T.has_url("n").alias("url")
    )


@registered
def page_url_flags(spark, sf_dir):
    norm = table(spark, sf_dir, "pages").select("page_id", T.normalized("url").alias("n"))
    return norm.select("page_id", T.has_url("n").alias("url_found"), T.masked("n").alias("masked"))


@registered
def word_counts(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("n"))
    return norm.select("doc_id", T.word_count("n").cast("long").alias("words"))


@registered
def lexical_tokens(spark, sf_dir):
    found = tokens(spark, sf_dir, TEXT)
    return found.select(
        F.col("doc_key").alias("doc_id"),
        F.size("tokens").cast("long").alias("tokens"),
        F.array_join("tokens", " ").alias("words"),
        F.md5(F.array_join(T.bigrams("tokens"), "|")).alias("pairs_md5"),
    )


@registered
def stopword_policy(spark, sf_dir):
    """How often each stopword of the policy occurs before removal."""
    lexical = table(spark, sf_dir, "documents").select(T.lexical("text").alias("lexical_text"))
    found = lexical.select(T.tokens("lexical_text").alias("words")).select(F.explode("words").alias("word"))
    policy = spark.createDataFrame([(w,) for w in stopwords_of(TEXT)], "word string")
    counted = found.groupBy("word").agg(F.count("*").alias("n"))
    return policy.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("removed"))


@registered
def snippets(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("norm_text"))
    return norm.select("doc_id", T.snippet("norm_text").alias("snippet"))


# --- corpus audit ---------------------------------------------------------


@registered
def blank_counts(spark, sf_dir):
    return rounded(
        A.availability(profile(spark, sf_dir)).select(
            "source_rows", "analyzable_documents", "blank_documents", "blank_rate"
        ),
        6,
        "blank_rate",
    )


@registered
def length_distribution(spark, sf_dir):
    return A.length_distribution(profile(spark, sf_dir))


@registered
def length_points(spark, sf_dir):
    """Unrounded length quantiles and the number of very short documents."""
    words = A.length_quantiles(profile(spark, sf_dir)).filter("measure = 'words'")
    short = A.availability(profile(spark, sf_dir)).select("documents_below_five_words").scalar()
    return rounded(
        words.select(
            F.get("at", F.lit(3)).alias("median_words"),
            F.get("at", F.lit(1)).alias("p10_words"),
            F.get("at", F.lit(5)).alias("p90_words"),
        ).withColumn("documents_below_five_words", short),
        6,
        "median_words",
        "p10_words",
        "p90_words",
    )


@registered
def exact_duplicates(spark, sf_dir):
    return A.exact_duplicates(profile(spark, sf_dir))


@registered
def unit_checks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return A.unit_checks(A.document_profile(turns, "text", "conv_id", "role"))


@registered
def contact_documents(spark, sf_dir):
    return A.availability(profile(spark, sf_dir)).select(
        "documents_with_possible_email", "documents_with_possible_phone", "documents_with_url"
    )


@registered
def group_distribution(spark, sf_dir):
    turns = A.document_profile(table(spark, sf_dir, "conversations"), "text", "conv_id", "role")
    both = A.group_distribution(turns).unionByName(A.group_distribution(profile(spark, sf_dir)))
    return rounded(both, 6, "share_nonblank")


@registered
def audit_summary(spark, sf_dir):
    row = A.audit_summary(profile(spark, sf_dir), True)
    return rounded(row, 6, "blank_rate", "median_words", "p10_words", "p90_words")


@registered
def audit_warnings(spark, sf_dir):
    turns = materialise(A.document_profile(table(spark, sf_dir, "conversations"), "text", "conv_id", "role"), "turns")
    first = A.audit_warnings(A.audit_summary(profile(spark, sf_dir), True), True)
    second = A.audit_warnings(A.audit_summary(turns, True), True)
    return first.select(F.lit("documents").alias("corpus"), "code").unionByName(
        second.select(F.lit("conversations").alias("corpus"), "code")
    )


# --- vocabulary and weights -----------------------------------------------


@registered
def document_term_counts(spark, sf_dir):
    terms = vocabulary(spark, sf_dir, TEXT).table(spark).select("term_id", "term")
    entries = V.matrix_entries(matrix(spark, sf_dir, TEXT), "doc_key")
    return entries.join(F.broadcast(terms), "term_id").select(F.col("doc_key").alias("doc_id"), "term", "n")


@registered
def vocabulary_selection(spark, sf_dir):
    return vocabulary(spark, sf_dir, TEXT).table(spark).select("term", "term_count", "document_frequency")


@registered
def inverse_document_frequency(spark, sf_dir):
    found = vocabulary(spark, sf_dir, WORDS_ONLY).table(spark)
    return rounded(
        found.select("term", "document_frequency", "inverse_document_frequency"), 9, "inverse_document_frequency"
    )


@registered
def tfidf_weights(spark, sf_dir):
    terms = vocabulary(spark, sf_dir, TEXT).table(spark).select("term_id", "term")
    entries = V.matrix_entries(matrix(spark, sf_dir, TEXT), "doc_key")
    named = entries.join(F.broadcast(terms), "term_id")
    return named.select(F.col("doc_key").alias("doc_id"), "term", F.round("weight", 8).alias("weight"))


@registered
def vocabulary_table(spark, sf_dir):
    found = V.vocabulary_table(matrix(spark, sf_dir, TEXT), vocabulary(spark, sf_dir, TEXT))
    return rounded(found, 9, "inverse_document_frequency", "mean_tfidf")


@registered
def lexical_coverage(spark, sf_dir):
    return rounded(V.coverage(matrix(spark, sf_dir, TEXT)), 6, "lexical_coverage")


@registered
def matrix_statistics(spark, sf_dir):
    size = len(vocabulary(spark, sf_dir, TEXT).terms)
    return rounded(V.matrix_statistics(matrix(spark, sf_dir, TEXT), size), 6, "sparsity", "frobenius_norm")


@registered
def analysis_guardrails(spark, sf_dir):
    size = len(vocabulary(spark, sf_dir, TEXT).terms)
    return V.guardrails(matrix(spark, sf_dir, TEXT), size, TEXT)


# --- lexical contrast -----------------------------------------------------


@registered
def comparison_labels(spark, sf_dir):
    """Levels of two comparison columns, and whether the operator refuses to compare them."""
    found = []
    for name, kind in (("conversations", "role"), ("documents", "source")):
        labels = table(spark, sf_dir, name).select(T.group_label(kind).alias("label"))
        try:
            refused = C.choose_comparison(labels, replace(TEXT, group=kind)) is None
        except DataProblem:
            refused = True
        found.append(C.level_support(labels).agg(F.lit(kind).alias("column"), F.count("*").alias("levels"), F.lit(refused).alias("refused")))
    return found[0].unionByName(found[1])


@registered
def group_support(spark, sf_dir):
    return C.level_support(tokens(spark, sf_dir, TEXT))


@registered
def informative_log_odds(spark, sf_dir):
    """The whole vocabulary, before any filter."""
    counts = C.label_term_counts(matrix(spark, sf_dir, PAIR)).filter(F.col("label").isin("en", "fr"))
    wide = counts.groupBy("term_id").pivot("label", ["en", "fr"]).agg(F.sum("n"))
    named = vocabulary(spark, sf_dir, PAIR).table(spark).join(wide, "term_id", "left")
    filled = named.select(
        "term",
        F.coalesce("en", F.lit(0)).alias("focal_count"),
        F.coalesce("fr", F.lit(0)).alias("reference_count"),
        F.lit("en vs fr").alias("comparison"),
    )
    return rounded(
        C.log_odds(filled, "focal_count", "reference_count", "comparison").drop("comparison"), 6, "log_odds", "z_score"
    )


@registered
def symmetric_contrast(spark, sf_dir):
    found = C.symmetric_contrast(matrix(spark, sf_dir, PAIR), vocabulary(spark, sf_dir, PAIR), PAIR)
    return rounded(found, 6, "log_odds", "z_score")


@registered
def variant_contrast(spark, sf_dir):
    chosen = C.choose_comparison(tokens(spark, sf_dir, TEXT), TEXT)
    found = C.variant_contrast(matrix(spark, sf_dir, TEXT), vocabulary(spark, sf_dir, TEXT), chosen.levels, TEXT)
    return rounded(found, 6, "log_odds", "z_score")


# --- topics ---------------------------------------------------------------


@registered
def topic_start(spark, sf_dir):
    """Leading singular values of the weights and the starting topics' sums."""
    from lexprism.operators.topics.start import full_spectrum, starting_topics

    rows = single_fit(spark, sf_dir).rows
    k, terms = TEXT.planned_topics, len(vocabulary(spark, sf_dir, TEXT).terms)
    spectrum = full_spectrum(rows, terms, k, TEXT.seed)
    start = starting_topics(rows, [spectrum], [k], [-1])[0]
    listed = [(j + 1, float(spectrum.values[j]), float(start[j].sum())) for j in range(k)]
    return spark.createDataFrame(listed, "topic int, singular_value double, start_sum double")


@registered
def topic_factorisation(spark, sf_dir):
    fitted = [
        (f.topics, f.iteration, f.passes, f.converged, round(f.relative_error, 6))
        for f in model(spark, sf_dir).fits.values()
    ]
    return spark.createDataFrame(fitted, "k int, iteration int, passes int, converged boolean, error double")


@kept
def language_model(spark, sf_dir):
    """Topics of rows that name a document's language, whose best k topics are the k largest languages, and its vocabulary."""
    documents = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("doc_id").alias("doc_key"), F.col("lang").alias("label"))
    languages = documents.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    names, counts = [r["label"] for r in languages], tuple(r["n"] for r in languages)
    known = V.Vocabulary(tuple(names), counts, counts, sum(counts), 1)
    place = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("label")).cast("int") - 1
    rows = documents.select(
        "doc_key", "label", F.array(place).alias("indices"), F.array(F.lit(1).cast("long")).alias("counts"), F.array(F.lit(1.0)).alias("weights")
    )
    rows = materialise(rows, "languages")
    return N.fit_topics(rows, known, replace(TEXT, stability_iterations=3), sum(counts), [2, 3]), known, rows


@kept
def language_shares(spark, sf_dir):
    return materialise(P.document_shares(language_model(spark, sf_dir)[0].document_weights()), "shares")


@kept
def language_comparison(spark, sf_dir):
    found, known, _ = language_model(spark, sf_dir)
    return materialise(N.topic_count_comparison(found, known, spark), "comparison")


def _leading_language(spark, sf_dir) -> DataFrame:
    """``k, topic, language``: what each fitted topic is about."""
    found, known, _ = language_model(spark, sf_dir)
    leading = F.array_position("weights", F.array_max("weights")).cast("int")
    return found.components(spark).select("k", "topic", F.get(F.array(*[F.lit(n) for n in known.terms]), leading - 1).alias("language"))


@registered
def language_topic_fit(spark, sf_dir):
    errors = language_comparison(spark, sf_dir).select("topics", "relative_reconstruction_error")
    named = _leading_language(spark, sf_dir).select(F.col("k").alias("topics"), "language")
    return rounded(named.join(errors, "topics"), 6, "relative_reconstruction_error")


@registered
def language_topic_start(spark, sf_dir):
    """Singular values of the same rows, and the sums of the topics a fit starts from."""
    from lexprism.operators.topics.start import starting_topics

    found, known, _ = language_model(spark, sf_dir)
    k = TEXT.planned_topics
    start = starting_topics(found.rows, [found.full], [k], [-1])[0]
    listed = [(j + 1, float(found.full.values[j]), float(start[j].max())) for j in range(k)]
    return rounded(spark.createDataFrame(listed, "topic int, singular_value double, start_peak double"), 3, "singular_value", "start_peak")


@registered
def language_topic_alignment(spark, sf_dir):
    """How well each sample's topics match those of all rows."""
    aligned = language_model(spark, sf_dir)[0].aligned(spark).join(_leading_language(spark, sf_dir), ["k", "topic"])
    return rounded(aligned.select("k", "iteration", "language", "similarity"), 6, "similarity")


@registered
def language_topic_comparison(spark, sf_dir):
    return rounded(
        language_comparison(spark, sf_dir), 6, "relative_reconstruction_error", "mean_topic_stability", "minimum_topic_stability",
        "top_term_diversity",
    )


@kept
def language_diagnostics_row(spark, sf_dir):
    found, known, rows = language_model(spark, sf_dir)
    weights = language_shares(spark, sf_dir)
    return materialise(diagnostics_row(
        TEXT,
        {"source_rows": table(spark, sf_dir, "documents").count(), "nonblank_documents": found.documents},
        V.matrix_statistics(rows, len(known.terms)),
        C.choose_comparison(rows, TEXT),
        language_comparison(spark, sf_dir),
        prevalence_table(weights, found, known),
        P.document_topics(weights, TEXT.planned_topics, TEXT.assignment_threshold),
        found,
    ), "diagnostics")


@registered
def language_diagnostics(spark, sf_dir):
    """The whole diagnostics row of fits whose outcome is known."""
    found = language_diagnostics_row(spark, sf_dir).select(
        "source_rows", "nonblank_documents", "topic_model_documents", "lexical_coverage", "vocabulary_size", "matrix_sparsity",
        "planned_topics", "nmf_converged", "nmf_fits_at_iteration_cap", "nmf_unfinished_rows", "nmf_unsettled_starts", "contrast_design",
        F.array_join("comparison_variant_levels", ",").alias("levels"), "minimum_topic_prevalence", "ambiguous_document_rate",
        "relative_reconstruction_error", "mean_topic_stability", "minimum_topic_stability", "top_term_diversity",
    )
    shares = [name for name, kind in found.dtypes if kind == "double"]
    return rounded(found, 6, *shares)


@registered
def language_decision(spark, sf_dir):
    """The next step for the corpus, from its audit and the fits whose outcome is known."""
    return D.decide(corpus_audit(spark, sf_dir).summary, language_diagnostics_row(spark, sf_dir)).select("status")


@registered
def reconstruction_error(spark, sf_dir):
    fits = model(spark, sf_dir).fits
    listed = [(k, f.square_sum, f.relative_error) for (k, i), f in fits.items() if i == 0]
    return spark.createDataFrame(listed, "k int, square_sum double, relative_reconstruction_error double")


def _dimension_entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Topic-term rows from the embeddings: label as topic, dimension as term."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("term_id", "x"))
    sums = cells.groupBy(F.col("label").alias("topic"), "term_id").agg(
        F.sum(F.greatest(F.col("x").cast("double"), F.lit(0.0))).alias("weight")
    )
    terms = sums.groupBy("term_id").agg(F.format_string("d%03d", F.col("term_id")).alias("term"))
    return sums, terms


@registered
def top_term_diversity(spark, sf_dir):
    entries, terms = _dimension_entries(spark, sf_dir)
    by_parity = entries.withColumn("k", F.col("topic") % 2)
    return rounded(P.top_term_diversity(by_parity, terms, "k"), 6, "top_term_diversity")


@registered
def topic_terms(spark, sf_dir):
    entries, terms = _dimension_entries(spark, sf_dir)
    return rounded(P.topic_terms(entries, terms, TEXT.top_terms), 6, "weight")


@registered
def document_samples(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"))
    found = S.sampled_documents(keys, SAMPLES, TEXT.seed)
    return found.select("k", "iteration", F.col("doc_key").alias("doc_id"))


@registered
def topic_alignment(spark, sf_dir):
    return rounded(model(spark, sf_dir).aligned(spark), 6, "similarity")


@registered
def topic_stability(spark, sf_dir):
    """Stability arithmetic with every dimension of the embeddings as a topic."""
    aligned = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("k"),
        F.col("vec_id").alias("iteration"),
        F.posexplode("embedding").alias("position", "x"),
    )
    named = aligned.select("k", "iteration", (F.col("position") + 1).alias("topic"), F.col("x").cast("double").alias("similarity"))
    return rounded(B.stability_by_count(named), 6, "mean_topic_stability", "minimum_topic_stability")


@registered
def topic_count_comparison(spark, sf_dir):
    found = N.topic_count_comparison(model(spark, sf_dir), vocabulary(spark, sf_dir, TEXT), spark)
    return rounded(
        found, 6, "relative_reconstruction_error", "mean_topic_stability", "minimum_topic_stability", "top_term_diversity"
    )


def _embedding_shares(spark, sf_dir) -> DataFrame:
    """Topic weights: the positive parts of all dimensions, dealt in turn to the topics."""

    def weight(topic: int) -> Column:
        own = F.filter("embedding", lambda x, i: i % EMBEDDING_TOPICS == topic)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + F.greatest(x.cast("double"), F.lit(0.0)))

    weights = F.array(*[weight(topic) for topic in range(EMBEDDING_TOPICS)])
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_key"), F.col("label").cast("string").alias("label"), weights.alias("topic_weights")
    )
    return P.document_shares(vectors)


@registered
def document_topics(spark, sf_dir):
    found = P.document_topics(_embedding_shares(spark, sf_dir), EMBEDDING_TOPICS, TEXT.assignment_threshold)
    named = found.drop("dominant").withColumnRenamed("doc_key", "vec_id")
    return rounded(named, 6, "assignment_strength", "normalized_entropy").withColumn(
        "normalized_entropy", F.col("normalized_entropy") + 0.0
    )


@registered
def topic_prevalence(spark, sf_dir):
    found = P.topic_prevalence(_embedding_shares(spark, sf_dir))
    return rounded(found, 6, "mean_weight_share", "dominant_document_share")


@registered
def top_documents(spark, sf_dir):
    """Documents that lead a topic, by share and key."""
    found = P.top_documents(_embedding_shares(spark, sf_dir)).withColumnRenamed("doc_key", "vec_id")
    return rounded(found, 6, "topic_weight")


@registered
def representatives(spark, sf_dir):
    keyed = keyed_texts(table(spark, sf_dir, "documents"), TEXT)
    return rounded(P.representatives(shares(spark, sf_dir), keyed), 6, "topic_weight")


@registered
def embedding_representatives(spark, sf_dir):
    """Masked snippets of the documents whose vectors lead a topic."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("text").alias("raw_text"))
    return rounded(P.representatives(_embedding_shares(spark, sf_dir), texts), 6, "topic_weight")


@registered
def variant_topic_prevalence(spark, sf_dir):
    vectors = _embedding_shares(spark, sf_dir)
    levels = tuple(row[0] for row in vectors.select("label").distinct().orderBy("label").collect())
    found = P.variant_topic_prevalence(vectors, levels, EMBEDDING_TOPICS)
    names = [f"Topic {i + 1}" for i in range(EMBEDDING_TOPICS)]
    return rounded(found, 6, *names).withColumnsRenamed({name: name.lower().replace(" ", "_") for name in names})


@registered
def analysis_diagnostics(spark, sf_dir):
    return analysis(spark, sf_dir).diagnostics


@registered
def diagnostic_counts(spark, sf_dir):
    """The part of the diagnostics that does not depend on the fitted topics."""
    found = analysis(spark, sf_dir).diagnostics.select(
        "source_rows",
        "nonblank_documents",
        "topic_model_documents",
        "lexical_coverage",
        "vocabulary_size",
        "matrix_sparsity",
        F.array_join("comparison_variant_levels", ",").alias("levels"),
        "contrast_design",
    )
    return rounded(found, 6, "lexical_coverage", "matrix_sparsity")


@registered
def analysis_warnings(spark, sf_dir):
    return analysis(spark, sf_dir).warnings.select("code")


# --- sentiment and validation ---------------------------------------------


@registered
def document_sentiment(spark, sf_dir):
    return scores(spark, sf_dir).select(
        F.col("doc_key").alias("doc_id"), "negative", "neutral", "positive", "compound", "lexicon_label"
    )


@registered
def sentiment_labels(spark, sf_dir):
    found = scores(spark, sf_dir)
    return found.select(
        F.col("doc_key").alias("doc_id"),
        M.predicted_label(F.col("compound"), binary=True).alias("two_way"),
        M.predicted_label(F.col("compound"), binary=False).alias("three_way"),
    )


SUMMARY = ("mean_compound", "median_compound", "ci_low", "ci_high", "positive_share", "negative_share", "neutral_share")


@registered
def sentiment_summary(spark, sf_dir):
    """The summary aggregate per source, small groups included."""
    by_source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), "source")
    found = scores(spark, sf_dir).join(by_source, "doc_key")
    return rounded(M.score_summary(found, "source"), 6, *SUMMARY)


@registered
def sentiment_overall(spark, sf_dir):
    return rounded(M.overall_summary(scores(spark, sf_dir)), 6, *SUMMARY)


@registered
def time_parse_rate(spark, sf_dir):
    """Share of readable dates where the column also holds codes and gaps."""
    stamped = event_scores(spark, sf_dir).withColumn(
        "stamp", F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("ts").cast("string"))
    )
    return rounded(M.time_parse_rate(stamped, "stamp"), 6, "parse_rate")


@registered
def sentiment_by_quarter(spark, sf_dir):
    return rounded(M.time_summary(scores(spark, sf_dir), "o_orderdate", "quarter"), 6, *SUMMARY)


@registered
def sentiment_by_month(spark, sf_dir):
    return rounded(M.time_summary(scores(spark, sf_dir), "o_orderdate", "month"), 6, *SUMMARY)


@registered
def sentiment_by_week(spark, sf_dir):
    return rounded(M.time_summary(event_scores(spark, sf_dir), "ts", "week"), 6, *SUMMARY)


@registered
def sentiment_by_day(spark, sf_dir):
    return rounded(M.time_summary(event_scores(spark, sf_dir), "ts", "day"), 6, *SUMMARY)


@registered
def sentiment_by_dimension(spark, sf_dir):
    return rounded(M.dimension_summary(scores(spark, sf_dir), HUMAN.dimensions), 6, *SUMMARY)


@registered
def human_label_mapping(spark, sf_dir):
    return scores(spark, sf_dir).select(
        F.col("doc_key").alias("doc_id"), H.human_class(HUMAN).alias("truth")
    ).filter("truth is not null")


def _three_way(spark, sf_dir) -> DataFrame:
    """Labels with a third value: low quality and toxic documents count as neutral."""
    marked = scores(spark, sf_dir).withColumn(
        "mark", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 2).otherwise(F.col("quality"))
    )
    return H.labelled_scores(marked, HUMAN_THREE)


@registered
def confusion_table(spark, sf_dir):
    return H.confusion(_three_way(spark, sf_dir), H.classes_of(HUMAN_THREE))


@registered
def confusion_matrix(spark, sf_dir):
    classes = H.classes_of(HUMAN)
    return H.confusion_matrix(H.confusion(H.labelled_scores(scores(spark, sf_dir), HUMAN), classes), classes)


@registered
def class_metrics(spark, sf_dir):
    found = H.class_metrics(H.confusion(_three_way(spark, sf_dir), H.classes_of(HUMAN_THREE)))
    return rounded(found, 6, "precision", "recall", "f1")


@registered
def validation_summary(spark, sf_dir):
    labelled = H.labelled_scores(scores(spark, sf_dir), HUMAN)
    found = H.validation_summary(H.class_metrics(H.confusion(labelled, H.classes_of(HUMAN))))
    return rounded(found.drop("meaning"), 6, "balanced_accuracy", "macro_f1")


@registered
def sentiment_phrases(spark, sf_dir):
    """Scores with phrases that go over words and phrases that shift them."""
    documents = table(spark, sf_dir, "documents")
    found = scored_documents(documents, SentimentConfig("text"), lexicon(spark), "doc_id", PHRASED)
    return found.select(F.col("doc_key").alias("doc_id"), "negative", "neutral", "positive", "compound")


@registered
def sentiment_emoji(spark, sf_dir):
    """Scores of texts some of whose characters are spelled out as words."""
    emoji = spark.createDataFrame(list(EMOJI.items()), "emoji string, description string")
    documents = table(spark, sf_dir, "documents")
    found = scored_documents(documents, SentimentConfig("text"), lexicon(spark), "doc_id", RULES, emoji)
    return found.select(F.col("doc_key").alias("doc_id"), "negative", "neutral", "positive", "compound")


@registered
def mixed_time_forms(spark, sf_dir):
    """Order dates written in six forms, one column, and read back."""
    day = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "M/d/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd"]
    place = F.pmod(F.col("o_orderkey"), F.lit(len(forms)))
    written = F.coalesce(*[F.when(place == i, F.date_format(day, form)) for i, form in enumerate(forms)])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    read = mixed_time("written", day_first(orders, "written"))
    return orders.select("o_orderkey", F.date_format(read, "yyyy-MM-dd HH:mm:ss").alias("read"))


@registered
def sentiment_duplicates(spark, sf_dir):
    folded = table(spark, sf_dir, "documents").select(T.folded("text").alias("folded_text"))
    return rounded(M.folded_duplicate_rate(folded.filter("folded_text <> ''")), 6, "duplicate_rate")


@registered
def sentiment_warning_codes(spark, sf_dir):
    folded = table(spark, sf_dir, "documents").select(T.folded("text").alias("folded_text"))
    rate = M.time_parse_rate(scores(spark, sf_dir), "o_orderdate").scalar()
    facts = M.folded_duplicate_rate(folded.filter("folded_text <> ''")).withColumn("parse_rate", rate)
    return sentiment_warnings(facts, HUMAN).select("code")


@registered
def sentiment_analysis(spark, sf_dir):
    """The whole sentiment run: validation status and warnings."""
    found = analyze_sentiment(described_documents(spark, sf_dir), HUMAN, lexicon(spark), "doc_id", RULES)
    status = found.validation_summary.select(F.lit("status").alias("part"), F.col("status").alias("value"))
    return status.unionByName(found.warnings.select(F.lit("warning").alias("part"), F.col("code").alias("value")))


# --- decision -------------------------------------------------------------


@registered
def profile_statuses(spark, sf_dir):
    """The rules of the profile on made-up facts that reach every status."""
    n = F.col("n_chars")
    facts = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.lit(2).alias("planned_topics"),
        F.count("*").alias("n"),
        (F.count("*") * 2).alias("analyzable_documents"),
        F.percentile(n / 300, F.lit(0.5)).alias("median_words"),
        (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("copies"),
        (F.count_distinct("lang") * 20).alias("vocabulary_size"),
        F.avg((n > 100).cast("double")).alias("lexical_coverage"),
        F.avg((n % 100) / 60.0).alias("minimum_topic_stability"),
        F.avg((F.col("lang") != "en").cast("double")).alias("minimum_topic_prevalence"),
        F.avg((F.col("lang") == "fr").cast("double") * 3).alias("ambiguous_document_rate"),
    )
    judged = facts.withColumn("duplicate_unit_rows", F.when(F.col("copies") > 3, F.col("copies")).otherwise(0))
    return D.evidence_profile(judged, "source").select("source", "status")


@kept
def source_profile(spark, sf_dir):
    return materialise(K.corpus_profile(table(spark, sf_dir, "documents"), "text", "source", "doc_id", "lang"), "corpora")


@registered
def corpus_summaries(spark, sf_dir):
    """The audit's summary of every source, from one read of the texts."""
    found = K.corpus_summaries(source_profile(spark, sf_dir), True)
    return rounded(found, 6, "blank_rate", "median_words", "p10_words", "p90_words")


@registered
def corpus_length_distributions(spark, sf_dir):
    return K.length_distributions(source_profile(spark, sf_dir))


@registered
def corpus_group_distributions(spark, sf_dir):
    return rounded(K.group_distributions(source_profile(spark, sf_dir)), 6, "share_nonblank")


def _evidence(spark, sf_dir, kind: str, profile: DataFrame) -> DataFrame:
    """Facts and status of every corpus: its audit, its part of the vocabulary, its shares of the language topics."""
    config = replace(TEXT, group=kind)
    lexical = K.lexical_facts(V.term_matrix(tokens(spark, sf_dir, config), vocabulary(spark, sf_dir, TEXT)))
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), T.group_label(kind).alias("label"))
    shares = language_shares(spark, sf_dir).drop("label").join(labels, "doc_key")
    topical = K.topic_facts(shares, TEXT.planned_topics, TEXT.assignment_threshold)
    stable = language_comparison(spark, sf_dir).where("selected_plan").select("minimum_topic_stability").scalar()
    judged = K.corpus_evidence(K.corpus_summaries(profile, True), lexical, topical, TEXT.planned_topics, stable).select("corpus", "status")
    named = judged.join(lexical, "corpus", "left").join(topical, "corpus", "left")
    return rounded(named, 6, "lexical_coverage", "minimum_topic_prevalence", "ambiguous_document_rate")


@registered
def evidence_profile(spark, sf_dir):
    """One status per source, each source profiled as a corpus of its own."""
    return _evidence(spark, sf_dir, "source", source_profile(spark, sf_dir))


@registered
def language_evidence(spark, sf_dir):
    """One status per language."""
    found = materialise(K.corpus_profile(table(spark, sf_dir, "documents"), "text", "lang", "doc_id"), "corpora")
    return _evidence(spark, sf_dir, "lang", found)


@registered
def corpus_decision(spark, sf_dir):
    return D.decide(corpus_audit(spark, sf_dir).summary, analysis(spark, sf_dir).diagnostics)
