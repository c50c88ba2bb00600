"""Check SQL for the registered queries, over the same tables."""

from __future__ import annotations

from lexprism.functions.stats import NORMAL_QUANTILE, T_QUANTILES
from lexprism.functions.text import english_stopwords, stopword_list

from .fixtures import EMBEDDING_TOPICS, EMOJI, LEXICON, PAIR, PHRASED, RULES, SAMPLES, TEXT, WORDS_ONLY

ORACLES: dict[str, str] = {}

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKEN = r"(?:^|[^\p{L}\p{N}_])([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_''-]*[\p{L}\p{N}_])"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)\b(?:https?://|www\.)\S+\b"
PHONE = r"(^|[^\p{L}\p{N}_])(\+?\d[\d .()/-]{6,}\d)($|[^\p{L}\p{N}_])"


def norm(column: str = "text") -> str:
    return rf"trim(regexp_replace({column}, '{SPACE}', ' ', 'g'))"


def lexical(column: str = "text") -> str:
    return f"strip_accents(lower({norm(column)}))"


def words(column: str) -> str:
    return f"regexp_extract_all({column}, '{TOKEN}', 1)"


def mask(column: str) -> str:
    out = f"regexp_replace({column}, '{EMAIL}', '[EMAIL]', 'g')"
    out = f"regexp_replace({out}, '{URL}', '[URL]', 'g')"
    return rf"regexp_replace({out}, '{PHONE}', '\1[PHONE]\3', 'g')"


def quoted(items) -> str:
    return ", ".join("'" + str(item).replace("'", "''") + "'" for item in items)


def stopwords(config) -> list[str]:
    return stopword_list(english_stopwords() if config.use_english_stopwords else (), config.custom_stopwords)


# --- sources and sinks ----------------------------------------------------

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
for _name in ("csv_source", "json_array_source", "json_data_source"):
    ORACLES[_name] = DOCUMENTS
ORACLES["line_source"] = f"""
WITH d AS (SELECT doc_id, {norm()} AS text FROM documents)
SELECT 'TXT-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') AS document_id, text
FROM d WHERE text <> ''
"""
ORACLES["content_fingerprint"] = r"""
WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), '\N'), coalesce(text, '\N'),
                                   coalesce(lang, '\N'), coalesce(source, '\N'))) AS h FROM documents)
SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM h
"""
ORACLES["written_file_fingerprints"] = """
SELECT sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY doc_id)) AS source_sha256 FROM documents GROUP BY source
"""
ORACLES["formula_neutralisation"] = r"""
SELECT doc_id,
       CASE WHEN regexp_matches(text, '^\s*[=+\-@]') THEN '''' || text ELSE text END AS text,
       -doc_id AS negative_number,
       CASE WHEN doc_id > 0 THEN '''' ELSE '' END || CAST(-doc_id AS VARCHAR) AS negative_text,
       ''' ' || chr(9) || '=' || lang AS safe_formula,
       '''@' || source AS mention
FROM documents
"""
ORACLES["json_evidence"] = """
WITH s AS (SELECT source, count(*) AS documents, count(*) FILTER (WHERE n_chars < 500) AS short
           FROM documents GROUP BY source)
SELECT source, documents, CASE WHEN short > 0 THEN round(documents / CAST(short AS DOUBLE), 6) END AS per_short,
       CASE WHEN documents <= 45 THEN CAST(0.5 AS DOUBLE) END AS undefined
FROM s
"""

# --- text preparation -----------------------------------------------------

ORACLES["normalised_text"] = f"SELECT doc_id, {norm()} AS norm_text FROM documents"
_decoded = (
    "replace(replace(replace(replace(html, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
)
ORACLES["normalised_pages"] = f"SELECT page_id, {norm(_decoded)} AS norm_text FROM pages"
ORACLES["masked_text"] = f"SELECT doc_id, {mask(norm())} AS masked FROM documents"
ORACLES["contact_flags"] = f"""
WITH d AS (SELECT doc_id, {norm()} AS n FROM documents)
SELECT doc_id, regexp_matches(n, '{EMAIL}') AS email, regexp_matches(n, '{PHONE}') AS phone,
       regexp_matches(n, '{URL}') AS url
FROM d
"""
ORACLES["page_url_flags"] = f"""
WITH d AS (SELECT page_id, {norm('url')} AS n FROM pages)
SELECT page_id, regexp_matches(n, '{URL}') AS url_found, {mask('n')} AS masked FROM d
"""
ORACLES["word_counts"] = f"SELECT doc_id, CAST(len({words(norm())}) AS BIGINT) AS words FROM documents"


def token_cte(config) -> str:
    """CTEs ``tok`` (doc_id, lang, t: list) and ``terms`` (doc_id, lang, term: one row per occurrence)."""
    removed = stopwords(config)
    kept = f"[w FOR w IN a IF NOT list_contains([{quoted(removed)}], w)]" if removed else "a"
    pairs = "[t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]"
    terms = f"t || {pairs}" if config.ngram_max == 2 else "t"
    return f"""
all_words AS (SELECT doc_id, lang, {words(lexical())} AS a FROM documents WHERE {norm()} <> ''),
tok AS (SELECT doc_id, lang, {kept} AS t FROM all_words),
terms AS (SELECT doc_id, lang, unnest({terms}) AS term FROM tok),
total AS (SELECT count(*) AS docs FROM tok)"""


def vocabulary_cte(config) -> str:
    """Adds ``dtc`` (doc_id, lang, term, n) over the selected ``vocab`` (term, cf, df, idf)."""
    return token_cte(config) + f""",
every AS (SELECT doc_id, lang, term, count(*) AS n FROM terms GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS cf, count(*) AS df,
                 ln((1.0 + (SELECT docs FROM total)) / (1.0 + count(*))) + 1.0 AS idf
          FROM every GROUP BY term
          HAVING count(*) >= {config.min_df} AND count(*) <= {config.max_df} * (SELECT docs FROM total)
          ORDER BY cf DESC, term LIMIT {config.max_features}),
dtc AS (SELECT doc_id, lang, e.term, n, idf FROM every e JOIN vocab v ON e.term = v.term),
raw AS (SELECT doc_id, lang, term, n, (1.0 + ln(n)) * idf AS w FROM dtc),
tfidf AS (SELECT doc_id, lang, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


ORACLES["lexical_tokens"] = f"""
WITH {token_cte(TEXT)}
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, coalesce(array_to_string(t, ' '), '') AS words,
       md5(coalesce(array_to_string([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))], '|'), '')) AS pairs_md5
FROM tok
"""
ORACLES["stopword_policy"] = f"""
WITH policy AS (SELECT unnest([{quoted(stopwords(TEXT))}]) AS word),
found AS (SELECT unnest({words(lexical())}) AS word FROM documents)
SELECT p.word, count(f.word) AS removed FROM policy p LEFT JOIN found f ON p.word = f.word GROUP BY p.word
"""
ORACLES["snippets"] = f"""
WITH d AS (SELECT doc_id, {mask(norm())} AS m FROM documents)
SELECT doc_id, CASE WHEN length(m) > 360 THEN rtrim(substr(m, 1, 357)) || '...' ELSE m END AS snippet FROM d
"""

# --- corpus audit ---------------------------------------------------------

PROFILE = f"""
d AS (SELECT doc_id, lang, {norm()} AS n FROM documents),
p AS (SELECT doc_id, lang, n, n <> '' AS filled, CAST(len({words('n')}) AS BIGINT) AS w, length(n) AS c,
             regexp_matches(n, '{EMAIL}') AS email, regexp_matches(n, '{PHONE}') AS phone,
             regexp_matches(n, '{URL}') AS url
      FROM d),
f AS (SELECT * FROM p WHERE filled),
dup AS (SELECT count(*) AS k FROM f GROUP BY n HAVING count(*) > 1),
grp AS (SELECT CASE WHEN coalesce(trim(lang), '') = '' THEN '(missing)' ELSE trim(lang) END AS g, filled FROM p),
lev AS (SELECT g, count(*) AS rows, count(*) FILTER (WHERE filled) AS docs FROM grp GROUP BY g)"""

ORACLES["blank_counts"] = f"""
WITH {PROFILE}
SELECT count(*) AS source_rows, count(*) FILTER (WHERE filled) AS analyzable_documents,
       count(*) FILTER (WHERE NOT filled) AS blank_documents,
       round(avg(CASE WHEN filled THEN 0.0 ELSE 1.0 END), 6) AS blank_rate
FROM p
"""
_points = [("minimum", 0.0), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("maximum", 1.0)]
ORACLES["length_distribution"] = f"WITH {PROFILE}\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS point, round_even(quantile_cont(w, {at}), 1) AS words, "
    f"round_even(quantile_cont(c, {at}), 1) AS characters FROM f"
    for name, at in _points
)
ORACLES["length_points"] = f"""
WITH {PROFILE}
SELECT round(quantile_cont(w, 0.5), 6) AS median_words, round(quantile_cont(w, 0.1), 6) AS p10_words,
       round(quantile_cont(w, 0.9), 6) AS p90_words, count(*) FILTER (WHERE w < 5) AS documents_below_five_words
FROM f
"""
ORACLES["exact_duplicates"] = f"""
WITH {PROFILE}
SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS exact_duplicate_rows, count(*) AS exact_duplicate_sets FROM dup
"""
ORACLES["unit_checks"] = """
WITH u AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT CAST(coalesce(sum(n) FILTER (WHERE conv_id IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_unit_rows,
       CAST(coalesce(sum(n) FILTER (WHERE conv_id IS NULL), 0) AS BIGINT) AS missing_unit_rows
FROM u
"""
ORACLES["contact_documents"] = f"""
WITH {PROFILE}
SELECT count(*) FILTER (WHERE email) AS documents_with_possible_email,
       count(*) FILTER (WHERE phone) AS documents_with_possible_phone,
       count(*) FILTER (WHERE url) AS documents_with_url
FROM f
"""
ORACLES["group_distribution"] = f"""
WITH {PROFILE},
t AS (SELECT CASE WHEN coalesce(trim(role), '') = '' THEN '(missing)' ELSE trim(role) END AS g,
             coalesce({norm()}, '') <> '' AS filled FROM conversations),
tl AS (SELECT g, count(*) AS rows, count(*) FILTER (WHERE filled) AS docs FROM t GROUP BY g)
SELECT g AS "group", rows AS source_rows, docs AS nonblank_documents,
       round(docs / CAST(greatest((SELECT count(*) FROM f), 1) AS DOUBLE), 6) AS share_nonblank FROM lev
UNION ALL
SELECT g, rows, docs, round(docs / CAST(greatest((SELECT count(*) FILTER (WHERE filled) FROM t), 1) AS DOUBLE), 6)
FROM tl
"""
_summary = f"""
{PROFILE},
summary AS (SELECT
  (SELECT count(*) FROM p) AS source_rows,
  (SELECT count(*) FROM f) AS analyzable_documents,
  (SELECT count(*) FROM p WHERE NOT filled) AS blank_documents,
  (SELECT round(avg(CASE WHEN filled THEN 0.0 ELSE 1.0 END), 6) FROM p) AS blank_rate,
  (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM dup) AS exact_duplicate_rows,
  (SELECT count(*) FROM dup) AS exact_duplicate_sets,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p WHERE doc_id IS NOT NULL
     GROUP BY doc_id HAVING count(*) > 1)) AS duplicate_unit_rows,
  (SELECT count(*) FROM p WHERE doc_id IS NULL) AS missing_unit_rows,
  (SELECT round(quantile_cont(w, 0.5), 6) FROM f) AS median_words,
  (SELECT round(quantile_cont(w, 0.1), 6) FROM f) AS p10_words,
  (SELECT round(quantile_cont(w, 0.9), 6) FROM f) AS p90_words,
  (SELECT count(*) FROM f WHERE w < 5) AS documents_below_five_words,
  (SELECT count(*) FROM f WHERE email) AS documents_with_possible_email,
  (SELECT count(*) FROM f WHERE phone) AS documents_with_possible_phone,
  (SELECT count(*) FROM f WHERE url) AS documents_with_url,
  (SELECT count(*) FROM lev WHERE g <> '(missing)') AS group_levels,
  (SELECT coalesce(min(docs), 0) FROM lev WHERE g <> '(missing)') AS minimum_group_documents,
  (SELECT CAST(coalesce(sum(rows), 0) AS BIGINT) FROM lev WHERE g = '(missing)') AS missing_group_rows)"""
ORACLES["audit_summary"] = f"WITH {_summary} SELECT * FROM summary"


def _warning_rows(corpus: str) -> str:
    return f"""
SELECT '{corpus}' AS corpus, code FROM summary, (VALUES
 ('repeated_identifier'), ('many_blanks'), ('exact_duplicates'), ('short_documents'), ('contact_details'),
 ('few_levels'), ('small_level')) AS c(code)
WHERE CASE code
 WHEN 'repeated_identifier' THEN duplicate_unit_rows > 0
 WHEN 'many_blanks' THEN blank_rate > 0.10
 WHEN 'exact_duplicates' THEN exact_duplicate_rows > 0
 WHEN 'short_documents' THEN median_words < 8
 WHEN 'contact_details' THEN documents_with_possible_email > 0 OR documents_with_possible_phone > 0
 WHEN 'few_levels' THEN group_levels < 2
 ELSE minimum_group_documents > 0 AND minimum_group_documents < 30 END"""


_turns = _summary.replace("SELECT doc_id, lang,", "SELECT conv_id AS doc_id, role AS lang,", 1).replace(
    "FROM documents)", "FROM conversations)", 1
)
ORACLES["audit_warnings"] = (
    f"SELECT * FROM (WITH {_summary} {_warning_rows('documents')}) a UNION ALL "
    f"SELECT * FROM (WITH {_turns} {_warning_rows('conversations')}) b"
)

# --- vocabulary and weights -----------------------------------------------

ORACLES["document_term_counts"] = f"WITH {vocabulary_cte(TEXT)} SELECT doc_id, term, n FROM dtc"
ORACLES["vocabulary_selection"] = f"""
WITH {vocabulary_cte(TEXT)} SELECT term, cf AS term_count, df AS document_frequency FROM vocab
"""
ORACLES["inverse_document_frequency"] = f"""
WITH {vocabulary_cte(WORDS_ONLY)}
SELECT term, df AS document_frequency, round(idf, 9) AS inverse_document_frequency FROM vocab
"""
ORACLES["tfidf_weights"] = f"WITH {vocabulary_cte(TEXT)} SELECT doc_id, term, round(weight, 8) AS weight FROM tfidf"
ORACLES["vocabulary_table"] = f"""
WITH {vocabulary_cte(TEXT)},
m AS (SELECT term, sum(weight) / (SELECT docs FROM total) AS mean FROM tfidf GROUP BY term)
SELECT v.term, cf AS term_count, df AS document_frequency, round(idf, 9) AS inverse_document_frequency,
       round(coalesce(mean, 0), 9) AS mean_tfidf
FROM vocab v LEFT JOIN m ON v.term = m.term
"""
ORACLES["lexical_coverage"] = f"""
WITH {vocabulary_cte(TEXT)}
SELECT docs AS nonblank_documents, (SELECT count(DISTINCT doc_id) FROM dtc) AS usable_documents,
       round((SELECT count(DISTINCT doc_id) FROM dtc) / CAST(docs AS DOUBLE), 6) AS lexical_coverage
FROM total
"""
ORACLES["matrix_statistics"] = f"""
WITH {vocabulary_cte(TEXT)},
s AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS entries, sqrt(sum(weight * weight)) AS norm FROM tfidf)
SELECT documents, (SELECT count(*) FROM vocab) AS terms, entries,
       round(1.0 - entries / (CAST(documents AS DOUBLE) * (SELECT count(*) FROM vocab)), 6) AS sparsity,
       round(norm, 6) AS frobenius_norm
FROM s
"""
ORACLES["analysis_guardrails"] = f"""
WITH {vocabulary_cte(TEXT)},
s AS (SELECT (SELECT docs FROM total) AS nonblank, (SELECT count(DISTINCT doc_id) FROM dtc) AS usable,
             (SELECT count(*) FROM vocab) AS size)
SELECT nonblank AS nonblank_documents, usable AS usable_documents, size AS vocabulary_size,
       nonblank >= {TEXT.minimum_documents} AS enough_documents, usable >= {TEXT.minimum_documents} AS enough_usable,
       size >= 30 AS enough_terms, {TEXT.planned_topics} < least(usable, size) AS topics_fit
FROM s
"""

# --- lexical contrast -----------------------------------------------------

ORACLES["comparison_labels"] = """
WITH l AS (SELECT 'role' AS "column", trim(coalesce(role, '')) AS label FROM conversations
           UNION ALL SELECT 'source', trim(coalesce(source, '')) FROM documents),
s AS (SELECT "column", label, count(*) AS n FROM l WHERE label <> '' GROUP BY ALL)
SELECT "column", count(*) AS levels, count(*) > 6 OR (count(*) > 1 AND min(n) < 20) AS refused FROM s GROUP BY "column"
"""
ORACLES["group_support"] = f"""
SELECT trim(lang) AS level, count(*) AS documents, count(*) >= 20 AS supported
FROM documents WHERE {norm()} <> '' AND coalesce(trim(lang), '') <> '' GROUP BY 1
"""
_odds = """
prior AS (SELECT *, 1000.0 * (y1 + y2 + 1.0) / (sum(y1 + y2) OVER w + count(*) OVER w) AS a,
                 sum(y1) OVER w AS n1, sum(y2) OVER w AS n2
          FROM counts WINDOW w AS (PARTITION BY comparison)),
odds AS (SELECT *, ln((y1 + a) / (n1 + 1000.0 - y1 - a)) - ln((y2 + a) / (n2 + 1000.0 - y2 - a)) AS delta FROM prior),
scored AS (SELECT *, delta / sqrt(1.0 / (y1 + a) + 1.0 / (y2 + a)) AS z FROM odds)"""
_pair = f"""
{vocabulary_cte(PAIR)},
counts AS (SELECT v.term, 'en vs fr' AS comparison, CAST(coalesce(sum(n) FILTER (WHERE lang = 'en'), 0) AS BIGINT) AS y1,
                  CAST(coalesce(sum(n) FILTER (WHERE lang = 'fr'), 0) AS BIGINT) AS y2
           FROM vocab v LEFT JOIN dtc d ON v.term = d.term GROUP BY v.term),
{_odds}"""
ORACLES["informative_log_odds"] = f"""
WITH {_pair}
SELECT term, y1 AS focal_count, y2 AS reference_count, round(delta, 6) AS log_odds, round(z, 6) AS z_score FROM scored
"""
ORACLES["symmetric_contrast"] = f"""
WITH {_pair}
SELECT term, y1 AS focal_count, y2 AS reference_count, round(delta, 6) AS log_odds, round(z, 6) AS z_score,
       CASE WHEN delta >= 0 THEN 'en' ELSE 'fr' END AS direction
FROM scored WHERE y1 + y2 >= {PAIR.min_df} ORDER BY abs(z) DESC, term LIMIT 80
"""
ORACLES["variant_contrast"] = f"""
WITH {vocabulary_cte(TEXT)},
levels AS (SELECT DISTINCT trim(lang) AS variant FROM tok WHERE trim(lang) <> ''),
sums AS (SELECT term, trim(lang) AS variant, sum(n) AS n FROM dtc GROUP BY ALL),
counts AS (SELECT l.variant AS comparison, v.term, CAST(coalesce(s.n, 0) AS BIGINT) AS y1,
                  CAST(v.cf - coalesce(s.n, 0) AS BIGINT) AS y2, v.cf AS total
           FROM levels l CROSS JOIN vocab v LEFT JOIN sums s ON s.term = v.term AND s.variant = l.variant),
{_odds},
ranked AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY z DESC, term) AS r
           FROM scored WHERE total >= {TEXT.min_df})
SELECT comparison AS variant, term, y1 AS variant_count, y2 AS rest_count, round(delta, 6) AS log_odds,
       round(z, 6) AS z_score, comparison || ' vs rest' AS comparison
FROM ranked WHERE r <= 30
"""

# --- topics ---------------------------------------------------------------

_entries = """
cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
entries AS (SELECT label AS topic, dim, 'd' || lpad(CAST(dim AS VARCHAR), 3, '0') AS term,
                   sum(greatest(CAST(x AS DOUBLE), 0.0)) AS weight FROM cells GROUP BY label, dim)"""
ORACLES["language_topic_fit"] = """
WITH n AS (SELECT lang AS language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT CAST(k AS INTEGER) AS topics, language,
       round(sqrt((SELECT sum(n) FROM n) - (SELECT sum(n) FROM n WHERE r <= k)) / sqrt((SELECT sum(n) FROM n)), 6) AS relative_reconstruction_error
FROM n, (VALUES (2), (3)) AS c(k) WHERE r <= k
"""
_k = TEXT.planned_topics
_repeated = " UNION ALL ".join(
    f"SELECT {k} AS k, {i} AS iteration, doc_id, lang, md5(doc_id || ':{k}:{i}:{TEXT.seed}') AS h FROM documents WHERE lang IS NOT NULL"
    for k in (2, 3) for i in (1, 2, 3)
)
LANGUAGES = f"""
n AS (SELECT lang AS language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY lang),
whole AS (SELECT sum(n) AS docs, count(*) AS languages FROM n),
drawn AS ({_repeated}),
placed AS (SELECT *, row_number() OVER (PARTITION BY k, iteration ORDER BY h) AS place, count(*) OVER (PARTITION BY k, iteration) AS docs FROM drawn),
sample AS (SELECT k, iteration, lang, row_number() OVER (PARTITION BY k, iteration ORDER BY count(*) DESC, lang) AS r
           FROM placed WHERE place <= least(docs, greatest(8 * k, CAST(ceil(0.8 * docs) AS BIGINT))) GROUP BY k, iteration, lang),
fits AS (SELECT c.k, i.iteration, language FROM n, (VALUES (2), (3)) AS c(k), (VALUES (1), (2), (3)) AS i(iteration) WHERE r <= c.k),
aligned AS (SELECT CAST(f.k AS INTEGER) AS k, CAST(f.iteration AS INTEGER) AS iteration, language,
                   CASE WHEN s.lang IS NULL THEN 0.0 ELSE CAST(1.0 AS DOUBLE) END AS similarity
            FROM fits f LEFT JOIN sample s ON s.k = f.k AND s.iteration = f.iteration AND s.lang = language AND s.r <= f.k),
per AS (SELECT k, language, avg(similarity) AS stability FROM aligned GROUP BY k, language),
compared AS (
  SELECT k AS topics, k = {_k} AS selected_plan,
         round(sqrt((SELECT sum(n) FROM n WHERE r > k)) / sqrt((SELECT docs FROM whole)), 6) AS relative_reconstruction_error,
         round(avg(stability), 6) AS mean_topic_stability, round(min(stability), 6) AS minimum_topic_stability,
         round(CAST(1.0 AS DOUBLE) / k, 6) AS top_term_diversity
  FROM per GROUP BY k)"""
ORACLES["language_topic_start"] = f"""
WITH {LANGUAGES}
SELECT CAST(r AS INTEGER) AS topic, round(sqrt(n), 3) AS singular_value, round(sqrt(sqrt(n)), 3) AS start_peak FROM n WHERE r <= {_k}
"""
ORACLES["language_topic_alignment"] = f"WITH {LANGUAGES} SELECT * FROM aligned"
ORACLES["language_topic_comparison"] = f"WITH {LANGUAGES} SELECT * FROM compared"
ORACLES["language_diagnostics"] = f"""
WITH {LANGUAGES},
g AS (SELECT string_agg(language, ',' ORDER BY language) AS levels FROM n)
SELECT (SELECT count(*) FROM documents) AS source_rows, CAST(docs AS BIGINT) AS nonblank_documents, CAST(docs AS BIGINT) AS topic_model_documents,
       CAST(1.0 AS DOUBLE) AS lexical_coverage, languages AS vocabulary_size, round(1.0 - CAST(1.0 AS DOUBLE) / languages, 6) AS matrix_sparsity,
       CAST({_k} AS INTEGER) AS planned_topics, true AS nmf_converged, 0::BIGINT AS nmf_fits_at_iteration_cap, 0::BIGINT AS nmf_unfinished_rows,
       0::BIGINT AS nmf_unsettled_starts, 'one-vs-rest per variant' AS contrast_design, levels,
       round((SELECT min(n) FROM n WHERE r <= {_k}) / CAST(docs AS DOUBLE), 6) AS minimum_topic_prevalence,
       round((SELECT coalesce(sum(n), 0) FROM n WHERE r > {_k}) / CAST(docs AS DOUBLE), 6) AS ambiguous_document_rate,
       relative_reconstruction_error, mean_topic_stability, minimum_topic_stability, top_term_diversity
FROM whole, g, compared WHERE selected_plan
"""
ORACLES["top_term_diversity"] = f"""
WITH {_entries},
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS r FROM entries)
SELECT topic % 2 AS k, round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS top_term_diversity
FROM ranked WHERE r <= 10 GROUP BY 1
"""
ORACLES["topic_terms"] = f"""
WITH {_entries},
ranked AS (SELECT *, weight / sum(weight) OVER (PARTITION BY topic) AS share,
                  CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS r FROM entries)
SELECT 'Topic ' || topic AS topic, r AS rank, term, round(share, 6) AS weight
FROM ranked WHERE r <= {TEXT.top_terms}
"""
_drawn = " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS k, CAST({i} AS INTEGER) AS iteration, doc_id, "
    f"md5(doc_id || ':{k}:{i}:{TEXT.seed}') AS h FROM documents"
    for k, i in SAMPLES
)
ORACLES["document_samples"] = f"""
WITH drawn AS ({_drawn}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, iteration ORDER BY h) AS r,
                  count(*) OVER (PARTITION BY k, iteration) AS docs FROM drawn)
SELECT k, iteration, doc_id FROM ranked WHERE r <= least(docs, greatest(8 * k, CAST(ceil(0.8 * docs) AS BIGINT)))
"""
ORACLES["topic_stability"] = """
WITH cells AS (SELECT label AS k, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS topic FROM embeddings),
per AS (SELECT k, topic, avg(CAST(x AS DOUBLE)) AS s FROM cells GROUP BY k, topic)
SELECT k, round(avg(s), 6) AS mean_topic_stability, round(min(s), 6) AS minimum_topic_stability FROM per GROUP BY k
"""
_shares = f"""
cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
pos AS (SELECT vec_id, label, CAST(dim % {EMBEDDING_TOPICS} + 1 AS INTEGER) AS topic, sum(greatest(CAST(x AS DOUBLE), 0.0)) AS w
        FROM cells GROUP BY ALL),
whole AS (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS total FROM pos),
share AS (SELECT vec_id, label, topic, CASE WHEN total > 0 THEN w / total ELSE 0.0 END AS s FROM whole),
led AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic) = 1 AS leads FROM share)"""
ORACLES["document_topics"] = f"""
WITH {_shares}
SELECT vec_id, 'Topic ' || max(CASE WHEN leads THEN topic END) AS topic, round(max(s), 6) AS assignment_strength,
       round(-sum(CASE WHEN s > 0 THEN s * ln(s + 1e-15) ELSE 0 END) / ln({EMBEDDING_TOPICS}.0), 6) + 0.0
         AS normalized_entropy,
       max(s) < {TEXT.assignment_threshold} AS ambiguous
FROM led GROUP BY vec_id
"""
ORACLES["topic_prevalence"] = f"""
WITH {_shares}
SELECT topic, round(avg(s), 6) AS mean_weight_share, count(*) FILTER (WHERE leads) AS dominant_documents,
       round(count(*) FILTER (WHERE leads) / CAST(count(*) AS DOUBLE), 6) AS dominant_document_share
FROM led GROUP BY topic
"""
ORACLES["top_documents"] = f"""
WITH {_shares},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY s DESC, vec_id) AS INTEGER) AS r FROM share)
SELECT topic, r AS rank, vec_id, round(s, 6) AS topic_weight FROM ranked WHERE r <= 3
"""
ORACLES["embedding_representatives"] = f"""
WITH {_shares},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY s DESC, vec_id) AS INTEGER) AS r FROM share),
masked AS (SELECT doc_id, {mask(norm())} AS m FROM documents)
SELECT 'Topic ' || topic AS topic, r AS rank, round(s, 6) AS topic_weight,
       CASE WHEN length(m) > 360 THEN rtrim(substr(m, 1, 357)) || '...' ELSE m END AS context_snippet_masked
FROM ranked JOIN masked ON doc_id = vec_id WHERE r <= 3
"""
ORACLES["variant_topic_prevalence"] = f"""
WITH {_shares}
SELECT CAST(label AS VARCHAR) AS variant, count(DISTINCT vec_id) AS documents,
       {", ".join(f"round(avg(s) FILTER (WHERE topic = {i}), 6) AS topic_{i}" for i in range(1, EMBEDDING_TOPICS + 1))}
FROM share GROUP BY label
"""

ORACLES["diagnostic_counts"] = f"""
WITH {vocabulary_cte(TEXT)},
s AS (SELECT (SELECT count(*) FROM documents) AS source_rows, (SELECT docs FROM total) AS docs,
             (SELECT count(DISTINCT doc_id) FROM dtc) AS usable, (SELECT count(*) FROM dtc) AS entries,
             (SELECT count(*) FROM vocab) AS size,
             (SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT DISTINCT trim(lang) AS g FROM tok WHERE trim(lang) <> ''))
               AS levels)
SELECT source_rows, docs AS nonblank_documents, usable AS topic_model_documents,
       round(usable / CAST(docs AS DOUBLE), 6) AS lexical_coverage, size AS vocabulary_size,
       round(1.0 - entries / (CAST(usable AS DOUBLE) * size), 6) AS matrix_sparsity, levels,
       CASE WHEN contains(levels, ',') THEN 'one-vs-rest per variant' ELSE 'none' END AS contrast_design
FROM s
"""
ORACLES["evidence_manifest"] = f"""
SELECT 'lexprism.evidence.v1' AS schema, source_rows, nonblank_documents, vocabulary_size, contrast_design,
       CAST(5 AS INTEGER) AS undocumented
FROM ({ORACLES["diagnostic_counts"]})
"""
ORACLES["analysis_warnings"] = """
WITH l AS (SELECT count(DISTINCT trim(lang)) AS n FROM documents WHERE trim(lang) <> '')
SELECT unnest(['topics_are_patterns', 'choices_matter', 'masking_is_partial', 'english_list']) AS code
UNION ALL SELECT unnest(['variant_contrast', 'variant_prevalence']) FROM l WHERE n >= 2
"""
_selected = ORACLES["vocabulary_selection"].strip()
_contrasted = ORACLES["variant_contrast"].strip()
ORACLES["evidence_csv_bundle"] = f"""
WITH l AS (SELECT count(DISTINCT trim(lang)) AS n FROM documents WHERE trim(lang) <> '')
SELECT 'vocabulary' AS "table", count(*) AS rows FROM ({_selected}) v
UNION ALL SELECT 'variant_lexical_contrast', count(*) FROM ({_contrasted}) c
UNION ALL SELECT unnest(['group_distribution', 'variant_topic_prevalence']), n FROM l
UNION ALL SELECT * FROM (VALUES ('length_distribution', 7), ('group_lexical_contrast', 0),
  ('topic_count_comparison', {min(8, max(5, _k + 2)) - 1}), ('topic_terms', {_k * TEXT.top_terms}),
  ('topic_prevalence', {_k})) AS f(t, r)
"""

ORACLES["evidence_tables"] = ORACLES["evidence_csv_bundle"]

# --- sentiment and validation ---------------------------------------------

_punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_lexicon = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in LEXICON.items())


def _step(value: str, back: int, factor: str) -> str:
    scale = RULES.distance_scale[back - 1]
    sign = f"CASE WHEN {value} < 0 THEN -1.0 ELSE 1.0 END"
    lift = (
        f"CASE WHEN b{back} <> 0 THEN b{back} * {sign} + CASE WHEN caps{back} AND mixed "
        f"THEN {RULES.capitals} * {sign} ELSE 0.0 END ELSE 0.0 END"
    )
    return (
        f"CASE WHEN pos > {back} AND v{back} IS NULL THEN ({value} + ({lift}) * {scale}) * ({factor}) "
        f"ELSE {value} END"
    )


_negated = lambda back: f"CASE WHEN neg{back} THEN {RULES.negation} ELSE 1.0 END"
_lags = ", ".join(
    f"lag({col}, {back}) OVER o AS {col}{back}" for back in (1, 2, 3) for col in ("w", "v", "b", "neg", "caps")
)

def sentiment(phrased: str = "x3", text: str = norm()) -> str:
    """CTEs up to ``score``; ``phrased`` is the value after the phrases around a word, ``text`` the normalised text."""
    return f"""
lexicon AS (SELECT * FROM (VALUES {_lexicon}) AS x(word, valence)),
dn AS (SELECT doc_id, {text} AS n FROM documents),
sp AS (SELECT doc_id, n, string_split(n, ' ') AS parts FROM dn WHERE n <> ''),
un AS (SELECT doc_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS pos FROM sp),
st AS (SELECT doc_id, pos, CASE WHEN length(trim(token, '{_punctuation}')) <= 2 THEN token
                                ELSE trim(token, '{_punctuation}') END AS c FROM un),
fa AS (SELECT doc_id, pos, lower(c) AS w, upper(c) = c AND lower(c) <> c AS caps,
              CASE WHEN lower(c) IN ({quoted(RULES.strengthening)}) THEN {RULES.booster}
                   WHEN lower(c) IN ({quoted(RULES.weakening)}) THEN -{RULES.booster} ELSE 0.0 END AS b,
              lower(c) IN ({quoted(RULES.negating)}) OR contains(lower(c), 'n''t') AS neg FROM st),
va AS (SELECT fa.*, valence AS v, count(*) FILTER (WHERE caps) OVER (PARTITION BY doc_id) AS loud,
              count(*) OVER (PARTITION BY doc_id) AS size
       FROM fa LEFT JOIN lexicon ON word = w),
lg AS (SELECT *, loud > 0 AND loud < size AS mixed, lead(v) OVER o AS next_v, lead(w) OVER o AS f1, lead(w, 2) OVER o AS f2, {_lags}
       FROM va WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s0 AS (SELECT *, CASE WHEN w1 = 'no' OR w2 = 'no' OR (w3 = 'no' AND w1 IN ('or', 'nor')) THEN v * {RULES.negation}
                      WHEN w = 'no' AND next_v IS NOT NULL THEN 0.0 ELSE v END AS x0 FROM lg),
sc AS (SELECT *, x0 + CASE WHEN caps AND mixed THEN {RULES.capitals} * CASE WHEN x0 < 0 THEN -1.0 ELSE 1.0 END
                           ELSE 0.0 END AS xc FROM s0),
s1 AS (SELECT *, {_step('xc', 1, _negated(1))} AS x1 FROM sc),
s2 AS (SELECT *, {_step('x1', 2, _negated(2))} AS x2 FROM s1),
s3 AS (SELECT *, {_step('x2', 3, f"CASE WHEN w1 IN ('so', 'this') THEN {RULES.never_so} WHEN neg3 THEN {RULES.negation} ELSE 1.0 END")} AS x3 FROM s2),
sv AS (SELECT doc_id, pos, CASE WHEN v IS NOT NULL AND b = 0 THEN {phrased} ELSE 0.0 END AS x,
              min(CASE WHEN w = '{RULES.contrast}' THEN pos END) OVER (PARTITION BY doc_id) AS turn FROM s3),
sb AS (SELECT doc_id, x * CASE WHEN pos < turn THEN {RULES.before_but} WHEN pos > turn THEN {RULES.after_but}
                               ELSE 1.0 END AS x FROM sv),
em AS (SELECT doc_id, least(length(n) - length(replace(n, '!', '')), 4) * {RULES.exclamation}
              + CASE WHEN length(n) - length(replace(n, '?', '')) > 3 THEN {RULES.question_cap}
                     WHEN length(n) - length(replace(n, '?', '')) > 1
                     THEN (length(n) - length(replace(n, '?', ''))) * {RULES.question} ELSE 0.0 END AS e FROM sp),
su AS (SELECT doc_id, sum(x) AS raw, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END) AS up,
              sum(CASE WHEN x < 0 THEN 1 - x ELSE 0 END) AS down, count(*) FILTER (WHERE x = 0) AS flat
       FROM sb GROUP BY doc_id),
pu AS (SELECT doc_id, flat, raw + sign(raw) * e AS raw, CASE WHEN up > down THEN up + e ELSE up END AS up,
              CASE WHEN down > up THEN down + e ELSE down END AS down FROM su JOIN em USING (doc_id)),
score AS (SELECT doc_id, round(down / (up + down + flat), 3) AS negative, round(flat / (up + down + flat), 3) AS neutral,
                 round(up / (up + down + flat), 3) AS positive, round(raw / sqrt(raw * raw + 15.0), 4) AS compound FROM pu)"""


SENTIMENT = sentiment()

_three = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"
ORACLES["document_sentiment"] = f"WITH {SENTIMENT} SELECT *, {_three} AS lexicon_label FROM score"
ORACLES["sentiment_labels"] = f"""
WITH {SENTIMENT}
SELECT doc_id, CASE WHEN compound >= 0 THEN 'positive' ELSE 'negative' END AS two_way, {_three} AS three_way FROM score
"""

_z = NORMAL_QUANTILE
_series = (
    f"({_z} + {(_z**3 + _z) / 4} / df + {(5 * _z**5 + 16 * _z**3 + 3 * _z) / 96} / (df * df) "
    f"+ {(3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384} / (df * df * df) "
    f"+ {(79 * _z**9 + 776 * _z**7 + 1482 * _z**5 - 1920 * _z**3 - 945 * _z) / 92160} / (df * df * df * df))"
)
_quantile = f"CASE WHEN df <= 30 THEN [{', '.join(str(q) for q in T_QUANTILES)}][CAST(df AS INTEGER)] ELSE {_series} END"


def summarised(by: list[str], rows: str) -> str:
    """The summary aggregate over ``rows`` (a SELECT with ``by`` columns and compound)."""
    keys = ", ".join(by)
    head = f"{keys}, " if by else ""
    group = f"GROUP BY {keys}" if by else ""
    return f"""
agg AS (SELECT {head}count(*) AS n, avg(compound) AS m, quantile_cont(compound, 0.5) AS md,
               stddev_samp(compound) / sqrt(count(*)) AS se, CAST(count(*) - 1 AS DOUBLE) AS df,
               avg(CASE WHEN compound >= 0.05 THEN 1.0 ELSE 0.0 END) AS ps,
               avg(CASE WHEN compound <= -0.05 THEN 1.0 ELSE 0.0 END) AS ng,
               avg(CASE WHEN compound > -0.05 AND compound < 0.05 THEN 1.0 ELSE 0.0 END) AS ne
        FROM ({rows}) {group})
SELECT {head}n AS documents, round(m, 6) AS mean_compound, round(md, 6) AS median_compound,
       CASE WHEN n > 1 THEN round(m - ({_quantile}) * se, 6) END AS ci_low,
       CASE WHEN n > 1 THEN round(m + ({_quantile}) * se, 6) END AS ci_high,
       round(ps, 6) AS positive_share, round(ng, 6) AS negative_share, round(ne, 6) AS neutral_share
FROM agg"""


ORACLES["sentiment_summary"] = f"""
WITH {SENTIMENT}, {summarised(['source'], 'SELECT source, compound FROM score JOIN documents USING (doc_id)')}
"""
ORACLES["sentiment_overall"] = f"""
WITH {SENTIMENT}, {summarised(['scope'], "SELECT 'all usable documents' AS scope, compound FROM score")}
"""
ORACLES["time_parse_rate"] = f"""
SELECT round(avg(CASE WHEN event_type = 'error' OR ts IS NULL THEN 0.0 ELSE 1.0 END), 6) AS parse_rate
FROM documents LEFT JOIN events ON event_id = doc_id WHERE {norm()} <> ''
"""


def timed(label: str, source: str) -> str:
    return f"WITH {SENTIMENT}, {summarised(['period'], f'SELECT {label} AS period, compound FROM score JOIN {source}')}"


_orders = "orders ON o_orderkey = doc_id WHERE o_orderdate IS NOT NULL"
_events = "events ON event_id = doc_id WHERE ts IS NOT NULL"
ORACLES["sentiment_by_quarter"] = timed("year(o_orderdate) || 'Q' || quarter(o_orderdate)", _orders)
ORACLES["sentiment_by_month"] = timed("strftime(o_orderdate, '%Y-%m')", _orders)
_monday = "CAST(date_trunc('week', ts) AS DATE)"
ORACLES["sentiment_by_week"] = timed(
    f"strftime({_monday}, '%Y-%m-%d') || '/' || strftime({_monday} + INTERVAL 6 DAY, '%Y-%m-%d')", _events
)
ORACLES["sentiment_by_day"] = timed("strftime(ts, '%Y-%m-%d')", _events)
_levels = """
SELECT 'lang' AS dimension, trim(coalesce(lang, '(missing)')) AS level, compound FROM score JOIN documents USING (doc_id)
UNION ALL
SELECT 'toxic', coalesce(CAST(toxic AS VARCHAR), '(missing)'), compound FROM score LEFT JOIN labels USING (doc_id)"""
ORACLES["sentiment_by_dimension"] = f"WITH {SENTIMENT}, {summarised(['dimension', 'level'], _levels)}"
ORACLES["human_label_mapping"] = f"""
SELECT doc_id, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS truth
FROM documents JOIN labels USING (doc_id) WHERE {norm()} <> '' AND quality IN (0, 1)
"""
_three_way = f"""
{SENTIMENT},
lab AS (SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'positive'
                    WHEN quality = 0 THEN 'negative' END AS truth, {_three} AS pred
        FROM score JOIN labels USING (doc_id)),
classes AS (SELECT unnest(['negative', 'neutral', 'positive']) AS c),
conf AS (SELECT a.c AS truth, b.c AS pred, count(l.truth) AS n FROM classes a CROSS JOIN classes b
         LEFT JOIN lab l ON l.truth = a.c AND l.pred = b.c GROUP BY a.c, b.c)"""
_two_way = _three_way.replace(
    "CASE WHEN quality = 0 AND toxic = 1 THEN 'neutral' WHEN quality = 1", "CASE WHEN quality = 1"
).replace("['negative', 'neutral', 'positive']", "['negative', 'positive']").replace(
    f"{_three} AS pred", "CASE WHEN compound >= 0 THEN 'positive' ELSE 'negative' END AS pred"
)
_metrics = """
met AS (SELECT c.c AS class, coalesce(sum(n) FILTER (WHERE truth = c.c AND pred = c.c), 0) AS hit,
               coalesce(sum(n) FILTER (WHERE truth = c.c), 0) AS t, coalesce(sum(n) FILTER (WHERE pred = c.c), 0) AS p
        FROM classes c JOIN conf ON true GROUP BY c.c),
rates AS (SELECT class, CASE WHEN p > 0 THEN hit / CAST(p AS DOUBLE) ELSE 0.0 END AS precision,
                 CASE WHEN t > 0 THEN hit / CAST(t AS DOUBLE) ELSE 0.0 END AS recall,
                 CASE WHEN t + p > 0 THEN 2.0 * hit / CAST(t + p AS DOUBLE) ELSE 0.0 END AS f1, t FROM met)"""
ORACLES["confusion_table"] = f"""
WITH {_three_way} SELECT truth AS human_label, pred AS predicted_label, n AS documents FROM conf
"""
ORACLES["confusion_matrix"] = f"""
WITH {_two_way}
SELECT truth AS human_label, CAST(sum(n) FILTER (WHERE pred = 'negative') AS BIGINT) AS negative,
       CAST(sum(n) FILTER (WHERE pred = 'positive') AS BIGINT) AS positive FROM conf GROUP BY truth
"""
ORACLES["class_metrics"] = f"""
WITH {_three_way}, {_metrics}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(t AS BIGINT) AS support FROM rates
"""
ORACLES["validation_summary"] = f"""
WITH {_two_way}, {_metrics},
one AS (SELECT CAST(sum(t) AS BIGINT) AS n, avg(recall) FILTER (WHERE t > 0) AS ba, avg(f1) AS f1 FROM rates)
SELECT CASE WHEN n = 0 THEN 'VALIDATION MISSING' WHEN n < 100 THEN 'VALIDATION LIMITED'
            WHEN ba >= 0.70 AND f1 >= 0.70 THEN 'LOCALLY SUPPORTED' ELSE 'MODEL DOES NOT TRANSFER' END AS status,
       n AS labeled_documents, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1
FROM one
"""
_repeats = f"""
c AS (SELECT count(*) AS n FROM documents WHERE {norm()} <> '' GROUP BY lower({norm()})),
r AS (SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) / CAST(sum(n) AS DOUBLE) AS rate FROM c)"""


def _valued(table, words: str) -> str:
    return f"CASE {words} " + " ".join(f"WHEN '{phrase}' THEN CAST({value} AS DOUBLE)" for phrase, value in table) + " END"


_before = ["concat_ws(' ', w1, w)", "concat_ws(' ', w2, w1, w)", "concat_ws(' ', w2, w1)", "concat_ws(' ', w3, w2, w1)", "concat_ws(' ', w3, w2)"]
_ahead = ["CASE WHEN f2 IS NOT NULL THEN concat_ws(' ', w, f1, f2) END", "CASE WHEN f1 IS NOT NULL THEN concat_ws(' ', w, f1) END"]
_own = ", ".join(_valued(PHRASED.phrases, words) for words in [*_ahead, *_before])
_shift = " + ".join(f"coalesce({_valued(PHRASED.phrase_boosts, words)}, 0.0)" for words in (_before[3], _before[4], _before[2]))
_phrased = f"(CASE WHEN pos > 3 AND v3 IS NULL THEN coalesce({_own}, x3) + {_shift} ELSE x3 END)"
_scores = "SELECT doc_id, negative, neutral, positive, compound FROM score"
ORACLES["sentiment_phrases"] = f"WITH {sentiment(_phrased)} {_scores}"
_spelled = norm()
for _letter, _said in EMOJI.items():  # before a word of its own, or with a blank put before
    _spelled = f"replace(regexp_replace({_spelled}, '(^| ){_letter}', '\\1{_said}', 'g'), '{_letter}', ' {_said}')"
ORACLES["sentiment_emoji"] = f"WITH {sentiment(text=f'trim({_spelled})')} {_scores}"
ORACLES["mixed_time_forms"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS read FROM orders"
ORACLES["sentiment_duplicates"] = f"WITH {_repeats} SELECT round(rate, 6) AS duplicate_rate FROM r"
ORACLES["sentiment_warning_codes"] = f"""
WITH {_repeats},
t AS (SELECT avg(CASE WHEN o_orderdate IS NULL THEN 0.0 ELSE 1.0 END) AS parse
      FROM documents LEFT JOIN orders ON o_orderkey = doc_id WHERE {norm()} <> '')
SELECT 'fixed_lexicon' AS code
UNION ALL SELECT 'unreadable_times' FROM t WHERE parse < 0.90
UNION ALL SELECT 'duplicates' FROM r WHERE rate > 0
"""
_status = ORACLES["validation_summary"].strip()
ORACLES["sentiment_analysis"] = f"""
SELECT 'status' AS part, status AS value FROM ({_status}) v
UNION ALL SELECT 'warning', code FROM ({ORACLES['sentiment_warning_codes'].strip()}) w
"""

# --- decision -------------------------------------------------------------

ORACLES["profile_statuses"] = """
WITH facts AS (
  SELECT source, count(*) * 2 AS docs, quantile_cont(n_chars / 300.0, 0.5) AS med,
         count(*) - count(DISTINCT text) AS copies,
         count(DISTINCT lang) * 20 AS vocab, avg(CASE WHEN n_chars > 100 THEN 1.0 ELSE 0.0 END) AS cover,
         avg((n_chars % 100) / 60.0) AS stable, avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END) AS smallest,
         avg(CASE WHEN lang = 'fr' THEN 3.0 ELSE 0.0 END) AS unclear
  FROM documents GROUP BY source)
SELECT source, CASE WHEN copies > 3 THEN 'DATA CHECK REQUIRED'
  WHEN docs < 80 OR vocab < 50 OR med < 5 OR cover < 0.80 THEN 'CORPUS LIMITED'
  WHEN stable < 0.65 OR smallest < 0.05 THEN 'PATTERNS UNSTABLE'
  WHEN unclear > 0.35 THEN 'REVIEW WITH HUMAN CODING' ELSE 'READY FOR CODEBOOK TEST' END AS status
FROM facts
"""


def corpora(kind: str, group: str | None) -> str:
    """``facts``: the audit summary of every corpus named by the column ``kind``."""
    label = f"CASE WHEN coalesce(trim({group}), '') = '' THEN '(missing)' ELSE trim({group}) END" if group else "NULL"
    levels = (
        "SELECT corpus, count(*) FILTER (WHERE g <> '(missing)') AS group_levels, coalesce(min(docs) FILTER (WHERE g <> '(missing)'), 0) AS minimum_group_documents, "
        "CAST(coalesce(sum(n) FILTER (WHERE g = '(missing)'), 0) AS BIGINT) AS missing_group_rows "
        "FROM (SELECT corpus, g, count(*) AS n, count(*) FILTER (WHERE filled) AS docs FROM p WHERE g IS NOT NULL GROUP BY ALL) GROUP BY corpus"
    )
    return f"""
d AS (SELECT doc_id, CASE WHEN coalesce(trim({kind}), '') = '' THEN '(missing)' ELSE trim({kind}) END AS corpus, {label} AS g, {norm()} AS n FROM documents),
p AS (SELECT doc_id, corpus, g, n, n <> '' AS filled, CAST(len({words('n')}) AS BIGINT) AS w, length(n) AS c, regexp_matches(n, '{EMAIL}') AS email,
             regexp_matches(n, '{PHONE}') AS phone, regexp_matches(n, '{URL}') AS url FROM d),
base AS (SELECT corpus, count(*) AS source_rows, count(*) FILTER (WHERE filled) AS analyzable_documents, count(*) FILTER (WHERE NOT filled) AS blank_documents,
                round(avg(CASE WHEN filled THEN 0.0 ELSE 1.0 END), 6) AS blank_rate, round(quantile_cont(w, 0.5) FILTER (WHERE filled), 6) AS median_words,
                round(quantile_cont(w, 0.1) FILTER (WHERE filled), 6) AS p10_words, round(quantile_cont(w, 0.9) FILTER (WHERE filled), 6) AS p90_words,
                count(*) FILTER (WHERE filled AND w < 5) AS documents_below_five_words, count(*) FILTER (WHERE filled AND email) AS documents_with_possible_email,
                count(*) FILTER (WHERE filled AND phone) AS documents_with_possible_phone, count(*) FILTER (WHERE filled AND url) AS documents_with_url
         FROM p GROUP BY corpus),
copies AS (SELECT corpus, CAST(sum(k) AS BIGINT) AS exact_duplicate_rows, count(*) AS exact_duplicate_sets
           FROM (SELECT corpus, count(*) AS k FROM p WHERE filled GROUP BY corpus, n HAVING count(*) > 1) GROUP BY corpus),
units AS (SELECT corpus, CAST(coalesce(sum(k) FILTER (WHERE doc_id IS NOT NULL AND k > 1), 0) AS BIGINT) AS duplicate_unit_rows,
                 CAST(coalesce(sum(k) FILTER (WHERE doc_id IS NULL), 0) AS BIGINT) AS missing_unit_rows
          FROM (SELECT corpus, doc_id, count(*) AS k FROM p GROUP BY corpus, doc_id) GROUP BY corpus),
lev AS ({levels}),
facts AS (SELECT b.*, coalesce(exact_duplicate_rows, 0) AS exact_duplicate_rows, coalesce(exact_duplicate_sets, 0) AS exact_duplicate_sets,
                 duplicate_unit_rows, missing_unit_rows, coalesce(group_levels, 0) AS group_levels,
                 coalesce(minimum_group_documents, 0) AS minimum_group_documents, coalesce(missing_group_rows, 0) AS missing_group_rows
          FROM base b JOIN units u USING (corpus) LEFT JOIN copies USING (corpus) LEFT JOIN lev USING (corpus))"""


ORACLES["corpus_summaries"] = f"WITH {corpora('source', 'lang')} SELECT * FROM facts"
ORACLES["corpus_length_distributions"] = f"WITH {corpora('source', 'lang')}\n" + "\nUNION ALL\n".join(
    f"SELECT corpus, '{name}' AS point, round_even(quantile_cont(w, {at}), 1) AS words, round_even(quantile_cont(c, {at}), 1) AS characters "
    "FROM p WHERE filled GROUP BY corpus"
    for name, at in _points
)
ORACLES["corpus_group_distributions"] = f"""
WITH {corpora('source', 'lang')},
l AS (SELECT corpus, g, count(*) AS n, count(*) FILTER (WHERE filled) AS docs FROM p GROUP BY corpus, g)
SELECT corpus, g AS "group", n AS source_rows, docs AS nonblank_documents,
       round(docs / CAST(greatest(sum(docs) OVER (PARTITION BY corpus), 1) AS DOUBLE), 6) AS share_nonblank FROM l
"""
_rules = f"""CASE WHEN duplicate_unit_rows > 0 THEN 'DATA CHECK REQUIRED'
  WHEN analyzable_documents < {TEXT.minimum_documents} OR vocabulary_size < 50 OR coalesce(median_words, 0) < 5 OR lexical_coverage < 0.80 THEN 'CORPUS LIMITED'
  WHEN minimum_topic_stability < 0.65 OR minimum_topic_prevalence < 0.05 THEN 'PATTERNS UNSTABLE'
  WHEN ambiguous_document_rate > 0.35 THEN 'REVIEW WITH HUMAN CODING' ELSE 'READY FOR CODEBOOK TEST' END AS status"""
ORACLES["language_decision"] = f"""
SELECT {_rules}
FROM (SELECT d.*, a.* EXCLUDE (source_rows) FROM ({ORACLES["audit_summary"]}) a, ({ORACLES["language_diagnostics"]}) d)
"""


def evidence(kind: str, group: str | None) -> str:
    label = f"CASE WHEN coalesce(trim(documents.{kind}), '') = '' THEN '(missing)' ELSE trim(documents.{kind}) END"
    return f"""
WITH {corpora(kind, group)},
voc AS (WITH {vocabulary_cte(TEXT)}
  SELECT {label} AS corpus, count(DISTINCT term) AS vocabulary_size, count(DISTINCT t.doc_id) AS docs, count(DISTINCT x.doc_id) AS used
  FROM tok t JOIN documents USING (doc_id) LEFT JOIN dtc x ON x.doc_id = t.doc_id GROUP BY 1),
lexical AS (SELECT corpus, vocabulary_size, round(used / CAST(docs AS DOUBLE), 6) AS lexical_coverage FROM voc),
topical AS (WITH {LANGUAGES}
  SELECT {label} AS corpus,
         round(least({", ".join(f"avg(CASE WHEN r = {i} THEN 1.0 ELSE 0.0 END)" for i in range(1, _k + 1))}), 6) AS minimum_topic_prevalence,
         round(avg(CASE WHEN r > {_k} THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_document_rate
  FROM documents JOIN n ON n.language = lang GROUP BY 1),
stable AS (WITH {LANGUAGES} SELECT minimum_topic_stability FROM compared WHERE selected_plan)
SELECT corpus, {_rules}, vocabulary_size, lexical_coverage, minimum_topic_prevalence, ambiguous_document_rate
FROM facts LEFT JOIN lexical USING (corpus) LEFT JOIN topical USING (corpus), stable
"""


ORACLES["evidence_profile"] = evidence("source", "lang")
ORACLES["language_evidence"] = evidence("lang", None)
