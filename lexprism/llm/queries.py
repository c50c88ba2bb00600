"""Registered queries of the training-data operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import ASSISTANT, format_examples, read_back
from .exact_search import top_k
from .language import predict_languages, train_languages
from .manifest import dataset_manifest
from .mixing import mix_sources, with_tokens
from .packing import pack
from .pieces import piece_digests
from .quality import in_fold, score_quality, train_quality
from .ranked_search import ranked_search
from .secrets import BASE, scan_secrets, span_list
from .simhash import near_duplicates
from .sketches import containment, fingerprint_edits, resemblance, sketch_text
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def registered(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@registered
def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


@registered
def op3_source_mixing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64("text"))
    counted = with_tokens(documents, TOKENIZER, ("doc_id", "source", "lang", "n_chars", "text_hash"))
    drawn = mix_sources(counted, tokens=F.col("n_tokens"), target_entropy=None, toward_even=0.5)
    return drawn.select("doc_id", "source", "mix_copy", "mix_block", "mix_tokens", "mix_weight")


@registered
def op4_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = train_quality(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents, model)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@registered
def op5_document_fingerprints(spark, sf_dir):
    found = fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"), sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("within_edited"),
    )


@registered
def op6_chat_formatting(spark, sf_dir):
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    found = read_back(format_examples(rows))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("replies", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLES["op6_chat_formatting"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length('<turn >' || chr(10) || '</turn>' || chr(10)) + length(role) + length(text)
             + len(regexp_extract_all(role || text, '[\\<>]'))) OVER w AS so_far
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, max(n) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


@registered
def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


@registered
def op8_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = predict_languages(documents, train_languages(documents))
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


@registered
def op9_simhash_near_duplicates(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op10_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    base = of(*BASE)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("findings")).alias("spans")
    )


@registered
def op11_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), full_ AS (SELECT row, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM full_
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), held AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM full_) WHERE term IN (SELECT term FROM q) GROUP BY row, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term, docs
), impact AS (
  SELECT h.term, f.doc_id, f.row, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS s
  FROM held h JOIN weighed USING (term) JOIN full_ f USING (row), whole
), scored AS (
  SELECT item_id, doc_id, row, CAST(sum(s) AS BIGINT) AS score FROM q JOIN impact USING (term)
  WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, row HAVING sum(s) > 0
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
)
SELECT * FROM placed WHERE rank <= 10
"""


def tampered_rows() -> Column:
    """Every seventh row or so, by the checksum of its decimal id."""
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


@registered
def op12_merkle_manifest(spark, sf_dir):
    return dataset_manifest(table(spark, sf_dir, "documents"), tampered=tampered_rows())


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


_BEFORE = " || ".join(map(_field, ("doc_id", "source", "lang")))
ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE marked AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 7 = 0 AS tampered
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256({_BEFORE} || {_field("n_chars")} || {_field("text")}) AS leaf,
         CASE WHEN tampered THEN sha256({_BEFORE} || {_field("(n_chars + 1)")} || {_field("text")}) END AS altered
  FROM marked
), trees AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM hashed)
), leaves AS (
  SELECT doc_id, leaf, altered, t, row_number() OVER () AS row,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n
  FROM hashed JOIN trees ON hashed.lang IS NOT DISTINCT FROM trees.lang
), nodes AS (
  SELECT t, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT t, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY t, level, i // 2, n
), upper_nodes AS (
  SELECT -1::BIGINT AS t, 0 AS level, t AS i, h, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT t, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM upper_nodes WHERE n > 1 GROUP BY t, level, i // 2, n
), every AS (SELECT * FROM nodes UNION ALL SELECT * FROM upper_nodes
), walk AS (
  SELECT row, t, 0 AS level, i, coalesce(altered, leaf) AS h, '' AS proof, false AS done FROM leaves
  UNION ALL
  SELECT w.row, CASE WHEN o.n > 1 THEN w.t ELSE -1 END, CASE WHEN o.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN o.n > 1 THEN w.i // 2 ELSE w.t END,
         CASE WHEN o.n = 1 THEN w.h WHEN s.h IS NULL THEN sha256(w.h) WHEN w.i % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END,
         w.proof || coalesce(s.h, ''), o.n = 1 AND w.t = -1
  FROM walk w JOIN every o ON o.t = w.t AND o.level = w.level AND o.i = w.i
  LEFT JOIN every s ON s.t = w.t AND s.level = w.level AND s.i = xor(w.i, 1)
  WHERE NOT w.done
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN walk w ON w.row = l.row AND w.done JOIN nodes s ON s.t = l.t AND s.n = 1, (SELECT h FROM upper_nodes WHERE n = 1) r
"""


@registered
def op13_piece_ids(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents"), PIECES)
