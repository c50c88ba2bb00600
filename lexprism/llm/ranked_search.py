"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

Documents lie in blocks. In a block every term of a query has a list of
documents and impacts, greatest impact first. Lists are read from the front;
what is read of a document bounds its score from below, and what is still
unread of the lists it was not met in bounds it from above. Reading goes on
until no document outside the result can belong to it and every score in it is
final. The best rows of a task's earlier blocks set the bar for the later ones.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_READ = 64
BLOCK_POSTINGS = 1 << 19
GROUP_TERMS = 200_000
MOST = np.iinfo(np.int64).max


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """10 + (90 * length * documents) div total of each document."""
    if 90 * int(lengths.max(initial=0)) * documents <= MOST:
        return 10 + 90 * lengths * documents // total
    return np.array([10 + 90 * n * documents // total for n in lengths.tolist()], np.int64)


class Lists:
    """The lists of a block: for each term its documents (as places) and impacts, greatest impact first."""

    def __init__(self, place: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, weights: np.ndarray, documents: int, total: int):
        part = length_part(length, documents, total)[place]
        impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * part))
        order = np.lexsort((-impact, term))
        self.place, self.impact = place[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(len(weights) + 1))


def nra(lists: Lists, terms: np.ndarray, ids: np.ndarray, k: int, known: list[tuple[int, int]], lower: np.ndarray) -> list[tuple[int, int]]:
    """The k best (score, -id) of ``known`` and of a block's documents, for a query of ``terms``.

    ``lower`` is a zeroed array of one score for each document of the block; it
    is zeroed again.
    """
    at, end = lists.begin[terms], lists.begin[terms + 1]
    there = at < end
    at, end = at[there].copy(), end[there]
    wanted = np.ones(len(at), bool)
    read_place: list[np.ndarray] = []
    read_list: list[np.ndarray] = []
    met = np.zeros(0, np.int64)
    step, closed, live = FIRST_READ, False, met
    bar_known = known[-1][0] if len(known) == k else 0
    while True:
        ahead = np.where(wanted, np.minimum(end - at, step), 0)
        which = np.repeat(np.arange(len(at)), ahead)
        places = np.repeat(at - (np.cumsum(ahead) - ahead), ahead) + np.arange(ahead.sum())
        found = lists.place[places]
        np.add.at(lower, found, lists.impact[places])
        read_place.append(found)
        read_list.append(which)
        at = at + ahead
        step *= 4
        open_ = at < end
        bound = np.where(open_, lists.impact[np.minimum(at, len(lists.impact) - 1)], 0) if len(at) else at
        unmet = int(bound.sum())  # no document not met yet can score more

        met = np.unique(np.concatenate([met, found]))
        low = lower[met]
        bar = bar_known
        if len(low) + len(known) >= k:
            scores = np.concatenate([low, np.array([s for s, _ in known], np.int64)])
            bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        seen_place, seen_list = np.concatenate(read_place), np.concatenate(read_list)
        read = np.zeros(len(lower), np.int64)
        np.add.at(read, seen_place, bound[seen_list])
        high = low + unmet - read[met]
        live = met[high >= bar]  # a document that may tie may still win by its id
        unsettled = met[(high >= bar) & (high > low)]
        closed = unmet < bar or unmet == 0
        if closed and not len(unsettled):
            break
        if closed:  # only lists that an unsettled document has not been met in
            mark = np.zeros(len(lower), bool)
            mark[unsettled] = True
            there = mark[seen_place]
            held = np.bincount(seen_list[there], minlength=len(at))
            wanted = open_ & (held < len(unsettled))
        else:
            wanted = open_
    best = list(zip(lower[live].tolist(), (-ids[live]).tolist()))
    lower[met] = 0
    return heapq.nlargest(k, [*known, *((s, i) for s, i in best if s > 0)])


def _terms_of(text: str, find) -> list[str]:
    return find(text.translate(_FOLD))


_FOLD = str.maketrans(UPPER, LOWER)


def _counted(documents: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """id, n (terms of the text), terms and counts (of the numbered terms it holds) of every document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _terms_of(text.as_py(), find)
                if words:
                    held = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                    ids.append(row)
                    lengths.append(len(words))
                    terms.append([t for t, _ in held])
                    counts.append([c for _, c in held])
            arrays = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())]
            arrays += [pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "counts"])

    return documents.mapInArrow(count, "id long, n long, terms array<int>, counts array<long>")


def _searched(counted: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """Each task's k best documents of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]

        def block(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, length = rows["id"].to_numpy(), rows["n"].to_numpy()
            terms, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
            sizes = terms.value_lengths().to_numpy()
            place = np.repeat(np.arange(len(ids)), sizes)
            lists = Lists(place, terms.flatten().to_numpy(), counts.flatten().to_numpy(), length, weights, documents, total)
            lower = np.zeros(len(ids), np.int64)
            for q, (_, asked) in enumerate(queries):
                best[q] = nra(lists, asked, ids, k, best[q], lower)

        held: list[pa.RecordBatch] = []
        postings = 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= BLOCK_POSTINGS:
                block(held)
                held, postings = [], 0
        if postings:
            block(held)
        out = [(item, -minus, score) for (item, _), rows in zip(queries, best) for score, minus in rows]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])

    return counted.mapInArrow(search, "item long, doc long, score long")


def ranked_search(
    queries: DataFrame, documents: DataFrame, query_id: str = "item_id", query_text: str = "text", id_column: str = "doc_id",
    text: str = "text", k: int = 10,
) -> DataFrame:
    """``query_id``, rank int (from 1), ``id_column`` and score long: each query's k best documents with a score above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower
    case. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's
    score adds weight * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms,
    where m is 10 + (90 n N) div L. N counts documents with a term, L their
    terms, n one document's. Equal scores go to the smaller id.

    Query texts of one id are one query. Null and empty texts have no terms;
    queries without an id and documents without an id are not ranked, though the latter
    count in N, L and df. Repeated document rows are ranked each. Ids are longs. Empty
    tables give an empty result. Other columns are not read.

    Every text is read once for each group of queries; groups are drawn by the
    hash of the query's id so that they expect at most 200,000 terms, which is
    what is sent to the tasks. Counts of the asked terms are written, and the
    lists are built from them in blocks of about half a million entries. Each
    task returns at most k rows a query.
    """
    spark = documents.sparkSession
    asked = queries.select(
        F.col(f"`{query_id}`").cast("long").alias("item"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{query_text}`").cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0)))).alias("term"),
    )
    asked = materialise(asked.where("item is not null").distinct(), "asked")
    texts = documents.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    groups = -(-asked.count() // GROUP_TERMS)
    parts = []
    for group in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).groupBy("item").agg(F.collect_list("term").alias("terms"))
        wanted = [(r["item"], r["terms"]) for r in mine.orderBy("item").collect()]
        numbers = {term: i for i, term in enumerate(sorted({t for _, terms in wanted for t in terms}))}
        counted = materialise(_counted(texts, numbers), "counted")
        whole = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        if not whole["documents"]:
            continue
        holding = np.zeros(len(numbers), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each asked term
            holding[r["term"]] = r["count"]
        weights = np.array([term_weight(whole["documents"], n) for n in holding.tolist()], np.int64)
        plan = [(item, np.array(sorted(numbers[t] for t in terms), np.int64)) for item, terms in wanted]
        found = _searched(counted.where("id is not null"), plan, weights, whole["documents"], whole["total"], k)
        parts.append(materialise(found, "found"))
    if not parts:
        parts = [spark.createDataFrame([], "item long, doc long, score long")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(query_id), "rank", F.col("doc").alias(id_column), "score")
