"""Ranked lexical search: postings in shards of documents, and WAND over each shard.

:func:`index` writes the postings once. :func:`search` ranks all documents for each query: a term can add at most its weight times
the greatest impact that it has in a shard, so only documents whose terms could together reach the lowest score of a query's
heap (the pivots) are scored. A task keeps its heaps from one shard to the next; the heaps of all tasks are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.fmindex import ragged
from marlstone.llm.words import blocks, chunks, term_codes
from marlstone.plans.scratch import cut, free

#: About so many bytes of text make a shard. Bytes of query texts that are sent to the tasks at once.
SHARD_BYTES, QUERY_BYTES = 8_000_000, 16_000_000
INDEX = "docs long, n long, terms binary, ids array<long>, lengths binary, offsets binary, places binary, counts binary, wide int"
#: Above the length of any document: null ids come last among equal scores.
NO_ID = np.iinfo(np.int64).max


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """Numbers from 0 on in as few bytes each as they need, and how many those are."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return x.astype(kind).tobytes(), kind.itemsize


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Postings of all documents as a written table, a row for each shard: its terms, and of each the documents and the counts.

    Shards are made where the documents are read: nothing is shuffled. Null and empty texts have no terms; a very long text
    makes a shard of its own; repeated rows and ids are documents of their own; an empty table gives an empty index; columns
    other than the two named aren't looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, most=shard_bytes):
                codes, lengths, terms = term_codes(texts)
                # A posting is a (term, document); its count is how often the number repeats among the sorted ones.
                key = np.sort(codes.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths))
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[first, len(key)])
                term, place = np.divmod(key[first], len(texts))
                places, wide_places = narrow(place)
                tf, wide_counts = narrow(counts)
                yield pa.record_batch(
                    {
                        "docs": pa.array([int(np.count_nonzero(lengths))], pa.int64()),
                        "n": pa.array([int(lengths.sum())], pa.int64()),
                        "terms": pa.array(["\n".join(terms.to_pylist()).encode()], pa.binary()),
                        "ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        "lengths": pa.array([lengths.tobytes()], pa.binary()),
                        "offsets": pa.array([np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64).tobytes()], pa.binary()),
                        "places": pa.array([places], pa.binary()),
                        "counts": pa.array([tf], pa.binary()),
                        "wide": pa.array([wide_places * 16 + wide_counts], pa.int32()),
                    }
                )

    return cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).withColumnRenamed(text, "text").mapInArrow(task, INDEX), "postings")


def places_of(terms: list[str], blob: bytes) -> np.ndarray:
    """The number that each term has in a shard, -1 where it has none."""
    known = {t: i for i, t in enumerate(blob.decode().split("\n"))} if blob else {}
    return np.array([known.get(t, -1) for t in terms], np.int64)


def frequencies(shards: DataFrame, terms: list[str]) -> np.ndarray:
    """How many documents hold each term. Each task sends a line for a term that it has seen."""
    sent = shards.sparkSession.sparkContext.broadcast(terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for blob, offsets in zip(batch.column("terms").to_pylist(), batch.column("offsets").to_pylist(), strict=True):
                at = places_of(sent.value, blob)
                n[at >= 0] += np.diff(np.frombuffer(offsets, np.int64))[at[at >= 0]]
        some = np.flatnonzero(n)
        yield pa.record_batch({"term": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    found = shards.select("terms", "offsets").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(terms), np.int64)
    n[found.column("term").to_numpy()] = found.column("n").to_numpy()
    sent.unpersist()
    return n


class Heaps:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.score, self.doc = np.zeros((queries, k), np.int64), np.full((queries, k), NO_ID, np.int64)

    def least(self, q: int) -> int:
        """What a document must score at least to enter: scores of 0 don't count, equal scores may win by their id."""
        return max(1, int(self.score[q, -1]))

    def add(self, q: int, scores: np.ndarray, docs: np.ndarray) -> None:
        score, doc = np.r_[self.score[q], scores], np.r_[self.doc[q], docs]
        best = np.lexsort((doc, -score))[: self.score.shape[1]]
        self.score[q], self.doc[q] = score[best], doc[best]


def wand(shard: dict, queries: list[np.ndarray], terms: list[str], weights: np.ndarray, mean: tuple[int, int], heaps: Heaps) -> None:
    """Let the documents of a shard into the heaps of all queries. ``mean``: documents and terms of the corpus.

    For each query the lists are ordered by the most that each can add. Those that together stay below the heap's lowest score
    can't make a pivot by themselves: their documents are looked up only as far as pivots of the other lists need it, the
    list that can add most first, and a document is dropped once its score with all that may follow is too low.
    """
    at = places_of(terms, shard["terms"])
    here = np.flatnonzero(at >= 0)
    if not len(here):
        return
    lengths, offsets = np.frombuffer(shard["lengths"], np.int64), np.frombuffer(shard["offsets"], np.int64)
    wide_places, wide_counts = divmod(shard["wide"], 16)
    ids = np.array([NO_ID if i is None else i for i in shard["ids"]], np.int64)
    low, high = offsets[at[here]], offsets[at[here] + 1]
    rows, which = ragged(low, high)
    place = np.frombuffer(shard["places"], f"<u{wide_places}")[rows].astype(np.int64)
    tf = np.frombuffer(shard["counts"], f"<u{wide_counts}")[rows].astype(np.int64)
    n_docs, n_terms = mean
    m = 50 + (50 * lengths * n_docs) // n_terms
    adds = weights[here][which] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
    bounds = np.r_[0, np.cumsum(high - low)]
    most = np.zeros(len(terms), np.int64)
    most[here] = np.maximum.reduceat(adds, bounds[:-1])
    start, end = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    start[here], end[here] = bounds[:-1], bounds[1:]
    for q, own in enumerate(queries):
        own = own[most[own] > 0]
        own = own[np.argsort(most[own], kind="stable")]
        reach = np.cumsum(most[own])
        least = heaps.least(q)
        if not len(own) or reach[-1] < least:
            continue  # no document of this shard can enter
        pivots = int(np.searchsorted(reach, least))  # the lists before it can't reach the heap together
        rest = int(reach[pivots - 1]) if pivots else 0
        lists = own[pivots:]
        posting, of = ragged(start[lists], end[lists])
        score, bound = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(bound, place[posting], most[lists][of])
        pivot = bound + rest >= least
        posting = posting[pivot[place[posting]]]
        np.add.at(score, place[posting], adds[posting])
        found = np.flatnonzero(pivot & (bound > 0) & (score + rest >= least))
        for t in own[:pivots][::-1]:
            if not len(found):
                break
            docs = place[start[t] : end[t]]
            i = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score[found] += np.where(docs[i] == found, adds[start[t] : end[t]][i], 0)
            rest -= int(most[t])
            found = found[score[found] + rest >= least]
        if len(found):
            heaps.add(q, score[found], ids[found])


def search(shards: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` best documents of an :func:`index` for each item: item_id, rank (from 1), doc_id, score.

    A document's score is the sum, over the item's terms, once each, of w * (1000000000 * tf div (1000 * tf + 20 * m)), with
    m = 50 + 50 * n * N div L and w = floor(1000 * ln((2N + 2) / (2df + 1))), N and df being documents (with terms; with the term),
    n and L terms (of the document; of all), tf the term's count in the document. All but w is in whole numbers of 64 bits.

    Only scores above 0 count, so there may be fewer than ``k``; equal scores go by id, null ids last, and a repeated document
    has a rank each time. A null or empty item finds nothing; a repeated item is a query each time. Item texts go to the tasks in
    blocks of ``block_bytes``, each in its own passes over the index; the driver holds the terms of one block.
    """
    spark = shards.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    corpus = shards.agg(F.sum("docs"), F.sum("n")).first()
    found = []
    for block in blocks(asked, F.octet_length("text"), block_bytes, "queries"):
        codes, counts, known = term_codes([t.encode() for t in block.column("text").to_pylist()])
        if not len(codes) or not corpus[1]:
            continue
        terms = known.to_pylist()
        queries = [np.unique(q) for q in np.split(codes, np.cumsum(counts)[:-1])]
        df = frequencies(shards, terms)
        weights = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        sent = spark.sparkContext.broadcast((queries, terms, weights))

        def task(batches: Iterator[pa.RecordBatch], sent=sent, mean=(corpus[0], corpus[1])) -> Iterator[pa.RecordBatch]:
            queries, terms, weights = sent.value
            heaps = Heaps(len(queries), k)
            for batch in batches:
                for at in range(batch.num_rows):
                    wand({c: batch.column(c)[at].as_py() for c in batch.schema.names}, queries, terms, weights, mean, heaps)
            q, r = np.nonzero(heaps.score > 0)
            doc = heaps.doc[q, r]
            yield pa.record_batch({"asked": pa.array(q, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID), "score": pa.array(heaps.score[q, r])})

        heaps = shards.select("terms", "ids", "lengths", "offsets", "places", "counts", "wide").mapInArrow(task, "asked long, doc_id long, score long")
        order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, v) for i, v in enumerate(block.column("item_id").to_pylist())], f"asked long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found.append(cut(best.join(names, "asked").select("item_id", "rank", "doc_id", "score"), "ranked"))
    out = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`index` and :func:`search` in one; the index is freed."""
    shards = index(docs, doc_id, text)
    out = search(shards, items, k)
    free(shards)
    return out
