"""Benchmark decontamination: an FM-index of each shard of the documents, searched backward for every window of the test items.

:func:`index` writes the shards once; :func:`find` asks any number of test items of them, :func:`spans` gives what to remove,
:func:`without` removes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.fmindex import FMIndex, ragged
from marlstone.llm.words import TERM, blocks, chunks, must_be_free, pieces, term_codes
from marlstone.plans.scratch import cut, free

#: About so many bytes of text make a shard; a longer text is spread over several.
SHARD_BYTES = 4_000_000
#: Bytes of item texts that are sent to the tasks at once; more are searched for in several passes over the index.
ITEM_BYTES = 32_000_000
PARTS = ("bits", "ranks", "zeros", "starts", "samples")
INDEX = f"terms binary, owner binary, first binary, rows array<struct<row:long,doc_id:long,text:int,base:long,own:long>>, {', '.join(f'{p} binary' for p in PARTS)}"

ROWS = pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.int32()), ("base", pa.int64()), ("own", pa.int64())]))
SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def stretches(texts: list[bytes], reach: int, most: int) -> Iterator[tuple[list[bytes], list[int], int, int]]:
    """Shards of some texts: (texts, their places, terms before the first, terms of these seen before).

    A text over a shard's size comes alone, a part at a time, each with the last ``reach - 1`` terms of those before it.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= most]
    if short:
        yield [texts[i] for i in short], short, 0, 0
    for i in sorted(set(range(len(texts))) - set(short)):
        seen, tail = 0, []
        for part in pieces(texts[i], most):
            codes, _, terms = term_codes([part])
            yield [b" ".join([*tail, part])], [i], seen - len(tail), len(tail)
            last = terms.take(pa.array(codes[max(0, len(codes) - reach + 1) :])).to_pylist()
            tail = [*tail, *(t.encode() for t in last)][-(reach - 1) :] if reach > 1 else []
            seen += len(codes)


def index(docs: DataFrame, reach: int = 64, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """FM-indexes of all documents as a written table, a row for each shard. Phrases of up to ``reach`` terms can be searched for.

    Shards are made where the documents are read: nothing is shuffled. Equal texts of a shard are indexed once, for all of
    their rows. Rows are told apart by a number of their own, so repeated rows, repeated ids and null ids do no harm. Null and empty texts
    have no terms. A text over a shard's size is spread over several shards, each with the terms before it that a phrase
    may need. An empty table gives an empty index; columns other than the two named aren't looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, most=shard_bytes):
                rows, ids = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
                known: dict[bytes, int] = {}
                which = [known.setdefault(t, len(known)) for t in texts]
                members: list[list[int]] = [[] for _ in known]
                for i, k in enumerate(which):
                    members[k].append(i)
                for own, places, base, seen in stretches(list(known), reach, shard_bytes):
                    codes, counts, terms = term_codes(own)
                    ends = np.cumsum(counts)
                    fm = FMIndex.build(np.insert(codes + 1, ends, 0))
                    held = [(rows[i], ids[i], at, base, int(counts[at]) - seen) for at, k in enumerate(places) for i in members[k]]
                    columns = {
                        "terms": pa.array(["\n".join(terms.to_pylist()).encode()], pa.binary()),
                        "owner": pa.array([np.array(places, np.int64).tobytes()], pa.binary()),
                        "first": pa.array([(np.r_[0, ends[:-1]] + np.arange(len(ends))).astype(np.int64).tobytes()], pa.binary()),
                        "rows": pa.array([[dict(zip(("row", "doc_id", "text", "base", "own"), h, strict=True)) for h in held]], ROWS),
                    }
                    columns |= {p: pa.array([b], pa.binary()) for p, b in fm.dump().items()}
                    yield pa.record_batch(columns)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(task, INDEX), "fm-index")


def phrases_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Distinct windows of some items: their terms as numbers (-1 at the right of shorter ones), lengths, the terms by number;
    and pairs (window, item). An item shorter than a window, but not empty, is one window."""
    codes, counts, terms = term_codes(texts)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    item = np.repeat(np.arange(len(texts)), n)
    at = starts[item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(window, counts[item])
    place = at[:, None] + np.arange(window)
    inside = np.arange(window) < length[:, None]
    found = np.where(inside, codes[np.where(inside, place, 0)] if len(codes) else 0, -1).astype(np.int32)
    unique, which = np.unique(found, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), item], axis=1), axis=0)
    return unique, (unique >= 0).sum(axis=1), terms, pairs[:, 0], pairs[:, 1]


def hits(shards: DataFrame, texts: list[bytes], ids: list[str], window: int) -> DataFrame:
    """(row, spans, items) of each document row of some shards with a window of these items: merged spans [from, to) in terms, and ids."""
    unique, lengths, terms, of_window, of_item = phrases_of(texts, window)
    sent = shards.sparkSession.sparkContext.broadcast((unique, lengths, terms.to_pylist(), np.searchsorted(of_window, np.arange(len(unique) + 1)), of_item, ids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique, lengths, terms, bounds, of_item, ids = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard = {c: batch.column(c)[k].as_py() for c in ("terms", "first", *PARTS)}
                known = dict(zip(shard["terms"].decode().split("\n"), range(1, 1 << 31), strict=False)) if shard["terms"] else {}
                symbol = np.array([*(known.get(t, 0) for t in terms), 0], np.int32)  # -1 takes the last
                phrases = symbol[unique]
                some = np.flatnonzero(((phrases > 0).sum(axis=1) == lengths) & (lengths > 0))
                if not len(some):
                    continue
                fm, first = FMIndex.load(shard), np.frombuffer(shard["first"], np.int64)
                low, high = fm.search(phrases[some], lengths[some])
                rows, which = ragged(low, high)
                if not len(rows):
                    continue
                at, phrase = fm.locate(rows), some[which]
                text = np.searchsorted(first, at, "right") - 1
                # Spans of a text that touch or overlap become one; no span goes over the end of its text.
                edge = np.zeros(int(fm.starts[-1]) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + lengths[phrase], -1)
                covered = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
                turns = np.flatnonzero(covered[1:] != covered[:-1])
                begin, end = turns[::2], turns[1::2]
                span_text = np.searchsorted(first, begin, "right") - 1
                pairs = np.unique(np.stack([text, phrase], axis=1), axis=0)
                which_item, of_pair = ragged(bounds[pairs[:, 1]], bounds[pairs[:, 1] + 1])
                items = np.unique(np.stack([pairs[of_pair, 0], of_item[which_item]], axis=1), axis=0)
                out: dict[str, list] = {"row": [], "spans": [], "items": []}
                for r in batch.column("rows")[k].as_py():
                    a, b = np.searchsorted(span_text, [r["text"], r["text"] + 1])
                    if a < b:
                        shift = r["base"] - first[r["text"]]
                        c, d = np.searchsorted(items[:, 0], [r["text"], r["text"] + 1])
                        out["row"].append(r["row"])
                        out["spans"].append([{"from": int(x + shift), "to": int(y + shift)} for x, y in zip(begin[a:b], end[a:b], strict=True)])
                        out["items"].append([ids[i] for i in items[c:d, 1].tolist()])
                yield pa.record_batch([pa.array(out["row"], pa.int64()), pa.array(out["spans"], SPANS), pa.array(out["items"], pa.list_(pa.string()))], names=["row", "spans", "items"])

    return shards.select("terms", "first", "rows", *PARTS).mapInArrow(task, "row long, spans array<struct<from:long,to:long>>, items array<string>")


def merged(spans: Column) -> Column:
    """Sorted spans without overlap, of spans in any order."""
    grown = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["to"] >= s["from"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["from"].alias("from"), F.greatest(F.element_at(a, -1)["to"], s["to"]).alias("to")))),
    ).otherwise(F.concat(a, F.array(s)))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return F.aggregate(F.array_sort(spans), none, grown)


def find(shards: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text", block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Documents of an :func:`index` with the windows of test items in them: row, doc_id, n_words, spans, items.

    A window is ``window`` consecutive terms of an item; an item with fewer, but not none, is one window. spans: merged [from, to) in
    terms, of all occurrences of all windows; items: ids (as text, each once, sorted) with a window that occurs. There is a row
    for each document row, hit or not; spans and items are then empty.

    Null items have no windows; null ids count as the empty id; repeated items do no harm; no items, no hits. Item texts go to
    the tasks in blocks of ``block_bytes``, each in its own pass over the index. ``window`` may not be over the index's reach.
    """
    asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found: list[DataFrame] = []
    for block in blocks(asked, F.octet_length("text"), block_bytes, "items"):
        texts = [t.encode() for t in block.column("text").to_pylist()]
        found.append(cut(hits(shards, texts, block.column("item_id").to_pylist(), window), "hits"))
    # A long text has a row in each of its shards, and one for each item block.
    own = shards.select(F.explode("rows").alias("r")).groupBy("r.row").agg(F.first("r.doc_id").alias("doc_id"), F.sum("r.own").alias("n_words"))
    none = shards.sparkSession.createDataFrame([], "row long, spans array<struct<from:long,to:long>>, items array<string>")
    every = none
    for part in found:
        every = every.unionByName(part)
    by_row = every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = own.join(by_row, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        merged(F.coalesce("spans", F.array().cast("array<struct<from:bigint,to:bigint>>"))).alias("spans"),
        F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"),
    )
    out = cut(out, "found")
    free(*found)
    return out


def spans(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of each document row: :func:`index` and :func:`find` in one, the index is freed."""
    shards = index(docs, reach=window, doc_id=doc_id, text=text)
    out = find(shards, items, window)
    free(shards)
    return out.drop("row")


def without(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``d_text``: the text without the terms of its spans and what lies between them. Other texts stay as they are.

    Rows as in :func:`find`; the input must read the same way twice, as a table does, for rows are matched by their place.
    """
    must_be_free(["d_row", "d_text", "d_spans"], docs.columns, "decontamination.without")
    shards = index(docs, reach=window, doc_id=doc_id, text=text)
    hit = find(shards, items, window).filter(F.size("spans") > 0).select(F.col("row").alias("d_row"), F.col("spans").alias("d_spans"))
    free(shards)
    other = TERM.replace("^", "").replace("+", "*")
    # A term with what follows it is a part; what comes before the first is kept.
    parts = F.regexp_extract_all(text, F.lit(f"({TERM}{other})"), F.lit(1))
    head = F.regexp_extract(text, f"^({other})", 1)
    kept = F.filter(parts, lambda _, i: ~F.exists("d_spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    rows = docs.withColumn("d_row", F.monotonically_increasing_id()).join(hit, "d_row", "left")
    return rows.withColumn("d_text", F.when(F.col("d_spans").isNull(), F.col(text)).otherwise(F.concat(head, F.array_join(kept, "")))).drop("d_row", "d_spans")
