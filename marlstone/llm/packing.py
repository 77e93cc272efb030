"""Best-fit packing into bins of several permitted lengths.

Items of one length are interchangeable, so the packing is worked out on the histogram of lengths, which has at most as many
lines as the largest bin has tokens, whatever the number of documents. Bins with equal contents form a class; best-fit
decreasing moves whole classes at a time. The result is a table of segments "items of this length with these ranks go to
these bins"; each item finds its segment by its rank among the items of its length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.words import must_be_free, n_words
from marlstone.plans.scratch import cut

#: Permitted lengths of a sequence, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Columns that are added or used inside, after ``p_``.
OWN = ("piece", "start", "tokens", "bin", "capacity", "offset", "size", "hash", "bucket", "before", "within", "rank")
#: Ranks are counted in buckets of items, of about this many.
BUCKET_ROWS = 500_000


@dataclass(frozen=True)
class Segments:
    """Row i: items of length[i] with ranks from rank[i] on, up to the next row's, go to bins from bin[i] on, one each, at
    offset[i]. Classes: bins from class_bin[j] on, up to the next one's, have class_capacity[j] and hold class_used[j]."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    class_bin: np.ndarray
    class_capacity: np.ndarray
    class_used: np.ndarray


def cost(capacity: int, most: int, quadratic: float) -> float:
    """What a sequence costs: its tokens, and a share that grows with the square of its length as attention does."""
    return capacity + quadratic * capacity * capacity / most


def cheapest(length: int, left: dict[int, int], lengths: list[int], capacities: tuple[int, ...], quadratic: float) -> int:
    """The bin size of least cost for a token that it would hold, if filled from ``length`` on with the longest items left."""
    best = None
    for c in capacities:
        if c < length:
            continue
        free, taken = c, defaultdict(int)
        at = bisect.bisect_right(lengths, min(length, free))
        while free and at:
            item = lengths[at - 1]
            n = min(left[item] - taken[item], free // item) if item <= length else 0
            taken[item] += n
            free -= n * item
            at = min(at - 1, bisect.bisect_right(lengths, free))
        held = c - free
        rate = (cost(c, capacities[-1], quadratic) / max(held, 1), c)
        best = min(best, rate) if best else rate
    return best[1]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, quadratic: float = 0.25) -> Segments:
    """Best-fit decreasing on a histogram of lengths from 1 to the largest capacity.

    The longest items go first. An item goes to the open bin that it fills best. If none can take it, the bin size is opened
    that costs least for the tokens that it can be expected to hold. At the end each bin shrinks to the smallest permitted
    length that holds its contents.
    """
    lengths = sorted(k for k, n in histogram.items() if n)
    left = {k: histogram[k] for k in lengths}
    classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # free tokens -> (first bin, bins, capacity)
    free_sizes: list[int] = []
    rows: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(free: int, first: int, n: int, capacity: int) -> None:
        if not classes[free]:
            bisect.insort(free_sizes, free)
        classes[free].append((first, n, capacity))

    for length in reversed(lengths):
        rank, n = 0, left[length]
        while n:
            at = bisect.bisect_left(free_sizes, length)
            if at < len(free_sizes):
                free = free_sizes[at]
                first, count, capacity = classes[free].pop()
                if not classes[free]:
                    free_sizes.pop(at)
                used = min(n, count)
                rows.append((length, rank, first, capacity - free))
                put(free - length, first, used, capacity)
                if used < count:
                    put(free, first + used, count - used, capacity)
            else:
                capacity = cheapest(length, left, lengths, capacities, quadratic)
                # As many bins as the remaining items fill when each takes as many of them as fit.
                each = capacity // length
                used = max(1, n // each)
                rows.append((length, rank, bins, 0))
                put(capacity - length, bins, used, capacity)
                bins += used
            rank += used
            n -= used
            left[length] = n
    ends = sorted((first, n, capacity, free) for free, own in classes.items() for first, n, capacity in own)
    rows.sort()
    fit = [capacities[bisect.bisect_left(capacities, capacity - free)] for _, _, capacity, free in ends]
    column = lambda x: np.array(x, np.int64)
    return Segments(*(column([r[i] for r in rows]) for i in range(4)), column([e[0] for e in ends]), column(fit), column([c - f for _, _, c, f in ends]))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, quadratic: float = 0.25, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pack every token of every row into sequences of the permitted lengths.

    ``tokens`` is the number of tokens of a row (words by default). A row longer than the largest length is cut into pieces
    of that length and a rest, so nothing is dropped. Adds to ``keep``: p_piece and p_start (of the row's tokens), p_tokens,
    p_bin, p_capacity, p_offset (in the bin). Rows without tokens give one line with p_tokens 0 and nulls for the bin.
    Null ids and texts are allowed, alike rows are packed each on their own, items of one length are ordered by a hash of id and
    text, and an empty table gives no rows. A kept column that has the name of one that is added or used inside (p_...) is a
    ValueError. Texts are only counted, so very long ones are taken whole.

    The driver gets the histogram (at most ``capacities[-1]`` lines) and sends the segments, whose number is bounded by it.
    """
    must_be_free([f"p_{c}" for c in OWN], list(keep), "packing.pack")
    spark, most = docs.sparkSession, capacities[-1]
    size = n_words(F.col(text)) if tokens is None else tokens
    rows = docs.select(*keep, size.alias("p_size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("p_hash"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("p_size") / most)).cast("int")
    items = rows.withColumn("p_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    items = items.withColumn("p_start", F.col("p_piece").cast("long") * most).withColumn("p_tokens", F.least(F.lit(most).cast("long"), F.col("p_size") - F.col("p_start"))).drop("p_size")
    items = cut(items, "pack-items")
    found = {r["p_tokens"]: r["count"] for r in items.groupBy("p_tokens").count().collect()}
    total = sum(found.values())
    segments = plan({k: n for k, n in found.items() if k}, capacities, quadratic)

    # Rank among the items of a length: within a bucket by a window, plus the counts of the buckets before.
    buckets = max(16, total // BUCKET_ROWS)
    items = items.withColumn("p_bucket", F.pmod(F.hash("p_hash", "p_piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("p_tokens").orderBy("p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("p_tokens", "p_bucket").count().select("p_tokens", "p_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("p_before"))
    within = F.row_number().over(Window.partitionBy("p_tokens", "p_bucket").orderBy("p_hash", "p_piece"))
    ranked = items.withColumn("p_within", within - 1).join(offsets, ["p_tokens", "p_bucket"]).withColumn("p_rank", F.col("p_before") + F.col("p_within"))
    sent = spark.sparkContext.broadcast(segments)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        # One sorted key for (length, rank): ranks are below 2^40, lengths below 2^22.
        keys = (s.length << 40) + s.rank
        for batch in batches:
            length, rank = batch.column("p_tokens").to_numpy(), batch.column("p_rank").to_numpy()
            none = length == 0
            at = np.maximum(np.searchsorted(keys, (length << 40) + rank, "right") - 1, 0)
            if len(keys):
                bin_, offset = s.bin[at] + rank - s.rank[at], s.offset[at]
                capacity = s.class_capacity[np.maximum(np.searchsorted(s.class_bin, bin_, "right") - 1, 0)]
            else:
                bin_ = offset = capacity = np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64(), mask=none) for x in (bin_, capacity, offset))], names=[*batch.schema.names, "p_bin", "p_capacity", "p_offset"])

    narrow = ranked.select(*keep, "p_piece", "p_start", "p_tokens", "p_rank")
    schema = narrow.select("*", *[F.lit(0).cast("long").alias(c) for c in ("p_bin", "p_capacity", "p_offset")]).schema
    for field in schema:
        field.nullable = True
    return narrow.mapInArrow(place, schema).drop("p_rank")
