"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters fit, then one exchange."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.words import must_be_free
from marlstone.plans.scratch import cut

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Rows that a piece of a shard has at most, about; a piece is what one task sorts.
PIECE_ROWS = 200_000
#: Probes for a boundary in a round, and for all boundaries together.
PROBES, ALL_PROBES = 24, 200_000

Key = tuple[int, int]


def slots_below(h: np.ndarray, d: np.ndarray, keys: list[Key]) -> np.ndarray:
    """For each row (h, d), how many of the sorted ``keys`` are at most its own key."""
    heads = np.array([k[0] for k in keys], np.int64)
    left, right = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
    for head in np.unique(heads[left[left < right]]):
        a, b = np.searchsorted(heads, head, "left"), np.searchsorted(heads, head, "right")
        rows = np.flatnonzero(h == head)
        right[rows] = a + np.searchsorted(np.array([k[1] for k in keys[a:b]], np.int64), d[rows], "right")
    return right


def histogram(rows: DataFrame, keys: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes below each of the sorted ``keys``. Each task sends a line for a gap that it has rows in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for b in batches:
            at = slots_below(b.column("h").to_numpy(), b.column("d").to_numpy(), keys)
            n += np.bincount(at, minlength=len(n))
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(at) else []
            if len(at):
                size[at[order][starts]] += np.add.reduceat(b.column("size").to_numpy()[order], starts)
        some = np.flatnonzero(n)
        yield pa.record_batch({"gap": pa.array(some, pa.int64()), "n": pa.array(n[some]), "size": pa.array(size[some])})

    found = rows.select("h", "d", "size").mapInArrow(count, "gap long, n long, size long").groupBy("gap").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    n, size = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for r in found:
        n[r["gap"]], size[r["gap"]] = r["n"], r["size"]
    return np.cumsum(n)[:-1], np.cumsum(size)[:-1]


def between(low: Key, high: Key, probes: int) -> list[Key]:
    """Up to ``probes`` keys strictly between two keys: by the first part while that leaves room, then by the second."""
    if high[0] - low[0] > 1:
        step = high[0] - low[0]
        return sorted({(low[0] + step * i // (probes + 1), LOW) for i in range(1, probes + 1)} - {low, high})
    # All rows between share one first part (a group of equal texts).
    top = high[1] if high[0] == low[0] else HIGH
    step = top - low[1]
    return sorted({(low[0], low[1] + step * i // (probes + 1)) for i in range(1, probes + 1)} - {low, high})


def splitters(rows: DataFrame, goals: list[int], total_rows: int, total_bytes: int, near: int, slack: int, span: tuple[int, int]) -> tuple[list[Key], list[tuple[int, int]]]:
    """For each goal, a number of bytes, the key with about so many bytes below it; and the rows and bytes below each.

    The edge of a group of equal texts that is nearest to the goal is taken if it is within ``slack`` of it. Else the goal lies
    deep inside a group larger than that, which is cut at the key nearest to the goal, within ``near`` or at the next document.
    """
    known: dict[Key, tuple[int, int]] = {(LOW, LOW): (0, 0), (HIGH, HIGH): (total_rows, total_bytes)}
    low, high = [(LOW, LOW)] * len(goals), [(HIGH, HIGH)] * len(goals)
    best: list[Key] = [(LOW, LOW)] * len(goals)
    open_ = list(range(len(goals)))
    probes = max(2, min(PROBES, ALL_PROBES // max(1, len(goals))))
    while open_:
        asked: set[Key] = set()
        for i in open_:
            a, b = low[i], high[i]
            if a[0] == b[0] - 1 and b[1] == LOW or a[0] == b[0]:  # within a group ids lie in a narrow span
                a = max(a, (a[0], span[0] - 1)) if span[0] > LOW else a
                b = min(b, (a[0], min(span[1], HIGH - 1) + 1))
            asked.update(between(a, b, probes))
        asked -= known.keys()
        if asked:
            keys = sorted(asked)
            n, size = histogram(rows, keys)
            known.update({k: (int(x), int(y)) for k, x, y in zip(keys, n, size, strict=True)})
        order = sorted(known)
        sizes = [known[k][1] for k in order]
        edges = [k for k in order if k[1] == LOW or k == (HIGH, HIGH)]
        edge_sizes = [known[k][1] for k in edges]
        still = []
        for i in open_:
            off = lambda k, i=i: (abs(known[k][1] - goals[i]), k)
            at = bisect.bisect_right(edge_sizes, goals[i])
            left, right = edges[at - 1], edges[min(at, len(edges) - 1)]
            edge = min((left, right), key=off)
            if known[right][0] - known[left][0] <= 1 or off(edge)[0] <= near:
                # No group lies between, or the edge is as near as anyone could wish.
                best[i] = edge
                continue
            if right[0] - left[0] > 1:
                if (left, right) == (low[i], high[i]):  # nothing between was left to ask
                    best[i] = edge
                    continue
                low[i], high[i] = left, right
                still.append(i)
                continue
            # One group lies between the two edges.
            if off(edge)[0] <= slack:
                best[i] = edge
                continue
            at = bisect.bisect_right(sizes, goals[i])
            a, b = order[at - 1], order[min(at, len(order) - 1)]
            best[i] = min((a, b), key=off)
            done = off(best[i])[0] <= near or known[b][0] - known[a][0] <= 1 or (a, b) == (low[i], high[i])
            low[i], high[i] = a, b
            if not done:
                still.append(i)
        open_ = still
    found = sorted(best)
    return found, [known[k] for k in found]


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", size: Column | None = None, tolerance: float = 0.002, slack: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows into ``shards`` ranges of near equal bytes of the key (64-bit hash of the text, id).

    Equal texts are neighbours in that order. Boundaries lie at edges of their groups, moved by up to ``slack`` of a shard; so a
    group of up to twice that size is never cut. A larger one may be, where no edge is that near to a boundary; there the
    boundary comes within ``tolerance`` of its goal, or to the next document. Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 in key order, without gaps in a
    shard), grown_shard (null) and the columns of ``keep``.

    Null text counts as no bytes (crc32 0) and null ids sort first. Rows alike in text and id have one key: they go to one
    shard, in any order among themselves. An empty table gives no rows. Other columns are dropped unless in ``keep``, and none may
    have the name of a returned one (ValueError). Of a text only its hash and size are kept, so very long ones do no harm; a
    shard is as uneven as its largest document.
    """
    must_be_free(["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], [c for c in keep if c != doc_id], "sharding.shard")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8 if size is None else size
    meta = cut(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW)).alias("d"),
            size.alias("size"),
            F.crc32(raw).alias("text_crc32"),
            *[F.col(c).alias(f"kept_{c}") for c in keep],
        ),
        "shard-keys",
    )
    n, total, first, last = meta.agg(F.count("*"), F.sum("size"), F.min("d"), F.max("d")).first()
    per_shard = max(1, -(-n // (shards * PIECE_ROWS)))
    share = (total or 0) / shards
    near, most = max(1, int(tolerance * share)), int(slack * share)
    keys, below = splitters(meta, [total * i // shards for i in range(1, shards)], n, total, near, most, (first, last)) if n else ([], [])
    if n and per_shard > 1:  # pieces of a shard may cut any group
        ends = [0, *(size for _, size in below), total]
        goals = [a + (b - a) * j // per_shard for a, b in zip(ends[:-1], ends[1:], strict=True) for j in range(1, per_shard)]
        inner, inner_below = splitters(meta, goals, n, total, near, 0, (first, last))
        step = per_shard - 1
        cut_at = lambda own, outer: [x for i in range(shards) for x in (*own[i * step : (i + 1) * step], *outer[i : i + 1])]
        keys, below = cut_at(inner, keys), cut_at(inner_below, below)
    below = [0, *(rows_ for rows_, _ in below), *[n] * (shards * per_shard - 1 - len(below))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slots_below(b.column("h").to_numpy(), b.column("d").to_numpy(), keys) if keys else np.zeros(b.num_rows, np.int64)
            base = np.array(below, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array((at // per_shard).astype(np.int32)), pa.array(base[at] - base[at // per_shard * per_shard])], names=[*b.schema.names, "piece", "shard", "first_slot"])

    placed = meta.mapInArrow(place, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in meta.schema)}, piece int, shard int, first_slot long")
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("h", "d"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + rank - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"kept_{c}").alias(c) for c in keep],
    )
