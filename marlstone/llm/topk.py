"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation are kept. For segments of length s,

    <q, v> <= sum over segments of s * (mean_q * mean_v + dev_q * dev_v)

by Cauchy and Schwarz (the same as a lower bound on the distance, as |q|^2 + |v|^2 - 2 <q, v> = |q - v|^2). The bound
tightens as segments get shorter. Pairs that can't reach the k-th best score so far are dropped at the coarsest resolution
that shows it: the coarse bound is worked out for all pairs, each finer one for the survivors of the one before, and exact
integer scores for those of the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.scratch import cut, free

#: Queries that one pass over the candidates takes; their vectors are at most QUERY_VALUES numbers, and are broadcast.
QUERY_ROWS, QUERY_VALUES = 8192, 4_000_000
#: Candidates compared at once. Segments at each resolution, coarse to fine.
BLOCK, SEGMENTS = 1024, (4, 16)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def segments_of(dim: int) -> list[int]:
    """The resolutions of vectors of a length; a segment has one component at least, and the coarsest is always there."""
    return sorted({min(s, dim) for s in SEGMENTS})


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(s) * mean and sqrt(s) * deviation of each segment (the last may be shorter); products of rows bound."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    lengths = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / np.sqrt(lengths)
    return np.hstack([mean, np.sqrt(np.maximum(squares - mean * mean, 0))])


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def prepared(rows: DataFrame) -> DataFrame:
    """(at, vec_id, asks, dim, x, s0, s1): vectors and their statistics at each resolution as 64-bit floats; at: a number for each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == dim))
                    x = own.column("vector").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                    levels = [statistics(x, s) for s in segments_of(dim)]
                    levels += [np.zeros((len(x), 0))] * (len(SEGMENTS) - len(levels))
                    columns = [own.column(c) for c in ("at", "vec_id", "asks", "dim")]
                    yield pa.RecordBatch.from_arrays([*columns, packed(x), *map(packed, levels)], names=["at", "vec_id", "asks", "dim", "x", *(f"s{i}" for i in range(len(SEGMENTS)))])

    schema = "at long, vec_id long, asks boolean, dim int, x binary, " + ", ".join(f"s{i} binary" for i in range(len(SEGMENTS)))
    return rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", "asks", F.size("vector").alias("dim"), "vector").mapInArrow(task, schema)


def best_of(queries: np.ndarray, own: list[np.ndarray], at: np.ndarray, k: int, batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of this task for each query (x, statistics, row), ties to the smaller id."""
    scale = np.linalg.norm(queries, axis=1)
    score = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    segments = segments_of(dim)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            ids, rows = part.column("vec_id").to_numpy(), part.column("at").to_numpy()
            x = unpacked(part.column("x"), dim)
            levels = [unpacked(part.column(f"s{i}"), 2 * s) for i, s in enumerate(segments)]
            # Rounding of the bound is far below this slack; scores are whole numbers.
            slack = 1e-9 * np.outer(scale, np.linalg.norm(x, axis=1)) + 0.5
            alive = own[0] @ levels[0].T + slack >= score[:, -1:]
            for i in np.flatnonzero(alive.any(axis=1)).tolist():
                pick = np.flatnonzero(alive[i] & (rows != at[i]))
                for mine, level in zip(own[1:], levels[1:], strict=True):
                    pick = pick[level[pick] @ mine[i] + slack[i, pick] >= score[i, -1]]
                exact = x[pick] @ queries[i]
                good = exact >= score[i, -1]
                if good.any():
                    s, v = np.r_[score[i], exact[good]], np.r_[found[i], ids[pick[good]]]
                    order = np.lexsort((v, -s))[:k]
                    score[i], found[i] = s[order], v[order]
    q, r = np.nonzero(np.isfinite(score))
    yield pa.record_batch({"asked": pa.array(at[q], pa.int64()), "vec_id": pa.array(found[q, r], pa.int64()), "score": pa.array(score[q, r].astype(np.int64))})


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other vector: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` holds; each goes against all rows but its own, ties to the smaller id, fewer
    than ``k`` if there are fewer. Vectors that are null, empty or hold a null or non-finite component take no part, nor do
    null ids. Rows are told apart by their place, not by their id: a repeated row is a candidate each time, a partner of the
    other rows of its id, and a query each time with a list of its own. Only vectors of one length are compared. An empty
    table gives no rows; only the two columns named and those of ``is_query`` are looked at.

    Queries are taken in chunks of bounded size, one after the other: the driver holds one chunk, sends it to the tasks, and
    one pass over all candidates answers it, keeping k rows for each query and task. Scores are exact while they stay below 2^53.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("vector"), is_query.alias("asks")).filter("vector is not null and vec_id is not null")
    rows = cut(prepared(rows), "vectors")
    asked = cut(rows.filter("asks"), "queries")
    parts: list[DataFrame] = []
    for dim, n in sorted(asked.groupBy("dim").count().collect()):
        pieces = max(1, -(-n // min(QUERY_ROWS, max(1, QUERY_VALUES // dim))))
        like = rows.filter(F.col("dim") == dim).drop("asks", "dim")
        for piece in range(pieces):
            chunk = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("at"), F.lit(pieces)) == piece)).toArrow().combine_chunks()
            if not len(chunk):
                continue
            own = [unpacked(chunk.column(f"s{i}"), 2 * s) for i, s in enumerate(segments_of(dim))]
            sent = spark.sparkContext.broadcast((unpacked(chunk.column("x"), dim), own, chunk.column("at").to_numpy()))

            def task(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
                queries, own, at = sent.value
                yield from best_of(queries, own, at, k, batches, dim)

            order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
            best = like.mapInArrow(task, "asked long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            parts.append(cut(best, "best"))
            sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out.join(asked.select(F.col("at").alias("asked"), F.col("vec_id").alias("query_id")), "asked").select("query_id", "rank", "vec_id", "score"), "top")
    free(rows, asked, *parts)
    return out
