"""Jaccard join on word n-grams: a MinHash LSH forest finds candidates, exact sets verify them.

Texts with the same words form a class, and only one text of a class is looked at. Its label in each of TREES tries is a
sequence of MinHash values, two bytes each; sorted labels are a prefix trie, and classes that share a prefix lie in one bucket.
Prefixes start deep and are shortened step by step until a link of the threshold itself, which is the hardest to find, is found
with the wanted chance.

At each depth every member of a bucket is verified against one pivot of the bucket, by exact sets: rows grow in proportion to
the bucket, however large a group of copies is. Members whose groups of links have met are not compared again. At the last
depth, what is left of a bucket (members of several groups, none of them a pivot) is compared group against group in blocks of
bounded size; the largest group of a bucket is dealt over blocks and the few others go to each of them.

So every two texts that meet in a bucket and are alike end up in one group of links; links inside a group that has already
met are not listed one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import chunks, free_name, word_hashes
from marlstone.plans.scratch import PATH, cut, free

#: Tries, depths of their prefixes in the order in which they are tried, bytes of a value in a label.
TREES, DEPTHS, VALUE = 20, (6, 4, 3, 2), 2
#: Classes and n-grams of a block, about.
BLOCK, BLOCK_GRAMS = 1024, 1_000_000
#: A key with more rows than HOT is spread over SALTS places; up to HOT_KEYS such keys are broadcast.
HOT, SALTS, HOT_KEYS = 1000, 64, 1_000_000
#: The filter for the second reading has FILTER_EACH bits a class, and this many at least and at most.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 28
#: Rounds after which a graph that is still not connected up is an error.
ROUNDS = 200

_draw = np.random.default_rng(20240501)
MULTIPLY = _draw.integers(0, 1 << 31, TREES * DEPTHS[0], dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _draw.integers(0, 1 << 32, TREES * DEPTHS[0], dtype=np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams_of(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams of some texts, repeats included, and the text of each.

    A text of one to n-1 words has one n-gram, made of all its words; one without words has none.
    """
    width = np.clip(lengths, 1, n)
    grams = np.maximum(lengths - width + 1, 0) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), grams)
    first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    out = np.zeros(len(first), np.uint64)
    wide = width[text]
    for i in range(n if len(out) else 0):
        out = np.where(i < wide, out * BASE + hashes[np.minimum(first + i, len(hashes) - 1)], out)
    return mixed(out + wide.astype(np.uint64)), text


def labels_of(grams: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Labels of the texts, shape (texts, TREES, DEPTHS[0]) in big-endian pairs of bytes. Texts without n-grams have zeros."""
    small = (grams >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, np.diff(text) > 0]) if len(text) else np.zeros(0, np.int64)
    out = np.zeros((texts, TREES * DEPTHS[0]), ">u2")
    buffer = np.empty_like(small)
    for k in range(TREES * DEPTHS[0] if len(starts) else 0):
        np.multiply(small, MULTIPLY[k], out=buffer)
        np.add(buffer, ADD[k], out=buffer)
        least = np.minimum.reduceat(buffer, starts)
        out[text[starts], k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def keys_of(hashes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """128-bit hashes of the words of each text."""
    edges = np.r_[0, np.cumsum(lengths)]
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def sketch(docs: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """For each row: doc_id, t (hash of the text), key (of its words), n_grams (with repeats) and labels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", 1_000_000):
                hashes, lengths = word_hashes(texts)
                grams, of = grams_of(hashes, lengths, n)
                labels = labels_of(grams, of, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("t"),
                        pa.array(keys_of(hashes, lengths), pa.binary()),
                        pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64)),
                        pa.array([x.tobytes() for x in labels], pa.binary()),
                    ],
                    names=["doc_id", "t", "key", "n_grams", "labels"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(task, "doc_id long, t long, key binary, n_grams long, labels binary")


def bucket(depth: int) -> Column:
    """A 64-bit name of the prefix of a label in its trie; two prefixes of one name only cost a comparison."""
    return F.xxhash64("tree", F.substr("labels", F.col("tree") * (VALUE * DEPTHS[0]) + 1, F.lit(VALUE * depth)))


def spread(rows: DataFrame, facts: DataFrame, on: str, size: str, salt: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``on`` and ``size``, the number of its rows in ``rows``.

    Rows of a key with more than HOT of them are dealt over SALTS places by the column ``salt``, and that key's fact goes to each.
    """
    hot = facts.filter(F.col(size) > HOT).select(on, F.lit(SALTS).alias("places"))
    n = hot.count()
    if not n:
        return rows.join(facts, on, how)
    hot = F.broadcast(hot) if n <= HOT_KEYS else hot
    dealt = rows.join(hot, on, "left").withColumn("place", F.when(F.col("places").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.lit(SALTS)))).drop("places")
    last = F.when(F.col(size) > HOT, SALTS - 1).otherwise(0)
    return dealt.join(facts.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))), [on, "place"], how).drop("place")


def salted(rows: DataFrame, facts: DataFrame, on: str, salt: str) -> DataFrame:
    """As :func:`spread`, for tables of links and members: every key is dealt by ``salt``, and no number of rows is needed."""
    dealt = rows.withColumn("place", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    return dealt.join(dealt.select(on, "place").distinct().join(facts, on), [on, "place"]).drop("place")


def filter_slots(key: bytes, doc_id: int | None, bits: int) -> list[int]:
    whole = xxhash.xxh3_128_intdigest(key + (b"" if doc_id is None else doc_id.to_bytes(8, "big", signed=True)))
    return [(whole >> (32 * i)) % bits for i in range(4)]


def filter_of(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of (key, rep); each task sends the words that it sets, and a shuffle merges them.

    Its size grows with the classes up to FILTER_MOST bits (32 MB), which is what a task holds. Beyond that more rows pass,
    and the exact join removes them all the same.
    """
    bits = FILTER_LEAST
    while bits < min(FILTER_MOST, FILTER_EACH * wanted.count()):
        bits *= 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for key, rep in zip(b.column("key").to_pylist(), b.column("rep").to_pylist(), strict=True):
                for s in filter_slots(key, rep, bits):
                    own[s >> 3] |= 1 << (s & 7)
        words = own.view(np.int64)
        some = np.flatnonzero(words)
        for i in range(0, len(some), 65_536):
            at = some[i : i + 65_536]
            yield pa.record_batch({"at": pa.array(at, pa.int64()), "bits": pa.array(words[at])})

    found = wanted.select("key", "rep").mapInArrow(task, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    if len(found):
        out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """(key, n, grams) of the classes in ``wanted`` (key, rep): texts are read again, a filter passes few others, an exact join removes them."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        bits = 8 * len(filter_)
        for batch in batches:
            for part, texts in chunks(batch, "text", 1_000_000):
                hashes, lengths = word_hashes(texts)
                keys, ids = keys_of(hashes, lengths), part.column("doc_id").to_pylist()
                use = [i for i in range(len(keys)) if all(filter_[s >> 3] >> (s & 7) & 1 for s in filter_slots(keys[i], ids[i], bits))]
                if use:
                    edges = np.r_[0, np.cumsum(lengths)]
                    grams, of = grams_of(np.concatenate([hashes[edges[i] : edges[i + 1]] for i in use]), lengths[use], n)
                    cuts = np.searchsorted(of, np.arange(len(use) + 1))
                    sets = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in use], pa.binary()), pa.array([ids[i] for i in use], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                        names=["key", "rep", "grams"],
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "key binary, rep long, grams array<long>")
    # Rows of one key have the same words, and so one set; a condition on rep would be another partitioning, and sets would move twice.
    return rows.select("key", "grams").join(wanted.select("key"), "key").groupBy("key").agg(F.first("grams").alias("grams")).select("key", F.size("grams").alias("n"), "grams")


def found_at(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The chance that two sets of this similarity share a prefix of this depth in one of the tries."""
    return 1 - (1 - similarity**depth) ** TREES


def depths_for(threshold: float, recall: float) -> tuple[int, ...]:
    """Depths down to the first that finds links of the threshold itself, the hardest, with the chance ``recall``."""
    for i, depth in enumerate(DEPTHS):
        if found_at(threshold, depth) >= recall:
            return DEPTHS[: i + 1]
    raise ValueError(f"{TREES} tries don't find links of similarity {threshold} with a chance of {recall}")


def shared(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` (key, pivot) that are alike. Sets move once to their keys' names and once to their pivot.

    A pivot of more than HOT keys is met in SALTS places, each with its set.
    """
    hot = pairs.groupBy("pivot").agg(F.count("*").alias("size")).filter(F.col("size") > HOT).select("pivot")
    n = hot.count()
    place = F.lit(0).cast("long")
    if n:
        hot = hot.withColumn("hot", F.lit(True))
        pairs = pairs.join(F.broadcast(hot) if n <= HOT_KEYS else hot, "pivot", "left")
        place = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0)
    dealt = pairs.select("pivot", place.alias("place"), F.col("key").alias("name"))
    ends = dealt.withColumn("side", F.lit(1)).unionByName(dealt.select("pivot", "place", F.col("pivot").alias("name"), F.lit(0).alias("side")).distinct())
    rows = ends.join(sets.select(F.col("key").alias("name"), "grams"), "name").select("pivot", "place", "side", "name", "grams")
    rows = rows.repartition("pivot", "place").sortWithinPartitions("pivot", "place", "side")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: bytes | None = None
        own = np.zeros(0, np.uint64)
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            grams, found = batch.column("grams"), []
            values, ends = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
            names = zip(*(batch.column(c).to_pylist() for c in ("pivot", "side", "name")), strict=True)
            for k, (now, side, name) in enumerate(names):
                others = values[ends[k] : ends[k + 1]]
                if not side:
                    pivot, own = now, others.copy()
                elif now == pivot and min(len(own), len(others)) >= threshold * max(len(own), len(others)) - 1e-9:
                    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
                    common = int(np.count_nonzero(own[at] == others))
                    similarity = common / (len(own) + len(others) - common)
                    if similarity >= threshold - 1e-9:
                        found.append((name, pivot, similarity))
            if found:
                a, b, similarities = zip(*found, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(similarities, pa.float64())})

    return rows.select("pivot", "side", "name", "grams").mapInArrow(task, "a binary, b binary, similarity double")


def stars(members: DataFrame, at: str, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) of members (key, root, bucket ``at``) with the pivot of their bucket; and key, pivot and bucket of each.

    The pivot is the least key. Members whose ``root`` is the pivot's have met it already, and buckets of one root are skipped.
    """
    pivots = members.groupBy(at).agg(F.min(F.struct("key", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    pivots = cut(pivots.filter("low <> high").select(at, "size", F.col("p.key").alias("pivot"), F.col("p.root").alias("p_root")), "pivots")
    met = cut(spread(members, pivots, at, "size", "key").select("key", "pivot", at, (F.col("root") == F.col("p_root")).alias("known")), "met")
    pairs = cut(met.filter("not known").select("key", "pivot").distinct(), "pairs")
    links = cut(shared(sets, pairs, threshold), "links")
    free(pivots, pairs)
    return links, met


class Groups:
    """Disjoint sets of names."""

    def __init__(self, names: list[bytes]) -> None:
        self.parent = {n: n for n in names}

    def top(self, a: bytes) -> bytes:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: bytes, b: bytes) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def hits(rows: list[tuple], one: bool, threshold: float, apart: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers a and b (one and many) that are alike, and their similarities, among rows (side, key, root, grams) sorted by side.

    Rows of ``one`` block all meet; else those of one side meet those of the other. ``apart``: only rows of different roots.
    """
    left = len(rows) if one else sum(r[0] == rows[0][0] for r in rows)
    names = {r: i for i, r in enumerate(dict.fromkeys(r[2] for r in rows))}
    root = np.array([names[r[2]] for r in rows])
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    edges = np.r_[0, np.cumsum(sizes)]
    grams, ids = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    held = np.zeros(len(grams), bool)
    for a in range(left):
        lo = a + 1 if one else left
        small, large = np.minimum(sizes[lo:], sizes[a]), np.maximum(sizes[lo:], sizes[a])
        fits = small >= threshold * large - 1e-9
        pick = np.flatnonzero(fits & (root[lo:] != root[a]) if apart else fits) + lo
        if not len(pick):
            continue
        held[ids[edges[a] : edges[a + 1]]] = True
        if 4 * len(pick) < len(rows) - lo:
            common = np.array([np.count_nonzero(held[ids[edges[b] : edges[b + 1]]]) for b in pick])
        else:
            common = np.add.reduceat(held[ids[edges[lo] :]].astype(np.int32), edges[lo:-1] - edges[lo])[pick - lo]
        held[ids[edges[a] : edges[a + 1]]] = False
        either = sizes[a] + sizes[pick] - common
        hit = common >= threshold * either - 1e-9
        if hit.any():
            yield a, pick[hit], common[hit] / either[hit]


def compare(rows: list[tuple], one: bool, threshold: float) -> Iterator[tuple[bytes, bytes, float]]:
    """Links between different roots among ``rows``; only those that join groups."""
    rows.sort(key=lambda r: (r[0], r[1]))
    groups = Groups([r[2] for r in rows])
    for a, others, similarities in hits(rows, one, threshold, True):
        for b, s in zip(others.tolist(), similarities.tolist(), strict=True):
            if groups.join(rows[a][2], rows[b][2]):
                yield rows[a][1], rows[b][1], s


def in_block(values: DataFrame, at: list[str], each: str, schema: str, work: Callable[[list[tuple], bool], Iterator[tuple]]) -> DataFrame:
    """``work`` on the rows (side, key, ``each``, grams) of every block; ``values``: ``at`` (of a bucket), kind, i, j, side, key, ``each``, grams.

    kind 0: rows of two sides; 1: of chunks i and j, which may be one; 2: of one block.
    """
    place_of = [*at, "kind", "i", "j"]
    rows = values.select(*place_of, "side", "key", each, "grams").repartition(*place_of).sortWithinPartitions(*place_of)
    types = {"binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}
    fields = [(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if place is None:
                return
            kind, i, j = place[-3:]
            one = kind == 2 or (kind == 1 and i == j)
            found = list(work(held, one)) if len(held) > 1 and (one or len({r[0] for r in held}) == 2) else []
            if found:
                yield pa.record_batch({name: pa.array(column, kind_) for (name, kind_), column in zip(fields, zip(*found, strict=True), strict=True)})

        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            grams = batch.column("grams")
            values_, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
            places = zip(*(batch.column(n).to_pylist() for n in place_of), strict=True)
            rest = zip(*(batch.column(n).to_pylist() for n in ("side", "key", each)), strict=True)
            for k, (now, row) in enumerate(zip(places, rest, strict=True)):
                if now != place:
                    yield from flush()
                    held, place = [], now
                held.append((*row, values_[ends[k] : ends[k + 1]].copy()))
        yield from flush()

    return rows.mapInArrow(task, schema)


def in_blocks(members: DataFrame, at: str, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between members (key, root, bucket ``at``) of different roots; bucket by bucket, in blocks.

    The members of the most frequent root are side 0, cut into d chunks; all others are side 1, cut into m chunks. Chunks of
    side 0 meet chunks of side 1, and those of side 1 each other, so a bucket with few others is read in proportion to its size.
    """
    by_root = members.join(sets.select("key", "n"), "key").groupBy(at, "root").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    whole = by_root.groupBy(at).agg(F.count("*").alias("roots"), F.sum("size").alias("size"), F.sum("grams").alias("grams"), F.max(F.struct("size", "root", "grams")).alias("most"))
    part = lambda n, grams: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(grams / BLOCK_GRAMS)).cast("int")
    plan = whole.filter("roots > 1").select(
        at,
        F.col("most.root").alias("most"),
        part(F.col("most.size"), F.col("most.grams")).alias("d"),
        part(F.col("size") - F.col("most.size"), F.col("grams") - F.col("most.grams")).alias("m"),
    )
    rows = salted(members, plan, at, "key")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    mark = F.xxhash64("key", F.lit(7))
    first = F.col("root") == F.col("most")
    own = F.when(first, F.pmod(mark, F.col("d"))).otherwise(F.pmod(mark, F.col("m"))).cast("int")
    side = F.when(first, 0).otherwise(1)
    line = lambda kind, i, j, side: F.struct(kind.alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    whole_bucket = F.array(line(F.lit(2), F.lit(0), F.lit(0), F.lit(0)))
    across = F.when(first, F.transform(numbers(F.col("m")), lambda j: line(F.lit(0), F.col("own"), j, F.lit(0)))).otherwise(F.transform(numbers(F.col("d")), lambda i: line(F.lit(0), i, F.col("own"), F.lit(1))))
    among = F.when(first, F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")).otherwise(F.transform(numbers(F.col("m")), lambda o: line(F.lit(1), F.least("own", o), F.greatest("own", o), F.col("own"))))
    lines = F.when((F.col("d") == 1) & (F.col("m") == 1), whole_bucket).otherwise(F.concat(across, among))
    dealt = rows.withColumn("own", own).select("key", "root", at, F.explode(lines).alias("line")).select("key", "root", at, "line.*")
    dealt = cut(dealt, "dealt")  # its size is known then: sets stay where they are if it is small
    full = dealt.join(sets.select("key", "grams"), "key")
    return in_block(full, [at], "root", "a binary, b binary, similarity double", lambda held, one: compare(held, one, threshold))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of the connected components of edges (a, b); root is the least key of a component.

    In each round every key is replaced by the least of itself and its neighbours, in the edges and in the roots so far; edges
    between equal keys go, so the graph shrinks. Keys are hashes, which lets chains shrink by a part in each round too. A
    hub's rows are spread, and each round is cut.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    for _ in range(ROUNDS):
        if edges.isEmpty():
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root")) if roots is None else roots
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size")), "least")
        new = spread(edges, least, "a", "size", "b").select(F.col("m").alias("x"), "b")
        new = spread(new, least.select(F.col("a").alias("b"), "m", "size"), "b", "size", "x").select("x", F.col("m").alias("y")).filter("x <> y")
        new = cut(new.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if roots is None:
            now = least.select(F.col("a").alias("key"), F.col("m").alias("root"))
            setattr(now, PATH, getattr(least, PATH))
            kept = (edges,)
        else:
            sizes = roots.groupBy("root").agg(F.count("*").alias("size")).join(least.select(F.col("a").alias("root"), "m"), "root")
            sizes = cut(sizes, "sizes")
            now = cut(spread(roots, sizes, "root", "size", "key", "left").select("key", F.coalesce("m", "root").alias("root")), "roots")
            kept = (edges, least, roots, sizes)
        free(*kept)
        edges, roots = new, now
    raise RuntimeError(f"the graph of links isn't connected up after {ROUNDS} rounds")


def with_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with the root of their key's component; a key without links is its own."""
    if roots is None:
        return rows.withColumn("root", F.col("key"))
    return rows.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def linked(docs: DataFrame, classes: DataFrame, n: int, threshold: float, recall: float, text: str, doc_id: str) -> tuple[DataFrame, DataFrame] | None:
    """All verified links (a, b, similarity) between keys of ``classes``, and the sets of all that may have any; None if no two share a bucket."""
    depths = depths_for(threshold, recall)
    names = [f"b{d}" for d in depths]
    rows = classes.filter("n_grams > 0").select("key", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("key", *[bucket(d).alias(b) for d, b in zip(depths, names, strict=True)])
    sizes = cut(rows.groupBy(names[-1]).agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    members = cut(spread(rows, sizes, names[-1], "size", "key").drop("size"), "members")
    free(sizes)
    if members.isEmpty():
        return None
    wanted = cut(members.select("key").distinct().join(classes.select("key", "rep"), "key"), "wanted")
    # Four joins on the key follow: in buckets, sets don't move to them.
    sets = cut(sets_of(docs, wanted, n, text, doc_id), "sets", "key")
    free(wanted)
    found: list[DataFrame] = []
    roots: DataFrame | None = None
    for b in names:
        links, met = stars(with_root(members.select("key", b), roots), b, sets, threshold)
        found.append(links)
        before, roots = roots, components(reduce(DataFrame.unionByName, found).select("a", "b"))
        free(before)
    # What is left at the last depth: pivots have met all of their bucket.
    left = cut(with_root(met.filter("key <> pivot").select("key", names[-1]), roots), "left")
    every = cut(reduce(DataFrame.unionByName, [*found, in_blocks(left, names[-1], sets, threshold)]), "links")
    free(members, met, left, roots, *found)
    return every, sets


def all_links(every: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, links): the rows of all other texts that each text is linked to. ``every``: key, members, root; ``sets`` has all that are linked.

    Each pair of a class is compared, in blocks, so work and rows grow with the square of a class: no other way gives every count.
    """
    mark = F.xxhash64("key", F.lit(7))
    sizes = every.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1")
    live = cut(spread(every.select("key", "members", "root"), cut(sizes, "sizes"), "root", "size", "key"), "live")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = live.withColumn("own", F.pmod(mark, parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("root", F.lit(1).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "key", "members")

    def count(rows: list[tuple], one: bool) -> Iterator[tuple[bytes, int]]:
        rows.sort(key=lambda r: r[:2])
        members, total = np.array([r[2] for r in rows], np.int64), np.zeros(len(rows), np.int64)
        for a, others, _ in hits(rows, one, threshold, False):
            total[a] += members[others].sum()
            total[others] += members[a]
        for i in np.flatnonzero(total).tolist():
            yield rows[i][1], int(total[i])

    counts = in_block(dealt.join(sets.select("key", "grams"), "key"), ["root"], "members", "key binary, links long", count)
    out = cut(counts.groupBy("key").agg(F.sum("links").alias("links")), "counts")
    free(live)
    return out


def joined(docs: DataFrame, n: int, threshold: float, recall: float, text: str, doc_id: str, count_all: bool) -> tuple[DataFrame, list[DataFrame]]:
    """What :func:`join` returns, and the cut tables that it reads."""
    meta = cut(sketch(docs, n, text, doc_id), "sketch")
    classes = cut(meta.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_grams").alias("n_grams"), F.first("labels").alias("labels")), "classes")
    found, sets = linked(docs, classes, n, threshold, recall, text, doc_id) or (None, None)
    each = classes.select("key", "rep", "members")
    if found is None:
        every = each.withColumns({"root": F.col("key"), "links": F.lit(0).cast("long"), "best": F.lit(None).cast("struct<similarity:double,key:binary>")})
    else:
        roots = components(found.select("a", "b"))
        ends = found.select(F.col("a").alias("key"), F.col("b").alias("other"), "similarity").unionByName(found.select(F.col("b").alias("key"), F.col("a").alias("other"), "similarity"))
        degree = ends.distinct().groupBy("key").agg(F.count("*").alias("links"), F.max(F.struct("similarity", F.col("other").alias("key"))).alias("best"))
        every = each.join(roots, "key", "left").join(degree, "key", "left").withColumns({"root": F.coalesce("root", "key"), "links": F.coalesce("links", F.lit(0).cast("long"))})
    every = cut(every, "every")
    first = every.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = every.filter("best is not null").select("key", F.col("best.similarity").alias("similarity"), F.col("best.key").alias("other"))
    best = salted(known, each.select(F.col("key").alias("other"), F.col("rep").alias("link_id")), "other", "key").select("key", "similarity", "link_id")
    full = salted(every.drop("best"), first, "root", "key").join(best, "key", "left")
    if count_all and sets is not None:
        full = full.drop("links").join(all_links(every, sets, threshold), "key", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    full = cut(full.select("key", "members", F.col("root").alias("class_key"), F.col("rep").alias("rep_id"), "class_id", (F.col("members") - 1 + F.col("links")).alias("n_links"), "link_id", "similarity"), "full")
    free(classes, found, sets, every)
    out = spread(meta.select("doc_id", "t", "key"), full, "key", "members", "doc_id")
    return out.select("doc_id", "t", "class_key", "rep_id", "class_id", "n_links", "link_id", "similarity"), [meta, full]


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id", count_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, t (64-bit hash of its text), class_key, rep_id, class_id, n_links, link_id, similarity.

    Texts are linked if their sets of word n-grams have a Jaccard similarity of at least ``threshold``; texts of the same words
    are. rep_id is the least id of the texts with the same words (their representative), and class_id the least id of all that
    are linked, directly or through others. Of the links between representatives, those are verified and listed that hold the
    classes together: link_id is the representative that this text is linked to most closely of them, with their exact
    similarity (null without such a link). n_links counts the other rows with the same words and the listed links of its text;
    with ``count_all`` it counts all linked rows, for which every pair of a class has to be compared.

    Texts without words (null and empty ones too) are alike, and linked to each other alone. Null ids are never least, unless
    all are null. Repeated rows count each; of ties the least key stands. An empty table gives no rows. A very long text is
    taken whole, at about 20 bytes a word in the task that reads it. Only doc_id and the text are looked at, so other columns
    may have any names.
    """
    return joined(docs, n, threshold, recall, text, doc_id, count_all)[0]


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when of each class one does: the one with the least id (null ids last), then the least hash of its text.

    Of repeated rows any one stays. Null and empty texts are one class. An empty table gives no rows; ``docs`` may have columns
    of any names.
    """
    tags, tables = joined(docs, n, threshold, recall, text, doc_id, False)
    tags = cut(tags.select("doc_id", "t", "class_key"), "tags")
    free(*tables)
    first = tags.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("w")).select("w.doc_id", "w.t", F.lit(True).alias("stays"))
    # A row is told by its id and the hash of its text; several rows may be alike in both.
    rows = tags.groupBy("doc_id", "t").agg(F.count("*").alias("n")).alias("r")
    rows = rows.join(first.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.t") == F.col("f.t")), "left")
    rows = cut(rows.select("r.doc_id", "r.t", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "rows")
    free(tags)
    own_id, own_t = free_name("n_doc_id", docs.columns), free_name("n_t", docs.columns)
    as_ = lambda x: x.select(F.col("doc_id").alias(own_id), F.col("t").alias(own_t))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(text).eqNullSafe(F.col(own_t))
    out = docs.join(as_(rows.filter("not stays or n > 1")), same, "left_anti")
    again = rows.filter("stays and n > 1")
    if not again.isEmpty():
        alike_ = docs.join(as_(again), same, "left_semi").withColumn(own_t, F.xxhash64(text))
        out = out.unionByName(alike_.dropDuplicates([doc_id, own_t]).drop(own_t))
    return out
