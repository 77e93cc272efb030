"""What several operators share: words, held-out rows, sub-batches of texts."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.scratch import cut, free

#: A word is a run of characters other than these: space and U+0009 to U+000D. bytes.split() splits on the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: A term is a run of ASCII letters and digits and of all characters beyond ASCII; A-Z, and no others, lose their case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Maps the bytes of a text so that its terms are what white space separates.
TERM_BYTES = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))


def n_words(text: Column) -> Column:
    """Number of words as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: object, folds: int = 5) -> bool:
    """As :func:`fold`, for one Python value: whether its remainder is 0."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``most`` bytes of text, each with its texts as UTF-8 (null: empty). A text is never split."""
    values = batch.column(column)
    raw = values.cast(pa.large_binary())
    ends, start, held = [], 0, 0
    for i in range(len(raw)):
        held += len(raw[i].as_buffer()) if raw[i].is_valid else 0
        if held >= most:
            ends.append(i + 1)
            held = 0
    for end in [*ends, len(raw)]:
        if end > start:
            part = batch.slice(start, end - start)
            yield part, [x if x is not None else b"" for x in raw.slice(start, end - start).to_pylist()]
            start = end


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end at white space, so that no word is cut; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t"))
        if end <= at:
            end = min((e for c in (b" ", b"\n", b"\t") if (e := text.find(c, at + most)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one after the other, and the number of words of each text.

    Words are split a megabyte at a time, so that a very long text needs 8 bytes a word, not an object for each.
    """
    lengths: list[int] = []

    def lists() -> Iterator[list[bytes]]:
        for t in texts:
            n = 0
            for p in pieces(t):
                found = p.split()
                n += len(found)
                yield found
            lengths.append(n)

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists())), np.uint64)
    return hashes, np.array(lengths, np.int64)


def term_codes(texts: list[bytes], most: int = 64 << 20) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All terms of some texts as numbers, one text after the other; how many each text has; and the terms by their number.

    Texts are split a megabyte at a time, about ``most`` bytes in one Arrow array.
    """
    counts, flat, parts, owners, held = np.zeros(len(texts), np.int64), [], [], [], 0

    def split() -> None:
        terms = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).view(pa.string()))
        np.add.at(counts, owners, pc.list_value_length(terms).to_numpy())
        flat.append(terms.flatten())

    for i, text in enumerate(texts):
        for piece in pieces(text):
            if part := piece.translate(TERM_BYTES).strip():
                parts.append(part)
                owners.append(i)
                held += len(part)
            if held >= most:
                split()
                parts, owners, held = [], [], 0
    if parts:
        split()
    if not flat:
        return np.zeros(0, np.int32), counts, pa.array([], pa.string())
    coded = pa.chunked_array(flat).dictionary_encode()
    return np.concatenate([c.indices.to_numpy() for c in coded.chunks]), counts, coded.chunk(0).dictionary


def blocks(frame: DataFrame, size: Column, most: int, name: str) -> Iterator[pa.Table]:
    """The rows of a small frame in tables of about ``most`` bytes by the sum of ``size``, one after the other on the driver.

    Each gets a number of its own, ``place``, and goes by its hash to a block; a row that is larger than ``most`` stays whole.
    """
    rows = cut(frame.withColumn("place", F.monotonically_increasing_id()), name)
    n = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // most))
    for i in range(n):
        block = rows.filter(F.pmod(F.xxhash64("place"), F.lit(n)) == i).toArrow()
        if block.num_rows:
            yield block.sort_by("place").combine_chunks()
    free(rows)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores at its end as it takes to clash with none of the names ``taken`` (upper and lower case alike)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def free_prefix(prefix: str, taken: list[str]) -> str:
    """``prefix``, with as many underscores before it as it takes for none of the names ``taken`` to begin with it."""
    while any(t.lower().startswith(prefix) for t in taken):
        prefix = f"_{prefix}"
    return prefix


def must_be_free(names: list[str], taken: list[str], operator: str) -> None:
    """Raise if a column that an operator adds is there already: passing both on would make each ambiguous."""
    clash = sorted({n.lower() for n in names} & {t.lower() for t in taken})
    if clash:
        raise ValueError(f"{operator} adds the columns {', '.join(names)}; the input already has {', '.join(clash)}")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column | None = None, most_bytes: int = 200_000) -> DataFrame:
    """(doc_id, text, label) of up to ``per_class`` documents of each class 0 and 1, chosen by the hash of their id; learn: which rows of labels may be used.

    The bounds are on rows of each class and on the bytes of a text (longer ones don't train), so there are at most
    ``2 * per_class * most_bytes`` bytes; of repeated labels the greatest counts, of repeated documents the least text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known if learn is None else known.filter(learn)).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return rows


def fitted(sample: DataFrame, train: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """What ``train`` makes of (text, label) of the rows of :func:`labelled_sample`, in the order of their ids. One task trains on the
    bounded sample, so that its texts and the training need no memory of the driver, which gets the model alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        model = train([(t, y) for _, t, y in rows])
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train([])
