"""Language identification with bit-sliced Bloom filters of byte n-grams.

Slot i of the filters holds a bitmask: bit l is bit i of the filter of language l. The AND of an n-gram's slots therefore
gives at once all languages whose filter holds it. A text's hits for each language, less the hits that the filter's false
positives would give, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.words import chunks, fold, must_be_free, pieces

#: Bytes of a gram, slots of the filters (a power of 2), slots that a gram sets, grams learnt for each language.
GRAM, SLOTS, HASHES, GRAMS = 4, 1 << 18, 3, 6000
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes outside letters (ASCII) become a space; runs of it count as they stand.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


@dataclass(frozen=True)
class Filters:
    """Languages in order; masks of shape (slots, words of 64 languages); false positive rate of each language."""

    langs: tuple[str, ...]
    masks: np.ndarray
    false: np.ndarray


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the joined texts as numbers, and the text of each. Grams don't cross texts; those of spaces alone are left out."""
    clean = [b" " + t.decode(errors="replace").lower().encode().translate(LETTERS) + b" " for t in texts]
    raw = np.frombuffer(b"".join(clean), np.uint8)
    if len(raw) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = np.zeros(len(raw) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | raw[i : len(raw) - GRAM + 1 + i]
    sizes = np.array([len(t) for t in clean])
    text = np.repeat(np.arange(len(texts)), sizes)[: len(code)]
    last = np.repeat(np.cumsum(sizes), sizes)[: len(code)]
    use = (np.arange(len(code)) + GRAM <= last) & (code != 0x20202020)
    return code[use], text[use]


def slots_of(code: np.ndarray, i: int) -> np.ndarray:
    wide = (code.astype(np.uint64) + np.uint64(1)) * MIXERS[i]
    return (wide >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def build(langs: list[str], grams: dict[str, np.ndarray]) -> Filters:
    masks = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
    for at, lang in enumerate(langs):
        for i in range(HASHES):
            slot = np.unique(slots_of(grams.get(lang, np.zeros(0, np.uint32)), i))
            masks[slot, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    full = [((masks[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)).mean() for at in range(len(langs))]
    return Filters(tuple(langs), masks, np.array(full) ** HASHES)


def train(docs: DataFrame, per_lang: int = 2000, lang: str = "lang") -> Filters:
    """Learn from rows with a language that aren't held out (crc32 of the id modulo 5 is 0).

    The languages come from all those rows; the grams from about ``per_lang`` texts of each, chosen by the hash of id and
    text, so the bound hardly varies with the input. Grams are counted on the executors; the GRAMS commonest of each
    language come to the driver.
    """
    known = docs.filter(F.col(lang).isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id"), F.col("text"), F.col(lang).cast("string").alias("lang"))
    found = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(found)
    if not langs:
        return build([], {})
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, per_lang / found[l]))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, texts in chunks(batch):
                names = np.array(part.column("lang").to_pylist(), object)
                code, text = gram_codes(texts)
                for l in set(names):
                    own, n = np.unique(code[names[text] == l], return_counts=True)
                    if l in total:
                        both, back = np.unique(np.concatenate([total[l][0], own]), return_inverse=True)
                        own, n = both, np.bincount(back, np.concatenate([total[l][1], n])).astype(np.int64)
                    total[l] = (own, n)
        for l, (own, n) in total.items():
            for at in range(0, len(own), 50_000):
                yield pa.record_batch({"lang": pa.array([l] * len(own[at : at + 50_000])), "gram": pa.array(own[at : at + 50_000].astype(np.int64)), "n": pa.array(n[at : at + 50_000])})

    sums = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sums.withColumn("rank", rank).filter(F.col("rank") <= GRAMS).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return build(langs, {r["lang"]: np.array(r["grams"], np.uint32) for r in rows})


def hits(texts: list[bytes], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its number of grams, and for each language the hits corrected for false positives."""
    code, text = gram_codes(texts)
    n = np.bincount(text, minlength=len(texts)).astype(np.float64)
    found = np.zeros((len(texts), len(filters.langs)))
    if len(code) and filters.langs:
        slots = [slots_of(code, i) for i in range(HASHES)]
        starts = np.flatnonzero(np.r_[True, np.diff(text) > 0])
        for word in range(filters.masks.shape[1]):
            column = filters.masks[:, word]
            held = column[slots[0]] & column[slots[1]] & column[slots[2]]
            for bit in range(min(64, len(filters.langs) - 64 * word)):
                one = ((held >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
                found[text[starts], 64 * word + bit] = np.add.reduceat(one, starts)
    return n, np.maximum((found - n[:, None] * filters.false) / np.maximum(1 - filters.false, 1e-9), 0)


def summed(texts: list[bytes], filters: Filters) -> np.ndarray:
    """The corrected hits of :func:`hits`, of texts that are read a megabyte at a time."""
    cuts = [list(pieces(t)) for t in texts]
    if all(len(c) == 1 for c in cuts):
        return hits(texts, filters)[1]
    return np.stack([sum(hits([p], filters)[1][0] for p in c) for c in cuts])


def predict(docs: DataFrame, filters: Filters, text: str = "text", prefix: str = "l_") -> DataFrame:
    """Add ``prefix``pred and ``prefix``score from every n-gram of each whole text.

    pred is the language with most corrected hits (ties: the first in code points); ``und`` if the text is null or has no
    letter, or no language was learnt. score is that language's share of the corrected hits of all, 0 for ``und``; a text
    with letters but without hits gets the first language and score 0. Other columns may be null and are passed on; if one has
    a name that is added, a ValueError says so, and another prefix helps. Repeated rows are judged alike, an empty table gives
    no rows, and very long texts are read a megabyte at a time.
    """
    added = [f"{prefix}pred", f"{prefix}score"]
    must_be_free(added, docs.columns, "language.predict")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text, 1_000_000):
                found = summed(texts, filters)
                lettered = [any(map(str.isalpha, t.decode(errors="replace"))) for t in texts]
                if filters.langs:
                    best = found.argmax(axis=1)
                    score = found[np.arange(len(best)), best] / np.maximum(found.sum(axis=1), 1e-9)
                    names = [filters.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                else:
                    score, names = np.zeros(len(texts)), ["und"] * len(texts)
                score = np.where([x != "und" for x in names], score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, *added])

    schema = docs.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1])).schema
    return docs.mapInArrow(task, schema)
