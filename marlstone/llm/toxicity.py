"""Toxicity by compression distance: windows compress shorter with a dictionary of toxic text than without it.

Two zstandard dictionaries are trained apart by the library's trainer: one on the windows of ordinary texts, and one on toxic
texts, of which it is given the stretches that ordinary text doesn't explain (those of grams that are far commoner in toxic
texts). A window of words is compressed twice, with the ordinary dictionary, and with the toxic one put before it; the margin
is the difference of the lengths. As both compressors share the ordinary part, ordinary text has a margin near 0 in any
language that the sample holds. Windows over two thresholds, the largest and the summed margin give the score by a logistic
curve. The curve and the threshold of the score are calibrated on labelled texts that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import chunks, fitted, fold, labelled_sample, must_be_free, pieces

#: Words of a window; bytes of the grams; bytes of the ordinary dictionary; margins at which a window counts.
WINDOW, GRAMS, ORDINARY_BYTES, STRONG = 10, (6, 7, 8, 9, 10), 65536, (3, 6)
#: A gram is toxic if it is in so many toxic texts at least, and in this share of them, and so many times as common there as elsewhere.
LEAST, SHARE, CONTRAST = 4, 0.02, 15.0
#: Segment and gram of the library's trainer, for either dictionary.
ORDINARY_SEGMENT, TOXIC_SEGMENT = (64, 8), (32, 6)
#: Share of the sample that trains the dictionaries; share of the other ordinary texts that the threshold may flag.
KNOWN, FLAGGED = 0.75, 0.015
#: Windows that are compressed at once.
WINDOWS = 50_000


@dataclass(frozen=True)
class Model:
    """Contents of the dictionaries and the logistic weights of :meth:`Scorer.features`."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.decode(errors="replace").lower().encode().split()


def windows(words: list[bytes]) -> list[bytes]:
    """All words, WINDOW at a time; a text without words is one empty window."""
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b" "]


class Chunk:
    """Some texts of one class, and for each byte its text, the next space after it, and its word (of a space: the word behind it)."""

    def __init__(self, texts: list[list[bytes]], first: int) -> None:
        parts = [b" " + b" ".join(w) + b" " for w in texts]
        self.joined = b"".join(parts)
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.text = np.repeat(np.arange(first, first + len(parts), dtype=np.int32), [len(p) for p in parts])
        spaces = np.flatnonzero(self.raw == 32).astype(np.int32)
        self.word = np.searchsorted(spaces, np.arange(len(self.raw), dtype=np.int32), "right").astype(np.int32)
        self.next_space = np.append(spaces, np.int32(len(self.raw)))[self.word]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``size`` bytes that lie in a word and the spaces around it."""
        last = len(self.raw) - size + 1
        at = np.flatnonzero(self.next_space[: max(last, 0)] >= np.arange(max(last, 0), dtype=np.int32) + (size - 1))
        code = np.zeros(len(at), np.uint64)
        for i in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + self.raw[at + i] + np.uint64(1)
        return at, code


def chunked(texts: list[list[bytes]], most: int = 1_000_000) -> list[Chunk]:
    """Chunks of about ``most`` bytes; a text is in one chunk."""
    out, held, size, first = [], [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += sum(map(len, t)) + len(t)
        if size >= most or i + 1 == len(texts):
            out.append(Chunk(held, first))
            held, size, first = [], 0, i + 1
    return out


def distinct(text: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The names of the distinct pairs."""
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    return name[new]


def stretches(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[list[bytes]]:
    """For each toxic text: of each word with toxic grams, what lies from the first to the end of the last.

    Texts are gone through a megabyte at a time; what is held are the grams of one size in the toxic texts.
    """
    ours, others = chunked(toxic), chunked(ordinary)
    least = max(LEAST, SHARE * len(toxic))
    start = [np.full(c.word[-1] + 1, len(c.raw)) for c in ours]
    end = [np.zeros(c.word[-1] + 1, np.int64) for c in ours]
    for size in GRAMS:
        found = [(at, code, distinct(c.text[at], code)) for c in ours for at, code in [c.windows(size)]]
        names, times = np.unique(np.concatenate([d for _, _, d in found]), return_counts=True)
        names, times = names[times >= least], times[times >= least]
        if not len(names):
            continue
        theirs = np.zeros(len(names), np.int64)
        for c in others:
            at, code = c.windows(size)
            place = np.minimum(np.searchsorted(names, code), len(names) - 1)
            known = names[place] == code
            theirs += np.bincount(distinct(c.text[at[known]], place[known]), minlength=len(names))
        # A count of few texts may be chance: it is taken less its standard deviation.
        marked = names[(times - times**0.5) / len(toxic) >= CONTRAST * (theirs + 0.5) / len(ordinary)]
        for c, s, e, (at, code, _) in zip(ours, start, end, found, strict=True):
            hit = at[np.isin(code, marked)]
            np.minimum.at(s, c.word[hit], hit)
            np.maximum.at(e, c.word[hit], hit + size)
    out: list[list[bytes]] = [[] for _ in toxic]
    for c, s, e in zip(ours, start, end, strict=True):
        for w in np.flatnonzero(e).tolist():
            out[c.text[s[w]]].append(c.joined[s[w] : e[w]])
    return out


def trained(samples: list[bytes], size: int, segment: tuple[int, int]) -> bytes:
    """A dictionary by the library's trainer; of samples that are too few to train on, their own bytes, the commonest last."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment[0], d=segment[1], f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s for s, _ in sorted(Counter(samples).items(), key=lambda x: (x[1], x[0])))[-size:]


def dictionaries(texts: list[list[bytes]], toxic: list[bool]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary; the toxic one has room for all its stretches twice."""
    own_of = stretches(*([t for t, y in zip(texts, toxic, strict=True) if y == own] for own in (True, False)))
    found = [b"".join(own) for own in own_of if own]
    size = sum(map(len, {s for own in own_of for s in own}))
    ordinary = trained([w for t, y in zip(texts, toxic, strict=True) if not y for w in windows(t)], ORDINARY_BYTES, ORDINARY_SEGMENT)
    return ordinary, trained(found, max(256, 2 * size), TOXIC_SEGMENT) if found else b""


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    # Large tables keep every position of the dictionary; matches under 5 bytes would be chance.
    log = max(17, len(content).bit_length() + 1)  # all of the dictionary stays in reach
    how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=6, min_match=5, target_length=8, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    if not content:
        return zstandard.ZstdCompressor(compression_params=how)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Scorer:
    """Compressors of a model; one for each task."""

    def __init__(self, model: Model) -> None:
        self.model, self.pair = model, (compressor(model.ordinary), compressor(model.toxic + model.ordinary))

    def margins(self, found: list[bytes]) -> np.ndarray:
        plain, both = (np.array([len(x) for x in c.multi_compress_to_buffer(found, threads=1)], float) for c in self.pair)
        return plain - both

    def features(self, texts: list[bytes]) -> np.ndarray:
        """1, log of the windows, largest margin, log of the summed margins over 1, logs of the windows over each threshold, mean margin.

        Texts are read a megabyte at a time, where windows begin anew.
        """
        n, total, over, top = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        strong = np.zeros((len(STRONG), len(texts)))
        held: list[bytes] = []
        of: list[int] = []

        def flush() -> None:
            m, at = self.margins(held), np.array(of)
            np.add.at(n, at, 1)
            np.add.at(total, at, m)
            np.add.at(over, at, np.maximum(m - 1, 0))
            np.maximum.at(top, at, m)
            for own, least in zip(strong, STRONG, strict=True):
                np.add.at(own, at, m >= least)
            held.clear()
            of.clear()

        for i, t in enumerate(texts):
            for p in pieces(t):
                own = windows(words_of(p))
                held += own
                of += [i] * len(own)
                if len(held) >= WINDOWS:
                    flush()
        if held:
            flush()
        return np.stack([np.ones(len(texts)), np.log(n), np.clip(top, -20, 20) / 5, np.log1p(over), *np.log1p(strong), np.clip(total / n, -3, 3)], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.features(texts) @ np.array(self.model.weights))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 60) -> np.ndarray:
    """Logistic regression with a ridge, classes alike in weight; the threshold is moved to where FLAGGED of the ordinary texts lie above."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = logistic(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1, 2 / max(1e-9, np.abs(step).max()))
    w[0] -= np.quantile(x[y == 0] @ w, 1 - FLAGGED) + 1e-6
    return w


def train(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries from KNOWN of the texts of each class, the curve from the others; without texts of both classes all score near 0."""
    sample = list(dict.fromkeys(sample))  # copies would make any word of theirs look common
    by = {own: [t.encode(errors="replace") for t, y in sample if y == own] for own in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", (-30.0, *[0.0] * (4 + len(STRONG))))
    ends = {own: max(1, int(len(ts) * KNOWN)) for own, ts in by.items()}
    known = [(words_of(t), bool(own)) for own, ts in by.items() for t in ts[: ends[own]]]
    rest = [(t, own) for own, ts in by.items() for t in (ts[ends[own] :] or ts)]
    pair = dictionaries([w for w, _ in known], [y for _, y in known])
    x = Scorer(Model(*pair, ())).features([t for t, _ in rest])
    return Model(*pair, tuple(map(float, calibrate(x, np.array([y for _, y in rest])))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Train on at most ``per_class`` documents of each value of ``labels.toxic``, none of them held out (crc32 of the id modulo 5 is 0)."""
    return fitted(labelled_sample(docs, labels, "toxic", per_class, learn=fold(F.col("doc_id")) != 0), train)


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "t_") -> DataFrame:
    """Add ``prefix``score (0 to 1) and ``prefix``predicted (1 if at least 0.5) from every window of each whole text.

    Null and empty texts have one empty window, and so a low score. All columns are passed on and no other is looked at, so any
    may be null; if one has a name that is added, a ValueError says so, and another prefix helps. A score depends on the
    text alone: repeated rows score alike, there are no ties to break, and an empty table gives no rows. Very long texts are
    read a megabyte at a time.
    """
    names = [f"{prefix}score", f"{prefix}predicted"]
    must_be_free(names, docs.columns, "toxicity.score")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in chunks(batch, text, 1_000_000):
                found = scorer.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*part.schema.names, *names])

    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1])).schema
    return docs.mapInArrow(task, schema)
