"""Quality rules: counts over words and lines, and a linear-chain conditional random field that marks boilerplate lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import chunks, fitted, labelled_sample, must_be_free, pieces

SPACE, LATER, SYMBOL, UPPER, LETTER, DIGIT, BANG, BAR = (1 << i for i in range(8))
KIND = np.zeros(256, np.uint8)
for chars, flag in (
    (b" \t\n\r\x0b\x0c", SPACE),
    (bytes(range(0x80, 0xC0)), LATER),
    (b"#*$%&|<>", SYMBOL),
    (bytes(range(65, 91)), UPPER),
    (bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]), LETTER),
    (b"0123456789", DIGIT),
    (b"!?", BANG),
    (b"|", BAR),
):
    KIND[list(chars)] |= flag

#: What is known of a line, each from 0 to 1.
FEATURES = ("bias", "no word", "under 3 words", "symbols", "many symbols", "capitals", "digits", "bars", "exclamations", "repeats a line", "repeats its words", "long words", "ends a sentence")
#: Weights for boilerplate, before training and as the centre of the penalty: without labels these decide.
PRIOR = np.array([-1.5, 0.0, 0.3, 1.0, 2.0, 1.5, 0.5, 1.5, 1.0, 1.0, 2.0, 0.5, -0.5])


@dataclass(frozen=True)
class Field:
    """Weights of boilerplate against content, and the scores of the four transitions (0 content, 1 boilerplate)."""

    weights: np.ndarray
    moves: np.ndarray


START = Field(PRIOR, np.array([[0.7, -0.7], [-0.7, 0.7]]))


@dataclass(frozen=True)
class Measured:
    """Counts of each text, and of each line its text, words and features. Lines of a text are adjacent."""

    counts: dict[str, np.ndarray]
    line_text: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def ids_of(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def repeated_words(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text in windows of three words that the text has twice or more; words by number, text of each word."""
    if len(words) < 3:
        return np.zeros(texts, np.int64)
    whole = np.flatnonzero(text[:-2] == text[2:])
    n = np.int64(len(words) + 1)
    pairs = ids_of(words[whole] * n + words[whole + 1])
    triples = ids_of(pairs * n + words[whole + 2])
    _, which, times = np.unique(triples * np.int64(texts) + text[whole], return_inverse=True, return_counts=True)
    again = whole[times[which] > 1]
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[again + i] = True
    return np.bincount(text[hit], minlength=texts)


def measure(texts: list[bytes]) -> Measured:
    """All counts and features of some texts, in passes over their joined bytes."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    kind = KIND[raw]
    sizes = np.array([len(t) for t in texts])
    text_start = np.cumsum(sizes + 1) - sizes - 1
    breaks = np.flatnonzero(raw == 10)
    line_start, line_end = np.r_[0, breaks + 1], np.r_[breaks, len(raw)]
    line_text = np.searchsorted(text_start, line_start, "right") - 1

    # One kind at a time, so that a very long text needs few bytes for each of its own.
    def by_line(of: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(of, False), line_start, dtype=np.int64)

    def has(flag: int) -> np.ndarray:
        return (kind & flag) > 0

    black = ~has(SPACE)
    first = black.copy()
    first[1:] &= ~black[:-1]
    whole = {"words": by_line(first)}
    del first
    whole["chars"] = by_line(black & ~has(LATER))
    del black
    for name, flag in (("symbols", SYMBOL), ("upper", UPPER), ("letters", LETTER), ("digits", DIGIT), ("bangs", BANG), ("bars", BAR)):
        whole[name] = by_line(has(flag))
    per_text = {k: np.bincount(line_text, v, len(texts)).astype(np.int64) for k, v in whole.items()}
    line = {k: v.astype(np.float64) for k, v in whole.items()}

    seen: dict[bytes, int] = {}
    numbers = count()
    words = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(seen.setdefault, p.split(), numbers), np.int64) for p in pieces(joined))])
    del seen
    word_text = np.repeat(np.arange(len(texts)), per_text["words"])
    word_line = np.repeat(np.arange(len(line_start)), line["words"].astype(np.int64))
    same = np.flatnonzero((words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1]))
    twice = np.bincount(word_line[same], minlength=len(line_start))

    duplicate = np.zeros(len(line_start), bool)
    at = 0
    for t in texts:
        before: set[bytes] = set()
        parts = t.split(b"\n")
        for i, part in enumerate(parts, at):
            if part in before:
                duplicate[i] = True
            elif part.strip():
                before.add(part)
        at += len(parts)
    w, letters = np.maximum(line["words"], 1), np.maximum(line["letters"], 1)
    ends = np.zeros(len(line_start))
    some = line_end > line_start
    ends[some] = np.isin(raw[line_end[some] - 1], np.frombuffer(b".!?:;", np.uint8))
    columns = [
        np.ones(len(w)),
        line["words"] == 0,
        (line["words"] > 0) & (line["words"] < 3),
        np.minimum(line["symbols"] / w, 1),
        line["symbols"] > 0.5 * w,
        (line["upper"] > 0.6 * letters) & (line["letters"] > 3),
        line["digits"] > 0.3 * np.maximum(line["chars"], 1),
        np.minimum(2 * line["bars"] / w, 1),
        np.minimum(line["bangs"] / w, 1),
        duplicate,
        np.minimum(2 * twice / w, 1),
        line["chars"] > 14 * w,
        ends,
    ]
    counts = {
        "n_words": per_text["words"],
        "word_chars": per_text["chars"],
        "n_symbols": per_text["symbols"],
        "n_dup_lines": np.bincount(line_text[duplicate], minlength=len(texts)),
        "n_repeat_words": repeated_words(words, word_text, len(texts)),
    }
    return Measured(counts, line_text, line["words"].astype(np.int64), np.stack([np.asarray(c, np.float64) for c in columns], 1))


def viterbi(scores: list[float], moves: list[list[float]]) -> list[int]:
    """The best sequence of labels; scores: of boilerplate against content for each line. Ties go to content."""
    (cc, cb), (bc, bb) = moves
    content, junk, back = 0.0, scores[0], []
    for s in scores[1:]:
        from_c = content + cc >= junk + bc
        to_c = content + cb >= junk + bb
        back.append((0 if from_c else 1, 0 if to_c else 1))
        content, junk = (content + cc if from_c else junk + bc), (content + cb if to_c else junk + bb) + s
    at = 0 if content >= junk else 1
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def content_share(m: Measured, field: Field) -> np.ndarray:
    """Share of each text's words that lie in lines marked as content; 0 for a text without words."""
    scores, moves = (m.features @ field.weights).tolist(), field.moves.tolist()
    edges = np.searchsorted(m.line_text, np.arange(len(m.counts["n_words"]) + 1))
    content = np.zeros(len(edges) - 1, np.int64)
    words = m.line_words.tolist()
    for i in range(len(content)):
        a, b = edges[i], edges[i + 1]
        if b - a == 1:
            content[i] = words[a] if scores[a] <= 0 else 0
        else:
            content[i] = sum(w for w, label in zip(words[a:b], viterbi(scores[a:b], moves), strict=True) if not label)
    return content / np.maximum(m.counts["n_words"], 1)


def expectations(x: np.ndarray, mask: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences (n, steps, features): the probability of boilerplate of each line and the expected transitions."""
    n, steps, _ = x.shape
    score = np.zeros((n, steps, 2))
    score[:, :, 1] = x @ field.weights
    alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        new = np.logaddexp(alpha[:, t - 1, :1] + field.moves[0], alpha[:, t - 1, 1:] + field.moves[1]) + score[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = beta[:, t + 1] + score[:, t + 1]
        new = np.logaddexp(ahead[:, :1] + field.moves[:, 0], ahead[:, 1:] + field.moves[:, 1])
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
    norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - norm[:, None]), 0)
    moves = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pair = alpha[:, :-1, a] + field.moves[a, b] + score[:, 1:, b] + beta[:, 1:, b] - norm[:, None]
            moves[a, b] = np.exp(pair)[mask[:, 1:]].sum()
    return p, moves


def train(sample: list[tuple[str, int]], rounds: int = 3, steps: int = 80, penalty: float = 0.01, length: int = 64) -> Field:
    """Fit the field to texts labelled 1 (content) and 0 (holding boilerplate), by ascent on the penalised likelihood.

    Lines of good texts are content. Lines of bad texts begin as boilerplate; after each round those that the field takes for
    content are relabelled, as a bad text has good lines too. Texts are cut into sequences of ``length`` lines for this. The
    penalty pulls towards PRIOR, which is what few or no labels give.
    """
    field = START
    parts = [(m, good) for text, good in sample if (m := measure([text.encode(errors="replace")])).line_words.sum()]
    if len({good for _, good in parts}) < 2:
        return field
    x, y, good = [], [], []
    for m, g in parts:
        for at in range(0, len(m.line_words), length):
            x.append(m.features[at : at + length])
            y.append(np.full(len(x[-1]), 0 if g else 1))
            good.append(g)
    most = max(map(len, x))
    X, mask = np.zeros((len(x), most, len(FEATURES))), np.zeros((len(x), most), bool)
    for i, own in enumerate(x):
        X[i, : len(own)], mask[i, : len(own)] = own, True
    total = mask.sum()
    for _ in range(rounds):
        Y = np.zeros(mask.shape)
        for i, own in enumerate(y):
            Y[i, : len(own)] = own
        seen = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                seen[a, b] = ((Y[:, :-1] == a) & (Y[:, 1:] == b))[mask[:, 1:]].sum()
        w, moves, first, second = field.weights.copy(), field.moves.copy(), np.zeros(len(PRIOR) + 4), np.zeros(len(PRIOR) + 4)
        for k in range(1, steps + 1):
            p, expected = expectations(X, mask, Field(w, moves))
            up = np.r_[np.einsum("nt,ntf->f", np.where(mask, Y - p, 0), X) / total - penalty * (w - PRIOR), ((seen - expected) / total - penalty * (moves - START.moves)).ravel()]
            first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up * up
            step = 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
            w, moves = w + step[: len(w)], moves + step[len(w) :].reshape(2, 2)
        field = Field(w, moves)
        for i, g in enumerate(good):
            if not g:
                y[i] = np.array(viterbi((x[i] @ w).tolist(), moves.tolist()))
    return field


def learned(sample: list[tuple[str, int]]) -> Field | None:
    """As :func:`train`; None where it learns nothing."""
    field = train(sample)
    return None if field is START else field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Field:
    """Train on at most ``per_class`` documents of each value of ``labels.quality``; everything else covers all rows."""
    return fitted(labelled_sample(docs, labels, "quality", per_class), learned) or START


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, field: Field, text: str = "text", share: float = 0.5, fewest: int = 50, most_repeated: int = 50, prefix: str = "q_") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed and kept, each with ``prefix``.

    base_failed: under ``fewest`` words, or over ``most_repeated`` percent of them in repeated windows of three. Kept are
    the others whose content share is at least ``share``. Null and empty texts have no words and fail; any other column may
    be null, and all columns of ``docs`` are passed on; if one has a name that is added, a ValueError says so, and another
    prefix helps. Repeated rows are judged alike, of equally good sequences of labels the one with more content at the end is
    taken, and an empty table gives no rows. A very long text is taken whole, at about 30 bytes for each of its own.
    """
    added = [f"{prefix}{k}" for k in (*COUNTS, "content_share", "base_failed", "kept")]
    must_be_free(added, docs.columns, "quality.judge")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text, 1_000_000):
                m = measure(texts)
                found = content_share(m, field)
                c = m.counts
                failed = (c["n_words"] < fewest) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
                new = [*(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(found), pa.array(failed), pa.array(~failed & (found >= share))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])

    kinds = [F.lit(0).cast("long")] * len(COUNTS) + [F.lit(0.0), F.lit(True), F.lit(True)]
    schema = docs.select("*", *[k.alias(n) for k, n in zip(kinds, added, strict=True)]).schema
    return docs.mapInArrow(task, schema)
