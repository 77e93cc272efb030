"""The manifest, the ranked search and decontamination against plain Python over the fixture."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import decontamination, lexical, manifest
from marlstone.llm.fmindex import FMIndex, suffix_array
from marlstone.llm.words import TERM, term_codes

ITEMS = "item_id long, text string, row string, score double"


def terms(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def items_of(rows):
    """Items cut from documents, short ones, one that occurs nowhere, nulls, and a repeated row."""
    texts = {r[0]: r[1] for r in rows}
    long = texts[305].split()
    return [
        (1, " ".join(texts[3].split()[2:15]), None, None),
        (2, " ".join(texts[200].split()[40:55]).upper(), "x", 0.0),
        (3, "One", None, None),
        (4, "no ID here, at all", None, None),
        (5, " ".join(f"nowhere{i}" for i in range(30)), None, None),
        (6, " ".join(long[4000:4300]), None, None),
        (6, " ".join(long[4000:4300]), None, None),
        (None, "twice - the same row", None, None),
        (7, None, None, None),
        (8, " \n", None, None),
        (9, f"{texts[3].split()[20]} {texts[4].split()[1]} {texts[200].split()[3]} {texts[200].split()[3]}", None, None),
    ]


@pytest.fixture(scope="module")
def items(spark, rows):
    return spark.createDataFrame(items_of(rows), ITEMS)


def test_terms_of_texts():
    texts = ["Ab-c9 É x", "", " . ", "one\ntwo\tTWO", "ü" * 3]
    codes, counts, vocabulary = term_codes([t.encode() for t in texts])
    assert counts.tolist() == [len(terms(t)) for t in texts]
    assert [vocabulary[int(c)].as_py() for c in codes] == [w for t in texts for w in terms(t)]
    assert term_codes([b"", b" "])[1].tolist() == [0, 0]


# The FM-index


@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_fm_index(texts, phrases):
    x = np.array([w for t in texts for w in (*t, 0)], np.int32)
    ends = np.flatnonzero(x == 0)
    place = np.searchsorted(ends, np.arange(len(x)))
    suffix = lambda i: [*((1, int(w)) for w in x[i : ends[place[i]]]), (0, int(place[i]))]
    assert suffix_array(x).tolist() == sorted(range(len(x)), key=suffix)
    fm = FMIndex.load(FMIndex.build(x).dump())
    width = max(map(len, phrases))
    low, high = fm.search(np.array([p + [-1] * (width - len(p)) for p in phrases]), np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(len(x)) if x[i : i + len(p)].tolist() == p]


# Decontamination


def contaminated(rows, items, window):
    """Per document row: (id, terms, spans, items), by comparing each place with each window."""
    windows = defaultdict(set)
    for item, text, *_ in items:
        w = terms(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add("" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        w, hit, found = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(w), spans, sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block", "window"), [(8_000_000, 1 << 20, 10), (3_000, 200, 10), (500, 1 << 20, 4)])
def test_decontamination(spark, docs, rows, items, shard, block, window):
    index = decontamination.index(docs, reach=window, shard_bytes=shard)
    got = decontamination.find(index, items, window, block_bytes=block).collect()
    assert len({r["row"] for r in got}) == len(rows)
    assert sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], list(r["items"])) for r in got), key=repr) == contaminated(rows, items_of(rows), window)


def test_decontamination_without(spark, docs, rows, items):
    got = Counter((r["doc_id"], r["d_text"]) for r in decontamination.without(docs, items).collect())
    hit = {(d, n): (s, i) for d, n, s, i in contaminated(rows, items_of(rows), 10) if s}
    for doc, text, *_ in rows:
        w = terms(text)
        spans = hit.get((doc, len(w)), ([],))[0]
        want = [x for i, x in enumerate(w) if not any(a <= i < b for a, b in spans)]
        same = [t for (d, t) in got if d == doc and terms(t) == want]
        assert same and (spans or same == [text])
    with pytest.raises(ValueError, match="d_text"):
        decontamination.without(docs.withColumn("d_text", F.lit(1)), items)


def test_decontamination_nothing(nothing, docs, items):
    assert decontamination.spans(nothing, items).count() == 0
    got = decontamination.spans(docs, items.filter("false")).collect()
    assert len(got) == docs.count() and all(not r["spans"] and not r["items"] for r in got)


# Ranked search


def best(rows, items, k):
    corpus = [(doc, Counter(terms(text))) for doc, text, *_ in rows]
    n_docs, n_terms = sum(1 for _, c in corpus if c), sum(c.total() for _, c in corpus)
    df = Counter(t for _, c in corpus for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for doc, c in corpus:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block", "k"), [(8_000_000, 1 << 20, 50), (2_000, 200, 3), (2_000, 1 << 20, 1)])
def test_ranked_search(spark, docs, rows, items, shard, block, k):
    got = lexical.search(lexical.index(docs, shard_bytes=shard), items, k, block_bytes=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == best(rows, items_of(rows), k)


def test_ranked_search_random(spark):
    """Many shards and low k, so that heaps are full and most documents are passed over."""
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(vocabulary[min(199, int(draw.paretovariate(0.6)) - 1)] for _ in range(n))
    rows = [(i, text(draw.randint(1, 60))) for i in range(1500)]
    asked = [(i, text(12)) for i in range(25)]
    got = lexical.search(lexical.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=4_000), spark.createDataFrame(asked, "item_id long, text string"), 5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best(rows, asked, 5)


def test_ranked_search_nothing(nothing, docs, items):
    assert lexical.ranked(nothing, items).count() == 0
    assert lexical.ranked(docs, items.filter("false")).count() == 0


# Manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes):
    """Root of some digests, and for each its siblings (before, after) up to the root."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for leaf in groups[k]:
                    paths[leaf].append(("".join(nodes[i] for i in run if i < k), "".join(nodes[i] for i in run if i > k)))
        nodes, groups = [sha("".join(nodes[i] for i in run)) for run in runs], [[x for i in run for x in groups[i]] for run in runs]
    return nodes[0], paths


def expected_manifest(rows):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    parts = defaultdict(list)
    for doc, text, lang, source, n_chars, *_ in rows:
        parts[lang].append((doc is not None, doc or 0, sha("".join(map(value, (doc, source, lang, n_chars, text)))), doc))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    subroots, below = [], {}
    for p in names:
        parts[p].sort()
        root, below[p] = reduced([x[2] for x in parts[p]])
        subroots.append(root)
    root, above = reduced(subroots)
    return sorted(((d, leaf, sub, root, tuple(path) + tuple(top)) for p, sub, top in zip(names, subroots, above, strict=True) for (_, _, leaf, d), path in zip(parts[p], below[p], strict=True)), key=repr)


def leaf_of(text="text"):
    return manifest.digest(*(manifest.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", text)))


@pytest.mark.parametrize("langs", [1, 4, 11])
def test_manifest(spark, docs, rows, langs):
    extra = [(1000 + i, f"text {i}", f"l{i % langs}", None, i, None, None) for i in range(120)] + [(5000, "alone", "zz", "s", 1, None, None)]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = manifest.manifest(frame, leaf_of(), keep={"doc_id": F.col("doc_id")}).withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got), key=repr) == expected_manifest([*rows, *extra])
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_edges(spark, docs, nothing):
    assert manifest.manifest(nothing, leaf_of()).count() == 0
    one = manifest.manifest(docs.filter("doc_id = 5"), leaf_of(), keep={"doc_id": F.col("doc_id")}).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []
    with pytest.raises(ValueError, match="leaf"):
        manifest.manifest(docs, leaf_of(), keep={"leaf": F.lit(1)})


def test_manifest_hot_part(spark):
    """Rows that are all alike, beside others, are spread over the runs and change nothing."""
    rows = [(7, "same", "en", "s", 4, None, None)] * 300 + [(i, f"t{i}", "en", "s", 2, None, None) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a string, b string").repartition(5)
    got = manifest.manifest(frame, leaf_of(), keep={"doc_id": F.col("doc_id")}).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got), key=repr) == expected_manifest(rows)
