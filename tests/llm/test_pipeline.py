"""The five stages over a small table, each held against what its operator says of its own input."""

from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from marlstone.plans.scratch import cut  # noqa: E402
from marlstone.sources.tables import table  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = cut(stage(spark, before, DIR))
        if at < 4:
            assert after.columns == columns
        a, b = ({(r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()} if at < 4 else set() for x in (after, before))
        assert a <= b
        if at == 2:
            sets = {}
            for i, t in a:
                w = t.split()
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            ids = sorted(sets)
            assert not [(i, j) for i in ids for j in ids if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if at == 3:
            assert max(Counter(r["doc_id"] for r in after.select("doc_id").collect()).values()) <= 3
        if at == 4:
            bins = defaultdict(list)
            for r in after.collect():
                bins[r["bin"]].append(r)
            assert all(sum(r["tokens"] for r in x) <= x[0]["capacity"] for x in bins.values())
            words = sum(len(r["text"].split()) for r in before.select("text").collect())
            assert words == sum(r["tokens"] for x in bins.values() for r in x)
        before = after


def test_empty_table(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DIR))
        assert docs.count() == 0


def test_odd_rows_and_names(spark, docs):
    """Nulls in every column, empty and long texts, repeated rows and names that operators use inside go through every stage."""
    odd = docs.withColumnsRenamed({"lang": "q_kept", "n_chars": "t_predicted", "target": "m_copies", "tilt": "p_bin"})
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = cut(stage(spark, odd, DIR))
        if at < 4:
            assert after.columns == odd.columns
            assert after.select("doc_id", "text").exceptAll(odd.select("doc_id", "text") if at < 3 else odd.unionByName(odd).unionByName(odd).select("doc_id", "text")).count() == 0
        assert after.count() > 0
