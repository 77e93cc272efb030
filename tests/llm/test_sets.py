"""Operators that count, deal out and join, against brute force over the fixture."""

import zlib
from collections import Counter, defaultdict

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import mixing, neardup, packing, queries, sharding, topk, urls


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n)]


def tokens(text):
    return (text or "").encode().split()


# Packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_item_once(histogram):
    s = packing.plan(histogram, (16, 32, 64))
    bins = defaultdict(list)
    for length, n in histogram.items():
        at = np.flatnonzero(s.length == length)
        starts = [*s.rank[at], n]
        for i, a in enumerate(at):
            for k in range(starts[i + 1] - starts[i]):
                bins[int(s.bin[a] + k)].append((int(s.offset[a]), length))
    assert sum(len(b) for b in bins.values()) == sum(histogram.values())
    for b, items in bins.items():
        items.sort()
        assert [o for o, _ in items] == [sum(x for _, x in items[:i]) for i in range(len(items))]
        used = sum(x for _, x in items)
        capacity = s.class_capacity[np.searchsorted(s.class_bin, b, "right") - 1]
        assert capacity == min(c for c in (16, 32, 64) if c >= used)


def test_pack(docs, rows):
    got = packing.pack(docs, capacities=(64, 256, 1024)).collect()
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["p_tokens"]
    want = Counter()
    for r in rows:
        want[r[0]] += len(tokens(r[1]))
    assert held == want
    bins = defaultdict(list)
    for r in got:
        if r["p_tokens"]:
            bins[r["p_bin"]].append((r["p_offset"], r["p_tokens"], r["p_capacity"]))
        else:
            assert r["p_bin"] is None
    for items in bins.values():
        items.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(items, items[1:])) and items[0][0] == 0 and items[-1][0] + items[-1][1] <= items[0][2]
    assert sum(want.values()) / sum(i[0][2] for i in bins.values()) > 0.9


def test_pack_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# Mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(docs, rows):
    got = mixing.mix(docs, keep=("doc_id", "source")).collect()
    again = mixing.mix(docs, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    want, taken, largest = expected_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["m_source_size"] == sizes[r["source"]] and 0 <= r["m_copies"] <= 3
        assert r["m_target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["m_size"] * r["m_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["m_size"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.05 * target + largest[s] / 2
    key = lambda rows_: sorted((str(r["doc_id"]), r["m_copies"]) for r in rows_)
    assert key(got) == key(again)


def test_rates_solve_the_dual(docs):
    rows_ = mixing.mix(docs, keep=("source",)).filter("m_size > 0").collect()
    by = defaultdict(float)
    target = {}
    for r in rows_:
        by[r["source"]] += r["m_rate"] * r["m_size"]
        target[r["source"]] = r["m_target"]
    assert all(by[s] == pytest.approx(target[s], rel=1e-3) for s in by)


def test_mixed_rows_and_nothing(docs, nothing):
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(nothing).count() == 0


# Shards


def test_shard(docs, rows):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 4) <= largest
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_split_a_large_group_only(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.shard(same, shards=8).groupBy("shard").count().collect()
    assert len(got) == 8 and all(124 <= r["count"] <= 126 for r in got)


def test_shard_nothing(nothing):
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("piece_rows", [200_000, 40])
def test_groups_stay_whole(spark, monkeypatch, piece_rows):
    """Many groups of copies: against a plain sort, boundaries lie at the nearest edge of a group within the slack."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", piece_rows)
    draw = random.Random(2)
    rows, i = [], 0
    for group in range(400):
        text = " ".join(words(draw.randint(1, 30), group))
        for _ in range(draw.choice((1, 1, 1, 2, 5))):
            rows.append((i, text))
            i += 1
    rows += [(i + k, "a large group of copies " * 4) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    got = sharding.shard(docs, shards=8, keep=("h",)).collect()
    order = sorted(got, key=lambda r: (r["h"], r["doc_id"]))
    assert [(r["shard"], r["slot"]) for r in order] == sorted((r["shard"], r["slot"]) for r in got)
    total = sum(r["size"] for r in got)
    below, at, edges = {}, 0, [0]
    for r, after in zip(order, [*order[1:], None], strict=True):
        at += r["size"]
        below[r["shard"]] = at
        if after is None or after["h"] != r["h"]:
            edges.append(at)
    for shard in range(7):
        goal, end = total * (shard + 1) // 8, below[shard]
        nearest = min(abs(e - goal) for e in edges)
        if nearest <= int(0.05 * total / 8):
            assert end in edges and abs(end - goal) <= max(nearest, 0.002 * total / 8)
        else:
            assert abs(end - goal) <= max(r["size"] for r in got)
    where = defaultdict(set)
    for r in got:
        where[r["h"]].add(r["shard"])
    sizes = Counter()
    for r in got:
        sizes[r["h"]] += r["size"]
    assert all(len(s) == 1 for h, s in where.items() if sizes[h] <= 0.1 * total / 8)


@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_slots(keys, rows_):
    keys = sorted(set(keys))
    h, d = (np.array(x, np.int64) for x in zip(*rows_, strict=True))
    assert sharding.slots_below(h, d, keys).tolist() == [sum(k <= r for k in keys) for r in rows_]


# Jaccard join


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """Of rows (id, text): classes by their least id, links of each row, and the sets."""
    sets = [shingles(r[1]) for r in rows]
    alike = lambda a, b: (not a and not b) or (a and b and len(a & b) >= threshold * len(a | b))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            known = least[top(i)]
            least[top(i)] = r[0] if known is None else min(known, r[0])
    return [least[top(i)] for i in range(len(rows))], links, sets


def test_join(docs, rows):
    classes, links, _ = brute(rows)
    got = neardup.join(docs, count_all=True).collect()
    want = Counter((r[0], classes[i], links[i]) for i, r in enumerate(rows))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    stay = neardup.one_of_each(docs)
    assert stay.columns == docs.columns
    kept = Counter(r["doc_id"] for r in stay.collect())
    assert kept == Counter({c for c in classes if c is not None} | {None})


def check_listed(got, rows):
    """Classes are those of the brute force; listed links are true, exact, and hold every class together."""
    classes, links, sets = brute(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((r[0], c) for r, c in zip(rows, classes, strict=True))
    of = {r[0]: s for r, s in zip(rows, sets, strict=True)}
    for r in got:
        if r["link_id"] is not None and r["doc_id"] is not None:
            a, b = of[r["doc_id"]], of[r["link_id"]]
            assert r["similarity"] == pytest.approx(len(a & b) / len(a | b)) and r["similarity"] >= 0.8 and a != b
    most = {r[0]: links[i] for i, r in enumerate(rows)}
    assert all(r["n_links"] <= most[r["doc_id"]] and (r["n_links"] > 0) == (most[r["doc_id"]] > 0) for r in got if r["doc_id"] is not None)
    return most


def test_listed_links(docs, rows):
    alone = [r for r in rows if r[0] != 304]
    check_listed(neardup.join(docs.filter("doc_id is null or doc_id <> 304")).collect(), alone)


def test_links_of_a_table(spark):
    """The query over whole documents of sf0.01 against brute force: every linked pair of texts is in one class (recall 1), and counted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = queries.op6_jaccard_join(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == check_listed(got, rows)


@pytest.mark.parametrize("block", [3, 7])
def test_chains_in_blocks(spark, monkeypatch, block):
    """Families of texts that are not all linked: what pivots leave is compared in blocks of both kinds."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HOT", 5)
    monkeypatch.setattr(neardup, "SALTS", 3)
    rows, i = [], 0
    for family in range(3):
        base = words(60, 4000 + family)
        for step in range(0, 40, 2):
            rows.append((i, " ".join([*base[:step], *(f"y{family}z{k}" for k in range(step)), *base[step:]][:60] if step % 3 else [f"v{step}x{k}" for k in range(step // 4)] + base)))
            i += 1
    check_listed(neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_join_nothing(nothing):
    assert neardup.join(nothing).count() == 0
    assert neardup.one_of_each(nothing).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    base = [f"w{i}" for i in range(100)]
    near = [[*base[: i + 1], f"x{i}", *base[i + 2 :]] for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(near)], "doc_id long, text string")
    got = neardup.join(docs, count_all=True).collect()
    sets = [shingles(" ".join(w)) for w in near]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {r["class_id"] for r in got} == {0} and {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(want))


# URLs

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER)), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    listed = host == "bad.org" or host.endswith(".bad.org")
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow"


def test_urls(spark):
    given_ = ["http://WWW.Example.com/en/71?q=1", "http://example.com/en/8", "x.com/en/", None, "", "https://a.example.net/de/8#x", "https://b.net/de/", "http://com/en/", "http://com/en", "http://xcom/en/", "http://bad.org/x", "http://sub.bad.org", "http://bad.org/es/1", "a://b://c.com/en/", "http://bad.org.uk/", "http://ÄÖ.com/en/ü\n?x"] * 2
    pages = spark.createDataFrame([(i, u, "block") for i, u in enumerate(given_)], "page_id long, url string, verdict string")
    rules, listed = spark.createDataFrame(RULES, "rule string, verdict string"), spark.createDataFrame([("bad.org/",)], "rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules, listed).collect()}
    assert got == {i: judged(u) for i, u in enumerate(given_)}
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    assert urls.judge(pages, rules.limit(0), listed.limit(0)).filter("verdict <> 'allow'").count() == 0


def test_a_million_entries(spark):
    """The filter keeps its size, every listed url is blocked and no other is."""
    listed = spark.range(1_000_000).select(F.concat(F.lit("site"), F.col("id"), F.lit(".example.org/")).alias("rule"))
    pages = spark.range(0, 2_000_000, 997).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.site"), F.col("id"), F.lit(".example.org/x")).alias("url"))
    rules = spark.createDataFrame([], "rule string, verdict string")
    got = urls.judge(pages, rules, listed).groupBy("verdict", (F.col("page_id") < 1_000_000).alias("known")).count().collect()
    assert {(r["verdict"], r["known"]) for r in got} == {("block", True), ("allow", False)} and sum(r["count"] for r in got) == pages.count()


def test_names_that_clash(docs, spark):
    """Columns that an operator adds are refused where they are there already; stages pass on any names."""
    with pytest.raises(ValueError, match="m_copies"):
        mixing.mix(docs.withColumn("m_copies", F.lit(1)))
    with pytest.raises(ValueError, match="p_bin"):
        packing.pack(docs.withColumnRenamed("lang", "P_BIN"), keep=("doc_id", "P_BIN"))
    with pytest.raises(ValueError, match="host"):
        urls.judge(docs.withColumn("host", F.lit("x")), docs, docs, url="text", keep=("host",))
    odd = docs.withColumnsRenamed({"lang": "m_copies", "target": "n_t", "tilt": "key"})
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == mixing.mixed(docs).count()
    assert neardup.one_of_each(odd).columns == odd.columns
    assert packing.pack(odd.withColumnRenamed("m_copies", "p_bin")).count() == packing.pack(docs).count()
    assert sharding.shard(odd.withColumnRenamed("n_t", "h"), shards=2, keep=("h",)).count() == docs.count()


# Search


def test_search(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.normal(0, 0.2, 24).tolist()) for i in range(400)]
    vectors += [(7, vectors[7][1]), (100, draw.normal(0, 0.2, 24).tolist()), (401, vectors[100][1]), (402, None), (403, []), (404, [float("nan")] * 24), (405, [None] + [0.1] * 23), (406, [0.5, 0.5]), (None, [0.1] * 24), (500, [0.0] * 24), (600, [0.3, 0.1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    got = Counter()
    for r in topk.search(table, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"], r["rank"], r["vec_id"], r["score"]] += 1
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for a, (q, x) in enumerate(good):
        if q % 100 == 0:  # a row never meets itself, but other rows of its id
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(good) if a != b and len(x) == len(y))[:10]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want


def test_bounds_hold_and_tighten():
    draw = np.random.default_rng(8)
    q, v = np.floor(draw.normal(0, 200, (20, 30))), np.floor(draw.normal(0, 200, (50, 30)))
    last = np.full((20, 50), np.inf)
    for s in (1, 5, 30):
        bound = topk.statistics(q, s) @ topk.statistics(v, s).T
        assert (bound >= q @ v.T - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


def test_search_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_depth_is_chosen_at_the_threshold():
    """How many close links there are plays no part; what can't be reached is an error."""
    assert neardup.depths_for(0.8, 0.9999) == (6, 4) and neardup.depths_for(0.95, 0.999) == (6,)
    with pytest.raises(ValueError, match="don't find"):
        neardup.depths_for(0.2, 0.9999)


def test_sets_move_once(docs, spark):
    """Of the texts' sets, one exchange brings them to their key; the other is that of the wanted keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = neardup.sketch(docs, 5, "text", "doc_id").groupBy("key").agg(F.min("doc_id").alias("rep"))
        plan = neardup.sets_of(docs, neardup.cut(wanted), 5, "text", "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_components(spark):
    """A chain, a hub of more keys than HOT, pairs and a loop: the least key of each part."""
    names = [i.to_bytes(4, "big") for i in np.random.default_rng(3).permutation(4000).tolist()]
    edges = [*zip(names[:300], names[1:301], strict=True), *((names[400], x) for x in names[401:2600]), *zip(names[3000:3100], names[3100:3200], strict=True), (names[3999], names[3999])]
    groups = neardup.Groups(names)
    for a, b in edges:
        groups.join(a, b)
    got = {bytes(r["key"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(got.get(x, x) == groups.top(x) for x in names)


def test_joins_on_a_key_leave_its_table_where_it_is(spark):
    rows = spark.range(300).select(F.col("id").cast("string").cast("binary").alias("key"), "id")
    sets = neardup.cut(rows, "sets", "key")
    joined = rows.hint("merge").join(sets.withColumnRenamed("id", "n"), "key")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert joined.filter("id = n").count() == 300
    table = next(t.name for t in spark.catalog.listTables() if t.name.startswith("marlstone_scratch_"))
    neardup.free(sets)
    assert not spark.catalog.tableExists(table)
