"""Operators that learn: counts against brute force, exact decoding, held-out accuracy, and every odd row."""

import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import language, pseudolikelihood, quality, toxicity
from marlstone.llm.words import held_out
from marlstone.sources.tables import table

DIR = "/root/testdata/sf0.01"


def brute_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            twice += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), twice, len(again)


ODD = ["", None, "a", "a b a b a b", "x y z\nx y z\n\n \nx y z", "é ü ß a\x0bb", "#*$ %&| <>", "\n\n", "one two three " * 40, "A\nA\nA", "tab\tseparated\r\nline\r\nline"]


def test_counts():
    m = quality.measure([(t or "").encode() for t in ODD])
    got = list(zip(*(m.counts[k].tolist() for k in quality.COUNTS), strict=True))
    assert got == [brute_counts(t) for t in ODD]


def test_viterbi_is_exact():
    draw = np.random.default_rng(1)
    for _ in range(50):
        scores, moves = draw.normal(0, 1, 7).tolist(), draw.normal(0, 1, (2, 2))
        value = lambda path: sum(s for s, p in zip(scores, path, strict=True) if p) + sum(moves[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=7), key=value)
        assert value(quality.viterbi(scores, moves.tolist())) == pytest.approx(value(best))


def test_expectations_match_enumeration():
    draw = np.random.default_rng(2)
    x, field = draw.normal(0, 1, (1, 5, len(quality.FEATURES))), quality.Field(draw.normal(0, 0.3, len(quality.FEATURES)), draw.normal(0, 1, (2, 2)))
    p, _ = quality.expectations(x, np.ones((1, 5), bool), field)
    s = x[0] @ field.weights
    paths = list(itertools.product((0, 1), repeat=5))
    weight = np.exp([sum(s[i] for i in range(5) if q[i]) + sum(field.moves[a, b] for a, b in zip(q, q[1:])) for q in paths])
    want = [sum(w for w, q in zip(weight, paths, strict=True) if q[i]) / weight.sum() for i in range(5)]
    assert p[0] == pytest.approx(want)


def test_quality(spark, docs, rows, nothing):
    got = quality.judge(docs, quality.START).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    for r in rows:
        n, chars, symbols, twice, again = brute_counts(r[1])
        g = by[r[0], r[1]]
        assert (g["q_n_words"], g["q_word_chars"], g["q_n_symbols"], g["q_n_dup_lines"], g["q_n_repeat_words"]) == (n, chars, symbols, twice, again)
        assert g["q_base_failed"] == (n < 50 or 100 * again > 50 * n) and not (g["q_kept"] and g["q_base_failed"])
    assert quality.judge(nothing, quality.START).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is quality.START


def test_field_learns_junk(spark):
    d, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    field = quality.fit(d, labels)
    got = quality.judge(d, field).join(labels, "doc_id").filter("not q_base_failed").groupBy("quality").pivot("q_kept", [True, False]).count().fillna(0).collect()
    kept = {r["quality"]: (r["true"], r["false"]) for r in got}
    assert kept[1][1] <= 0.02 * sum(kept[1]) and kept[0][1] >= 0.8 * sum(kept[0])


def test_toxicity_held_out(spark):
    """With the query's parameters, over documents of all languages that weren't learnt from."""
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(d, labels)
    known = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = toxicity.score(d.join(known, "doc_id").select("doc_id", "text", "toxic", "lang"), model).collect()
    rate = lambda toxic: np.mean([r["t_predicted"] for r in got if r["toxic"] == toxic])
    assert rate(1) > 0.6
    assert rate(0) < 0.03


def test_toxicity_odd_rows(spark, docs, rows, nothing):
    model = toxicity.train([("you are a vile-word person " * 3 + str(i), 1) for i in range(12)] + [("plain talk about weather and fields " * 3 + str(i), 0) for i in range(24)])
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["t_score"] <= 1 and r["t_predicted"] == (r["t_score"] >= 0.5) for r in got)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["t_predicted"] == 0 for r in toxicity.score(docs, none).collect())


def test_no_held_out_row_is_learnt(spark):
    labels = table(spark, DIR, "labels")
    d = table(spark, DIR, "documents").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    assert toxicity.fit(d, labels).toxic == b"" and language.train(d).langs == ()
    assert all(held_out(i) == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(50))


def test_language_held_out(spark):
    d = table(spark, DIR, "documents")
    got = language.predict(d.select("doc_id", "text", "lang"), language.train(d)).collect()
    right = [r["lang"] == r["l_pred"] for r in got if held_out(r["doc_id"])]
    assert sum(right) > 0.97 * len(right)


def test_filters_hold_what_they_learnt_and_correct_the_rest():
    draw = np.random.default_rng(4)
    grams = {f"l{i:02d}": np.unique(draw.integers(0, 1 << 32, 3000, dtype=np.uint32)) for i in range(70)}
    f = language.build(sorted(grams), grams)
    for at, lang in ((0, "l00"), (63, "l63"), (69, "l69")):
        held = np.ones(len(grams[lang]), bool)
        for i in range(language.HASHES):
            held &= (f.masks[language.slots_of(grams[lang], i), at // 64] >> np.uint64(at % 64) & np.uint64(1)).astype(bool)
        assert held.all()
    other = draw.integers(0, 1 << 32, 20_000, dtype=np.uint32)
    hit = np.ones(len(other), bool)
    for i in range(language.HASHES):
        hit &= (f.masks[language.slots_of(other, i), 0] & np.uint64(1)).astype(bool)
    assert abs(hit.mean() - f.false[0]) < 0.002


def test_language_odd_rows(docs, rows, nothing):
    f = language.train(docs)
    got = language.predict(docs, f).collect()
    assert len(got) == len(rows)
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["l_pred"] == "en") == lettered and 0 <= r["l_score"] <= 1
    assert language.predict(nothing, language.train(nothing)).count() == 0


def test_pseudo_likelihood(spark, docs, rows, nothing):
    got = pseudolikelihood.score(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    assert all(r["logprob"] < 0 if r["n_tokens"] else r["logprob"] == 0 and r["mean_logprob"] is None for r in got)
    assert pseudolikelihood.score(nothing).count() == 0


def test_scores_by_hand():
    """Sums of log-probabilities token by token, from the definition."""
    text = [b"a", b"b", b"a", b"c", b"zz"]
    counts = {b"a": 10, b"b": 5, b"c": 2}
    own = {w: i for i, w in enumerate(counts)}
    n = np.full(pseudolikelihood.PAD, 0.5)
    n[:3] += list(counts.values())
    class_of = (np.arange(pseudolikelihood.PAD) % pseudolikelihood.CLASSES).astype(np.uint8)
    mass = np.bincount(class_of, n, pseudolikelihood.CLASSES)
    v = pseudolikelihood.Vocabulary(own, class_of, (np.log(n) - np.log(mass[class_of])).astype(np.float32), (mass / mass.sum()).astype(np.float32))
    net, slots = pseudolikelihood.Network.start(v), v.slots(text)
    want = 0.0
    for i, s in enumerate(slots):
        around = [int(slots[j]) if 0 <= j < len(slots) else pseudolikelihood.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
        z = np.tanh(np.concatenate([net.embed[a] for a in around]) @ net.mix + net.bias) @ net.out + net.out_bias
        want += z[class_of[s]] - np.log(np.exp(z).sum()) + v.within[s]
    both = pseudolikelihood.sums(v, net, [slots, slots[:0], slots])
    assert both == pytest.approx([want, 0, want], rel=1e-4)


def test_training_beats_unigrams():
    draw = np.random.default_rng(5)
    v = pseudolikelihood.Vocabulary({}, (np.arange(pseudolikelihood.PAD) % 64).astype(np.uint8), np.zeros(pseudolikelihood.PAD, np.float32), np.full(64, 1 / 64, np.float32))
    start = draw.integers(0, 8, 20_000)
    slots = np.stack([start, start + 8, start + 16], 1).ravel().astype(np.uint16)  # each word is told by its neighbours
    net = pseudolikelihood.Network.start(v)
    before = pseudolikelihood.sums(v, net, [slots])[0]
    line, at = pseudolikelihood.padded(slots, np.array([0]))
    for i in range(0, len(slots) - 1024, 1024):
        net.learn(pseudolikelihood.contexts(line, at[i : i + 1024]), v.class_of[slots[i : i + 1024]].astype(np.int64), pseudolikelihood.RATE)
    after = pseudolikelihood.sums(v, net, [slots])[0]
    assert after > before + 0.5 * len(slots)


def test_shared_slots_keep_counts(spark):
    """Two words of one shared slot, one counted three times and one twice, alone in their texts: log 3/2 apart, by either way of the counts."""
    lm = pseudolikelihood
    others = [f"r{i}" for i in range(2000)]
    slots = {}
    a, b = next((slots[s], w) for w in others if slots.setdefault(s := lm.shared_slot(w.encode()), w) != w)
    text = " ".join([f"c{i}" for i in range(lm.OWN)] * 5 + others + [a])
    docs = spark.createDataFrame([(0, text), (1, a), (2, b)], "doc_id long, text string")
    for held in (lm.SENT_WORDS, 0):
        got = {r["doc_id"]: r["logprob"] for r in lm.score(docs, held=held).collect()}
        assert got[1] - got[2] == pytest.approx(np.log(3 / 2), abs=1e-5)


def test_slots_grow_with_words(spark):
    lm = pseudolikelihood
    words = spark.range(lm.OWN + 40_000).select(F.col("id").cast("string").cast("binary").alias("word"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("hash"), F.lit(1).cast("long").alias("n"))
    v, _ = lm.vocabulary(words)
    assert len(v.class_of) - lm.OWN == lm.GROWTH * 200
    assert np.exp(v.within.astype(float)).sum() == pytest.approx(np.count_nonzero(np.bincount(v.class_of)), rel=1e-4)


def test_slots_within_a_class_depend_on_context():
    """All words in one class, each told by its neighbours: only the second level can learn them."""
    lm = pseudolikelihood
    share = np.where(np.arange(lm.PAD) < 24, 1 / 24, 1e-9)
    v = lm.Vocabulary({}, np.zeros(lm.PAD, np.uint16), np.log(share / share.sum()).astype(np.float32), np.ones(1, np.float32))
    start = np.random.default_rng(5).integers(0, 8, 20_000)
    slots = np.stack([start, start + 8, start + 16], 1).ravel().astype(np.int32)
    net = lm.Network.start(v)
    before = lm.sums(v, net, [slots])[0]
    line, at = lm.padded(slots, np.array([0]))
    for i in range(0, len(slots) - 1024, 1024):
        net.learn(lm.contexts(line, at[i : i + 1024]), np.zeros(1024, np.int64), lm.RATE, v, slots[i : i + 1024])
    assert lm.sums(v, net, [slots])[0] > before + 0.5 * len(slots)


def test_every_token_is_a_target():
    texts = [np.arange(n, dtype=np.int32) for n in (1, 0, 2, 7, 100)]
    got = np.concatenate([pseudolikelihood.targets(texts, r, pseudolikelihood.ROUNDS) for r in range(pseudolikelihood.ROUNDS)])
    assert sorted(got.tolist()) == list(range(110))


def test_all_windows_train_the_dictionaries(monkeypatch):
    """No window of the texts that train is left out, nor any toxic stretch."""
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda samples, size, segment: seen.append((segment, samples)) or b"")
    bad = [f"bad{i:02d}word and {i} more" for i in range(40)]
    plain = [("a " * toxicity.WINDOW * 60_000, 0), *((f"plain {i}", 0) for i in range(59))]
    toxicity.train([*plain, *((f"{b} badword0 {i}", 1) for i, b in enumerate(bad))])
    held = dict(seen)
    assert len(held[toxicity.ORDINARY_SEGMENT]) == 60_000 + int(60 * toxicity.KNOWN) - 1
    assert all(b" badword0 " in s for s in held[toxicity.TOXIC_SEGMENT]) and len(held[toxicity.TOXIC_SEGMENT]) == int(40 * toxicity.KNOWN)


def test_marked_stretches_by_brute_force():
    draw = np.random.default_rng(6)
    letters = "abcde"
    word = lambda: "".join(letters[i] for i in draw.integers(0, 5, draw.integers(1, 9)))
    plain = [[word().encode() for _ in range(30)] for _ in range(60)]
    toxic = [[word().encode() for _ in range(20)] + [b"vilenasty", b"slurry"] for _ in range(25)]
    grams = lambda t: {x[i : i + n] for w in t for x in [b" " + w + b" "] for n in toxicity.GRAMS for i in range(len(x) - n + 1)}
    ours, theirs = Counter(g for t in toxic for g in grams(t)), Counter(g for t in plain for g in grams(t))
    marked = {g for g, n in ours.items() if n >= toxicity.LEAST and (n - n**0.5) / 25 >= toxicity.CONTRAST * (theirs[g] + 0.5) / 60}
    want = []
    for t in toxic:
        want.append([])
        for w in t:
            x = b" " + w + b" "
            at = [(i, i + n) for n in toxicity.GRAMS for i in range(len(x) - n + 1) if x[i : i + n] in marked]
            if at:
                want[-1].append(x[min(a for a, _ in at) : max(b for _, b in at)])
    assert toxicity.stretches(toxic, plain) == want and want[0]


def test_language_against_sets(spark):
    """Corrected hits of the filters against exact sets of grams: the same language, and nearly the same counts."""
    d = table(spark, DIR, "documents")
    f = language.train(d)
    texts = [(r["text"] or "").encode() for r in d.select("text").limit(200).collect()]
    n, found = language.hits(texts, f)
    sets = {}
    for at, lang in enumerate(f.langs):
        code, _ = language.gram_codes(texts)
        held = np.ones(len(code), bool)
        for i in range(language.HASHES):
            held &= (f.masks[language.slots_of(code, i), at // 64] >> np.uint64(at % 64) & np.uint64(1)).astype(bool)
        sets[lang] = set(code[held].tolist())
    for i, t in enumerate(texts):
        code, _ = language.gram_codes([t])
        for at, lang in enumerate(f.langs):
            raw = sum(c in sets[lang] for c in code.tolist())
            assert found[i, at] == pytest.approx(max(0, (raw - n[i] * f.false[at]) / (1 - f.false[at])))


def test_scores_do_not_depend_on_the_split(spark):
    d = table(spark, DIR, "documents").select("doc_id", "text")
    got = [{r["doc_id"]: r["logprob"] for r in pseudolikelihood.score(d.repartition(n)).collect()} for n in (1, 7)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-6) for k in got[0])
    plain = {r["doc_id"]: r["logprob"] for r in pseudolikelihood.score(d, rounds=0).collect()}
    words = sum(r["n"] for r in d.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).collect() if r["n"])
    assert sum(got[0].values()) - sum(plain.values()) > 0.3 * words  # gain over the untrained network, nats a word


def test_added_names_that_clash(docs):
    for operator, column in ((lambda d: quality.judge(d, quality.START), "q_kept"), (lambda d: toxicity.score(d, toxicity.train([])), "T_score"), (lambda d: language.predict(d, language.build([], {})), "l_pred")):
        with pytest.raises(ValueError, match=column.lower()):
            operator(docs.withColumnRenamed("lang", column))
    got = quality.judge(docs.withColumnRenamed("lang", "q_kept"), quality.START, prefix="mine_")
    assert got.count() == docs.count() and "mine_kept" in got.columns


def test_very_long_text(spark):
    """A text of 20 MB goes through whole: counts, languages, shingles and scores are those of its parts."""
    long = "the quick brown fox jumps over a lazy dog again.\n" * 400_000
    assert len(quality.measure([long.encode()]).counts["n_words"]) == 1
    m = quality.measure([long.encode(), b"x y"])
    assert m.counts["n_words"].tolist() == [4_000_000, 2] and m.counts["n_dup_lines"].tolist() == [399_999, 0]
    f = language.build(["en"], {"en": np.unique(language.gram_codes([long[:1000].encode()])[0])})
    assert language.summed([long.encode(), b""], f)[0, 0] > 15_000_000
    from marlstone.llm.words import word_hashes

    hashes, lengths = word_hashes([long.encode(), b"one", b""])
    assert lengths.tolist() == [4_000_000, 1, 0] and len(set(hashes.tolist())) == 11
    assert toxicity.Scorer(toxicity.train([("mild words here", 0), ("vile words there", 1)])).score([long.encode(), b""]).shape == (2,)


def test_fitting_leaves_the_driver_alone(spark, monkeypatch):
    """Models are trained by a task, on the whole sample in the order of its ids."""
    d, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    monkeypatch.setattr(toxicity, "train", lambda sample: (os.getpid(), sample))
    where, sample = toxicity.fit(d, labels)
    assert where != os.getpid()
    known = labels.filter("toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").join(d, "doc_id").orderBy("doc_id").collect()
    assert sample == [(r["text"] or "", r["toxic"]) for r in known]


def test_slots_take_two_bytes_where_they_fit():
    lm = pseudolikelihood
    share = np.full(lm.PAD, 1 / lm.PAD)
    v = lm.Vocabulary({}, np.zeros(lm.PAD, np.uint16), np.log(share).astype(np.float32), np.ones(1, np.float32))
    assert v.slots([b"a", b"b"]).dtype.itemsize == 2
    wide = lm.Vocabulary({}, np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.float32), np.ones(1, np.float32))
    assert wide.slots([b"a", b"b"]).dtype.itemsize == 4


def split_evenly(slots, classes=57):
    lm = pseudolikelihood
    draw = np.random.default_rng(4)
    share, class_of = draw.random(slots) + 0.1, np.arange(slots) * classes // slots
    mass = np.bincount(class_of, share)
    return lm.Vocabulary({}, class_of.astype(np.uint16), np.log(share / mass[class_of]).astype(np.float32), (mass / mass.sum()).astype(np.float32))


def test_steps_grow_with_the_log_of_the_slots(monkeypatch):
    """Exponentials of training and of scores: one for each class and a few for each halving, not one for each slot of a class."""
    lm, exp, seen = pseudolikelihood, np.exp, []
    for size in (16_000, 64_000):
        v = split_evenly(size)
        slots = np.random.default_rng(5).integers(0, size, 4096).astype(np.uint16)
        net = lm.Network.start(v)
        line, at = lm.padded(slots, np.array([0]))
        lm.sums(v, net, [slots])
        monkeypatch.setattr(np, "exp", lambda x, *a, **b: seen.append(np.size(x)) or exp(x, *a, **b))
        for work in (lambda: net.learn(lm.contexts(line, at), v.class_of[slots].astype(np.int64), lm.RATE, v, slots), lambda: lm.sums(v, net, [slots])):
            seen.clear()
            work()
            assert sum(seen) <= len(slots) * (57 + 2 * np.log2(size))
        monkeypatch.setattr(np, "exp", exp)


def test_probabilities_sum_to_one():
    """Over all slots in one context, after training; classes of one slot and of odd numbers of slots among them."""
    lm = pseudolikelihood
    sizes = [1, 1, 2, 3, 5, 7, 100, 333]
    class_of = np.repeat(np.arange(len(sizes)), sizes)
    share = np.random.default_rng(4).random(len(class_of)) + 0.01
    mass = np.bincount(class_of, share)
    v = lm.Vocabulary({b"b": 0, b"a": 1}, class_of.astype(np.uint16), np.log(share / mass[class_of]).astype(np.float32), (mass / mass.sum()).astype(np.float32))
    net, slots = lm.Network.start(v), np.random.default_rng(5).integers(0, len(class_of), 8192).astype(np.uint16)
    line, at = lm.padded(slots, np.array([0]))
    for i in range(0, 8192, 1024):
        net.learn(lm.contexts(line, at[i : i + 1024]), v.class_of[slots[i : i + 1024]].astype(np.int64), lm.RATE, v, slots[i : i + 1024])
    every = np.arange(len(class_of), dtype=np.uint16)
    for context in lm.contexts(line, at[:5]):
        found = net.log_slots(v, np.tile(context, (len(every), 1)), every, net.sides())
        assert np.exp(found.astype(float)).sum() == pytest.approx(1, rel=1e-4)


def test_sums_of_runs():
    draw = np.random.default_rng(6)
    for high in (1, 3, 40, 400):
        key = np.sort(draw.integers(0, high, 300))
        x = draw.integers(-9, 9, (300, 4)).astype(np.float32)
        begin, rows, total = pseudolikelihood.run_sums(x, key)
        assert sorted(key[begin].tolist()) == sorted(set(key.tolist()))
        for b, n, got in zip(begin.tolist(), rows.tolist(), total, strict=True):
            assert (key == key[b]).sum() == n and got.tolist() == x[key == key[b]].sum(axis=0).tolist()


def test_words_as_python_splits_them():
    draw = np.random.default_rng(7)
    parts = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x00", b"a", b"B", "é".encode(), "\u00a0".encode(), "\u2003".encode()]
    for n in range(50):
        texts = [b"".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 30))) for _ in range(n % 5)]
        words, codes, lengths = pseudolikelihood.split(texts)
        ends = np.cumsum(lengths).astype(int)
        found = [words[int(c)].as_py() for c in codes]
        assert [found[e - k : e] for e, k in zip(ends, lengths, strict=True)] == [t.split() for t in texts]
