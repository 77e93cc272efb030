"""The queries opN_<name>: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, language, lexical, manifest, neardup, pseudolikelihood, quality, toxicity, urls
from marlstone.llm.mixing import mix
from marlstone.llm.packing import pack
from marlstone.llm.sharding import shard
from marlstone.llm.topk import search
from marlstone.llm.words import fold
from marlstone.sources.tables import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 512 to 4,096 words: piece, start, tokens, bin, capacity, offset. Odd rows as in :func:`pack`."""
    got = pack(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[F.col(f"p_{c}").alias(c) for c in ("piece", "start", "tokens", "bin", "capacity", "offset")])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; sources weigh 1, 2, 3 by turns. Odd rows as in :func:`mix`."""
    got = mix(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return got.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"), F.col("m_copies").alias("copies"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each whole text, learnt from labels of rows that aren't held out. Odd rows as in :func:`toxicity.score`."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity.score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("t_score").alias("score"), F.col("t_predicted").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each whole text. Odd rows as in :func:`quality.judge`."""
    docs = table(spark, sf_dir, "documents")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.judge(docs.select("doc_id", "text"), field)
    return got.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (*quality.COUNTS, "base_failed", "content_share", "kept")])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules of op5 (rule, verdict).
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Listed canonical urls of op5: roots of sites that are blocked with all that lies below them.
URL_LIST = tuple(f"{site}.example.{top}/" for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
RULE_ROWS = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
LIST_ROWS = ", ".join(f"('{u}')" for u in URL_LIST)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url by the five rules, else by the listed sites. Odd rows as in :func:`urls.judge`."""
    rules = spark.sql(f"SELECT * FROM VALUES {RULE_ROWS} AS t(rule, verdict)")
    listed = spark.sql(f"SELECT * FROM VALUES {LIST_ROWS} AS t(rule)")
    return urls.judge(table(spark, sf_dir, "pages"), rules, listed)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of linked rows, representative and closest listed link of each document. Odd rows as in :func:`neardup.join`."""
    return neardup.join(table(spark, sf_dir, "documents"), count_all=True).select("doc_id", "class_id", "rep_id", "n_links", "link_id", "similarity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each whole text, learnt from rows that aren't held out. Odd rows as in :func:`language.predict`."""
    docs = table(spark, sf_dir, "documents")
    got = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("l_pred").alias("lang_pred"), F.col("l_score").alias("score"))


def op8_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of each document under a model of all. Odd rows as in :func:`pseudolikelihood.score`."""
    return pseudolikelihood.score(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all others. Odd rows as in :func:`search`."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, 24 shards of near equal bytes. Odd rows as in :func:`shard`."""
    return shard(table(spark, sf_dir, "documents"), shards=24)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each benchmark item. Odd rows as in :func:`lexical.search`."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the root that a tampered third folds to. Odd rows as in :func:`manifest.manifest`; a null id isn't tampered with."""

    def leaf(text: Column) -> Column:
        return manifest.digest(*map(manifest.field, [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]))

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", UPPER, UPPER.lower())))
    got = manifest.manifest(table(spark, sf_dir, "documents"), leaf(F.col("text")), keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    got = got.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return got.select("doc_id", "leaf", "subroot", "root", manifest.digest(manifest.siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each document that lie in a window of ten terms of a benchmark item, and those items. Odd rows as in :func:`decontamination.find`."""
    got = decontamination.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_mix_sources,
        op3_toxicity,
        op4_quality_rules,
        op5_url_filter,
        op6_jaccard_join,
        op7_language_id,
        op8_pseudolikelihood,
        op9_exact_topk,
        op10_histogram_shards,
        op11_ranked_search,
        op12_merkle_manifest,
        op13_benchmark_decontamination,
    )
}

#: Terms of a text in DuckDB, lower-cased.
TERMS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: crc32 of an ASCII text in DuckDB, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)), 4294967295)"""
#: Levels of a tree that the SQL of op12 has: enough for 8^12 rows.
DEPTH = 12


def merkle_sql() -> str:
    """SQL of op12: each level's digests with the texts before and after them in their run of eight, and a join for each level."""
    each = ", ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    leaf = "sha256(concat({}, coalesce(octet_length(encode({})) || ':' || {}, '-')))"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    ctes = [
        f"rows AS (SELECT row_number() OVER () AS place, doc_id, lang, {leaf.format(each, 'text', 'text')} AS leaf, {leaf.format(each, lower, lower)} AS other FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM rows)",
    ]
    run = "OVER (PARTITION BY {0}, pos // 8 ORDER BY pos ROWS BETWEEN {1})"
    for name, by, last in (("p", "lang", DEPTH), ("t", "one", 4)):
        for k in range(last):
            sides = ", ".join(f"coalesce(string_agg(h, '') {run.format(by, span)}, '') AS {side}" for side, span in (("b", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("a", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))
            ctes.append(f"{name}s{k} AS (SELECT {by}, pos, n, {sides} FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT {by}, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY {by}, pos // 8, n)")
        if name == "p":
            ctes.append(f"t0 AS (SELECT 1 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM p{DEPTH})")
    ctes.append(f"f0 AS (SELECT p0.place, p0.doc_id, p0.lang, p0.leaf, p0.pos, t0.pos AS top, t0.h AS subroot, '' AS proof, CASE WHEN {CRC32_SQL.format('CAST(p0.doc_id AS VARCHAR)')} % 3 = 0 THEN other ELSE leaf END AS own FROM p0 JOIN t0 ON p0.lang IS NOT DISTINCT FROM t0.lang)")
    steps = [(f"ps{k}", f"s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos // {8**k}") for k in range(DEPTH)] + [(f"ts{k}", f"s.pos = f.top // {8**k}") for k in range(4)]
    for i, (side, on) in enumerate(steps):
        ctes.append(f"f{i + 1} AS (SELECT f.place, f.doc_id, f.lang, f.leaf, f.pos, f.top, f.subroot, f.proof || CASE WHEN s.n > 1 THEN s.b || s.a ELSE '' END AS proof, CASE WHEN s.n > 1 THEN sha256(s.b || f.own || s.a) ELSE f.own END AS own FROM f{i} f JOIN {side} s ON {on})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, t4.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = t4.h AS verified FROM f{len(steps)}, t4"


#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op5_url_filter": f"""
        WITH rules(rule, verdict) AS (VALUES {RULE_ROWS}),
        listed(rule) AS (VALUES {LIST_ROWS}),
        p AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        cut_rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS s FROM rules),
        cut_listed AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS s FROM listed),
        hosts AS (SELECT DISTINCT host, path, CASE WHEN host <> '' AND path = '' THEN '/' ELSE path END AS canonical FROM p),
        by_rule AS (
            SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM hosts JOIN cut_rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY host, path),
        by_list AS (
            SELECT host, path, arg_max(rule, length(rule)) AS listed
            FROM hosts JOIN cut_listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(canonical, s) GROUP BY host, path)
        SELECT p.page_id, p.host, p.path, by_rule.rule, by_list.listed,
            coalesce(by_rule.verdict, CASE WHEN by_list.listed IS NOT NULL THEN 'block' END, 'allow') AS verdict
        FROM p LEFT JOIN by_rule ON p.host = by_rule.host AND p.path = by_rule.path
        LEFT JOIN by_list ON p.host = by_list.host AND p.path = by_list.path""",
    "op11_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS place, doc_id, {TERMS_SQL.format("text")} AS w FROM documents),
        b AS (SELECT row_number() OVER () AS asked, item_id, {TERMS_SQL.format("text")} AS w FROM benchmark),
        corpus AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
        tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(w) AS term FROM d) GROUP BY place, term),
        asked AS (SELECT DISTINCT asked, item_id, term FROM (SELECT asked, item_id, unnest(w) AS term FROM b)),
        weight AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM tf SEMI JOIN asked USING (term) GROUP BY term), corpus),
        scored AS (
            SELECT asked, item_id, place, doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n) // l)))) AS BIGINT) AS score
            FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (place), corpus GROUP BY asked, item_id, place, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op12_merkle_manifest": merkle_sql(),
    "op13_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS place, doc_id, {TERMS_SQL.format("text")} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {TERMS_SQL.format("text")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT place, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
            FROM (SELECT place, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        found AS (SELECT g.place, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.s = x.s),
        hit AS (SELECT place, count(DISTINCT pos) AS n FROM (SELECT place, unnest(range(i, i + n)) AS pos FROM found) GROUP BY place),
        items AS (SELECT place, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT place, item_id FROM found) GROUP BY place)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
            sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.place = hit.place LEFT JOIN items ON d.place = items.place""",
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, q.place, c.vec_id,
                CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.place <> c.place AND len(q.x) = len(c.x)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS n FROM pairs)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10""",
}
