"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join; DataFrame functions only.

The filter has at most BLOCKS_MOST blocks of 64 bits, so it may be sent to every task, and a url's tries are tested where the
url is read. Only what passes is shuffled to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import must_be_free

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a block, bits set for a key, keys a block is meant for (false positives stay near 1 in 1,000).
BLOCK_BITS, KEY_BITS, BLOCK_KEYS = 64, 4, 5
#: Blocks at most (16 MB with their numbers). Beyond five times as many entries more tries pass, and the exact join removes them.
BLOCKS_MOST = 1 << 20
#: Places over which the rows of one url are spread in the last join.
SALTS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each domain above it: a.b.c, b.c, c; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    at = F.sequence(F.lit(1), F.size(labels))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def mask(key: Column) -> Column:
    """The bits that a key sets in its block."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.xxhash64(key, F.lit(17)), 6 * i), F.lit(BLOCK_BITS)).cast("int")) for i in range(KEY_BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (b_block, b_bits) with a row for each block that is not empty; built in one aggregate."""
    return keys.groupBy(block(F.col(key), blocks).alias("b_block")).agg(F.bit_or(mask(F.col(key))).alias("b_bits"))


def match(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """For each distinct (host, path) of ``urls`` that an entry fits: the best rule and its verdict, and the best listed entry.

    ``listed``: kind ('rule' or 'list'), rule (host and path in one string), r_host, r_path, verdict. An entry fits its host and
    all subdomains, for paths that start with its own; the path of a bare host counts as its root for kind 'list'. The longest
    wins; of equally long ones, that with the longer host, then the greater in code points.

    A url is tried as each suffix of its host with each prefix of its path that is as long as some entry's path. The filter
    drops nearly all of those where they arise; the exact join removes its false positives. Lengths of paths come from the
    list, so the number of tries for a url is bounded by its host's labels times the list's distinct lengths.
    """
    n, lengths = listed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("r_path")))).first()
    blocks = min(BLOCKS_MOST, max(1, n // BLOCK_KEYS))
    root = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda k: k <= F.length(root)), lambda k: F.substr(root, F.lit(1), k))
    tried = urls.select("host", "path").filter("host <> ''").withColumn("s", F.explode(host_suffixes(F.col("host")))).withColumn("p", F.explode(prefixes))
    tried = tried.select("host", "path", F.concat("s", "p").alias("try"), F.length("s").alias("s_len"))
    # At most BLOCKS_MOST rows.
    filters = F.broadcast(bloom(listed, "rule", blocks))
    possible = tried.join(filters, block(F.col("try"), blocks) == F.col("b_block")).filter(F.col("b_bits").bitwiseAND(mask(F.col("try"))) == mask(F.col("try")))
    # Host and path are compared apart: a joined string alone could cut them elsewhere. Rules take paths as they stand.
    own = (F.col("try") == F.col("rule")) & (F.col("s_len") == F.length("r_host")) & ((F.col("kind") == "list") | (F.col("path") != "") | (F.col("r_path") == ""))
    exact = possible.select("host", "path", "try", "s_len").distinct().join(listed, own)
    order = F.struct(F.length("rule").alias("length"), F.length("r_host").alias("host_length"), F.col("rule"), F.col("verdict"))
    best = {kind: F.max(F.when(F.col("kind") == kind, order)) for kind in ("rule", "list")}
    found = exact.groupBy("host", "path").agg(best["rule"].alias("r"), best["list"].alias("l"))
    return found.select("host", "path", F.col("r.rule").alias("rule_rule"), F.col("r.verdict").alias("rule_verdict"), F.col("l.rule").alias("list_rule"), F.col("l.verdict").alias("list_verdict"))


def entries(listed: DataFrame, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Entries like ``example.com/en/7`` cut at the first slash into r_host and r_path, one row for each distinct rule (block before allow)."""
    cut = listed.filter(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("rule")).agg(F.max(verdict).alias("verdict"))
    return cut.withColumn("r_host", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)).withColumn("r_path", F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")).withColumn("rule", F.concat("r_host", "r_path"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Allow or block each row's url.

    ``rules`` (rule, verdict) decide where one fits. Elsewhere the method does: the url is blocked if ``listed`` (rule: listed
    canonical urls, which stand for what lies below them) holds it, else allowed. Both lists go through one filter and one
    exact join. Returns ``keep``, host, path, rule (null if no rule fits), listed (the entry that fits, or null), verdict.

    A null url, or one without ``://``, has an empty host and path and is allowed. Every row is judged, alike rows alike; an
    empty table gives no rows; an empty list blocks nothing. Further columns of ``pages`` are dropped unless in ``keep``; a kept
    column that has the name of a returned one is a ValueError. Very long urls are tried whole.
    """
    must_be_free(["host", "path", "rule", "listed", "verdict"], list(keep), "urls.judge")
    rows = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    both = entries(rules).withColumn("kind", F.lit("rule")).unionByName(entries(listed.select("rule", F.lit("block").alias("verdict"))).withColumn("kind", F.lit("list")))
    # Rows of one url are dealt over places, so that a popular one, or the null ones, don't meet in one task.
    place = F.pmod(F.xxhash64(*keep), F.lit(SALTS)) if keep else F.lit(0).cast("long")
    hits = match(rows, both).withColumn("u_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1 if keep else 0).cast("long"))))
    found = rows.withColumn("u_place", place).join(hits, ["host", "path", "u_place"], "left")
    return found.select(*keep, "host", "path", F.col("rule_rule").alias("rule"), F.col("list_rule").alias("listed"), F.coalesce("rule_verdict", "list_verdict", F.lit("allow")).alias("verdict"))
