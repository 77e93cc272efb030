"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Each document's rate ``w`` minimises the entropy ``sum(w log w - w)`` under a token constraint for its source,
``sum(w * size) = target``, and ``0 <= w <= most``. The solution is ``w = min(most, exp(tilt * size))`` with a tilt for each
source, the root of the dual's gradient. Newton iterations find it: each is one join and one aggregate over the table of
distinct (source, size), so that documents are read once whatever the number of iterations. Sums are decimals and rates
fixed-point numbers, so that no result hangs on the order in which tasks end.

Rates become copies by systematic rounding: in the order of size, copies are the steps of the running sum of rates. Of 32
starting points the one that brings the source nearest to its target is taken. The running sum is a sum within small chunks
(source, band of size, salt) plus the chunks before, so no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.words import must_be_free, n_words
from marlstone.plans.scratch import cut

#: Columns that are added or used inside, after ``m_``.
OWN = ("size", "source_size", "target", "rate", "copies", "skey", "hash", "band", "salt", "tilt", "u", "c", "before", "start")
#: Units of a rate of 1, starting points of the rounding, salts of a band at least.
ONE, STARTS, SALTS = 1 << 20, 32, 16
#: Rows of a chunk at most, about, if one size in one source holds all: with more rows there are more salts.
SALT_ROWS = 500_000


def targets(sources: DataFrame, total: Column, weight: Column, most: int) -> DataFrame:
    """Add ``target``: the share of ``total`` by ``weight``, at most ``most`` times the source's size, the excess reshared.

    ``sources`` has one row for each source (skey, source_size) and is small, as many rows as there are sources. Capped
    sources are those with the least size for their weight, so one pass in that order finds the level for the others.
    """
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = sources.withColumn("total", total).withColumn("weight", weight).withColumn("level", level.cast("double")).withColumn("fits", F.col("level") * F.col("weight") <= cap)
    first = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("skey"), F.col("level")).alias("x")))
    return levelled.withColumn("found", first.over(Window.partitionBy())).withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("found.level") * F.col("weight"), cap.cast("double")))).drop("total", "level", "fits", "found")


def solve(hist: DataFrame, goals: DataFrame, most: int, rounds: int, tolerance: float) -> DataFrame:
    """Tilts (skey, tilt) by safeguarded Newton steps on the dual, for all sources at once.

    ``hist``: skey, size, n with size over 0. The tokens that a tilt takes rise with it, from 0 to ``most`` times the
    source at ``log(most)``, so a root lies below; a step that leaves the bracket is replaced by a division of it.
    """
    top = math.log(most)
    state = goals.select(
        "skey",
        "target",
        F.when(F.col("target") >= most * F.col("source_size"), F.lit(top)).otherwise(F.lit(0.0)).alias("tilt"),
        F.lit(-1e300).alias("low"),
        F.lit(top).alias("high"),
        (F.col("target") >= most * F.col("source_size")).alias("done"),
    )
    state = cut(state, "mix-state")
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size")))
    tokens = (F.col("n") * F.col("size") * rate).cast("decimal(38,8)")
    slope = F.when(F.col("tilt") * F.col("size") < top, (F.col("n") * F.col("size") * F.col("size") * rate).cast("decimal(38,8)"))
    for _ in range(rounds):
        open_ = state.filter(~F.col("done"))
        got = hist.join(open_.select("skey", "tilt"), "skey").groupBy("skey").agg(F.sum(tokens).cast("double").alias("g"), F.sum(slope).cast("double").alias("h"))
        over = F.col("g") > F.col("target")
        moved = open_.join(got, "skey", "left").withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(~over, F.col("tilt")).otherwise(F.col("low")))
        step = F.col("tilt") - F.col("g") / F.col("h") * F.log(F.col("g") / F.col("target"))
        middle = (
            F.when((F.col("low") > 0) & (F.col("high") > 0), F.sqrt(F.col("low") * F.col("high")))
            .when(F.col("low") == 0, F.col("high") / 64)
            .when(F.col("low") < -1e299, F.least(F.lit(-1e-6), F.col("high") * 4))
            .when(F.col("high") < 0, -F.sqrt(F.col("low") * F.col("high")))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        # Where the bracket has shrunk to nothing, no tilt comes nearer.
        tight = (F.col("low") > -1e299) & (F.col("high") - F.col("low") <= F.lit(1e-15) * F.greatest(F.abs("low"), F.abs("high")))
        inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
        done = F.coalesce(F.abs(F.col("g") - F.col("target")) <= F.lit(tolerance) * F.col("target"), F.lit(True)) | tight
        moved = moved.withColumn("done", done).withColumn("tilt", F.when(done, F.col("tilt")).when(inside, step).otherwise(middle)).select(state.columns)
        state = cut(state.filter("done").unionByName(moved), "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            return state.select("skey", "tilt")
    raise RuntimeError(f"the tilts of {state.filter(~F.col('done')).count()} sources haven't converged after {rounds} rounds")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, rounds: int = 60, tolerance: float = 1e-7, sizes: Column | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Choose how often each document is taken, so that the sources' words stand as the weights.

    Sources in the order of code points, null last, weigh as ``weights``, repeating. Adds to the columns of ``keep`` (all of
    ``docs`` if None): m_size, m_source_size, m_target (its source's), m_rate and m_copies (0 to ``most``).

    Texts that are null or without a word have size 0 and are taken once; a null source is a source of its own; null ids
    are allowed; rows that are alike count each on their own. Of rows of one size the hash of id and text decides which is taken
    once more; rows alike in these may change places, which changes no sum. Words of very long texts are counted whole, and such
    a text may be most of its source. An empty table gives no rows. Columns of ``docs`` may have any names that don't begin with ``m_``.
    """
    size = n_words(F.col(text)) if sizes is None else sizes
    keep = tuple(docs.columns) if keep is None else keep
    must_be_free([f"m_{c}" for c in OWN], list(keep), "mixing.mix")
    skey = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    rows = docs.select(*keep, skey.alias("m_skey"), size.alias("m_size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("m_hash"))
    if text in keep:
        slim = cut(rows.select("m_skey", "m_size", "m_hash"), "mix-sizes")
    else:  # without the text, rows are short enough to be written, and texts are read once
        rows = slim = cut(rows, "mix-sizes")
    salts, n_rows = SALTS, slim.count()
    while salts * SALT_ROWS < n_rows:
        salts *= 4
    band = F.floor(F.log2(F.greatest(F.col("m_size"), F.lit(1))) * 8).cast("int").alias("m_band")
    salt = F.pmod(F.col("m_hash"), F.lit(salts)).cast("int").alias("m_salt")
    by_salt = slim.groupBy("m_skey", "m_size", band, salt).agg(F.count("*").alias("n"))
    hist = cut(by_salt.groupBy(F.col("m_skey").alias("skey"), F.col("m_size").alias("size")).agg(F.sum("n").alias("n")), "mix-hist")
    place = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey")) - 1
    sources = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    goals = cut(targets(sources, F.sum("source_size").over(Window.partitionBy()), weigh, most), "mix-goals")
    tilts = solve(hist.filter("size > 0"), goals.filter("source_size > 0"), most, rounds, tolerance)
    plan = goals.join(tilts, "skey", "left").select(F.col("skey").alias("m_skey"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), F.coalesce("tilt", F.lit(0.0)).alias("m_tilt"))
    plan = cut(plan, "mix-tilts")

    units = F.round(F.least(F.lit(float(most)), F.exp(F.col("m_tilt") * F.col("m_size"))) * ONE).cast("long")
    chunk = ["m_skey", "m_band", "m_salt"]
    sums = by_salt.filter("m_size > 0").join(plan, "m_skey").groupBy(*chunk).agg(F.sum(units * F.col("n")).alias("units"))
    # A source has at most (bands of size) * salts chunks.
    running = Window.partitionBy("m_skey").orderBy(F.desc("m_band"), "m_salt").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut(sums.select(*chunk, F.coalesce(F.sum("units").over(running), F.lit(0)).alias("m_before")), "mix-chunks")

    def steps(x: DataFrame) -> DataFrame:
        """Add m_u (units of the rate) and m_c (running sum with the row itself); rows of size 0 are spread and get none."""
        some = F.col("m_size") > 0
        x = x.withColumns({"m_band": F.when(some, band), "m_salt": F.when(some, salt).otherwise(F.pmod(F.col("m_hash"), F.lit(salts * 64)).cast("int"))})
        x = x.join(plan, "m_skey", "left").withColumn("m_u", units).join(chunks, chunk, "left")
        within = Window.partitionBy(*chunk).orderBy(F.desc("m_size"), "m_hash").rowsBetween(Window.unboundedPreceding, 0)
        return x.withColumn("m_c", F.col("m_before") + F.sum("m_u").over(within))

    def copies(start: Column) -> Column:
        at = lambda c: F.floor((c + start) / F.lit(ONE))
        return at(F.col("m_c")) - at(F.col("m_c") - F.col("m_u"))

    tried = steps(slim.filter("m_size > 0")).groupBy("m_skey").agg(F.first("m_target").alias("target"), *[F.sum(F.col("m_size") * copies(F.lit(j * ONE // STARTS))).alias(f"t{j}") for j in range(STARTS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j * ONE // STARTS).alias("start")) for j in range(STARTS)]))
    starts = cut(tried.select("m_skey", best["start"].alias("m_start")), "mix-starts")
    taken = F.when(F.col("m_size") > 0, copies(F.col("m_start"))).otherwise(F.lit(1)).cast("int")
    return steps(rows).join(starts, "m_skey", "left").select(*keep, "m_size", "m_source_size", "m_target", (F.col("m_u") / F.lit(ONE)).alias("m_rate"), taken.alias("m_copies"))


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with the columns of ``docs``, whatever their names."""
    names = {c: f"k{i}_{c}" for i, c in enumerate(docs.columns)}  # no name of the input meets one that is used inside
    how = {"source": "source", "text": "text", "doc_id": "doc_id", **how}
    found = mix(docs.withColumnsRenamed(names), **{k: names.get(v, v) if k in ("source", "text", "doc_id") else v for k, v in how.items()})
    copies = F.explode(F.array_repeat(F.lit(1), F.col("m_copies")))
    return found.filter("m_copies > 0").withColumn("m_copy", copies).select([F.col(names[c]).alias(c) for c in docs.columns])
