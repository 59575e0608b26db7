"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates w minimise the relative entropy to "one of each", subject to
sum(w * size) = target for each source and 0 <= w <= cap. The solution is an exponential tilt, w = min(cap, exp(t * z)) with
z = size / (mean size of the source), and one dual variable t per source. The dual is convex; Newton steps, guarded
by a bracket, find t for all sources at once. Every step is a distributed aggregate over the histogram of (source, size),
which has all that the dual needs: documents of equal source and size have equal rates.

Rates become whole copies. Within a source, bins of the histogram are visited from the largest size down; each gets the
whole number of extra copies that brings the running sum of words nearest to that of the rates, so a source ends within
about half of one small document of its target. Which documents of a bin get the extra copy follows a hash of the id and
text, so reruns agree.

Targets: sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ...; together they get 150% of all words by weight. A
target stops at 2 times its source's words, and the excess is shared again by weight among the rest until none is above.

Cases: a null or wordless text has size 0 and takes nothing. A source without words has target 0. Rows equal in all of
doc_id, source and text count as separate rows. An empty table gives an empty result. Columns of the input that have
a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, given, hidden, named

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
CAP = 2.0
STEPS = 60
PART = 50_000  # rows of a bin that are ranked in one task
TOLERANCE = 1e-7
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target. One row per source goes in; ranks come from a range sort, not one window.

    The capped shares are a water level: a source is at its cap when level * weight >= cap * source_size. Sorting sources
    by cap * source_size / weight and summing gives the level exactly; no rounds of resharing are needed.
    """
    n = len(weights)
    ordered = _numbered(sources, [F.col("source").isNull(), F.col("source")])
    ws = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ix"), F.lit(n)) + 1).cast("int"))
    s = ordered.withColumn("weight", ws).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    s = cut(s)
    whole = s.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # The level rises until the pool is used up: with the sources whose cap is reached at level v counted at their cap and
    # the others at v * weight, the sum grows with v. Bisection on v needs one small aggregate a step.
    total = whole.first()
    if not total["all_size"]:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    wanted = min(total_share, cap) * float(total["all_size"])
    level = 0.0
    for _ in range(1000):  # the level rises past at least one source's cap a step, and sources at their cap stay there
        r = s.agg(
            F.sum(F.when(F.col("at") <= level, F.col("most")).otherwise(0.0)).alias("full"),
            F.sum(F.when(F.col("at") > level, F.col("weight")).otherwise(0.0)).alias("open"),
        ).first()
        if not r["open"]:
            break
        new = (wanted - r["full"]) / r["open"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    else:
        raise RuntimeError("the targets' level didn't settle")
    return s.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def _numbered(df: DataFrame, order: list) -> DataFrame:
    """``df`` with its 0-based place ``ix`` in ``order``: a range sort, then per-partition offsets (one number per partition)."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__k").alias("k0")).collect()
    start, offsets = 0, {}
    for r in sorted(counts, key=lambda r: r["__p"]):
        offsets[r["__p"]] = start - r["k0"]
        start += r["n"]
    if not offsets:
        return ranged.drop("__p", "__k").withColumn("ix", F.lit(0).cast("long"))
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return ranged.withColumn("ix", F.col("__k") + shift[F.col("__p")]).drop("__p", "__k")


def tilts(bins: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, tilt, mean): the dual solution of each source by distributed Newton steps over ``bins`` (source, size, n)."""
    means = bins.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.alias("g").join(means.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source"))).select(
        F.col("g.source").alias("source"), "source_size", "target", "mean",
        F.lit(0.0).alias("tilt"), F.lit(-745.0).alias("lo"), F.lit(745.0).alias("hi"),
        ((F.col("source_size") == 0) | (F.col("target") >= float(cap) * F.col("source_size") * (1 - 1e-12))).alias("done"),
    )
    state = cut(state)
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * z, F.lit(40.0))))
        free = F.exp(F.least(F.col("tilt") * z, F.lit(40.0))) < cap
        got = (
            bins.alias("b").join(state.where(~F.col("done")).alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("src"))
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.when(free, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("slope"))
        )
        j = state.alias("s").join(got.alias("r"), F.col("s.source").eqNullSafe(F.col("r.src")), "left")
        gap = F.col("target") - F.col("words")
        lo = F.when(gap > 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        # outside the bracket: halve it, or double the distance from 0 while its far end is still the initial one
        other = F.when((gap > 0) & (hi > 700), F.greatest(2 * F.col("tilt"), F.lit(1.0))).when((gap < 0) & (lo < -700), F.least(2 * F.col("tilt"), F.lit(-1.0))).otherwise((lo + hi) / 2)
        over = F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = cut(j.select(
            F.col("s.source").alias("source"), "source_size", "target", "mean",
            F.when(over, F.col("tilt")).when(inside, newton).otherwise(other).alias("tilt"),
            F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"), F.coalesce(over, F.lit(True)).alias("done"),
        ))
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        if steps and not state.where(~F.col("done")).isEmpty():
            raise RuntimeError(f"the dual didn't settle in {steps} steps")
    return state


def _copies(cap: float):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Bins of one source -> base and extra copies. A source has at most sqrt(2 * its words) distinct sizes."""
        pdf = pdf.sort_values("size", ascending=False)
        base = np.floor(pdf["rate"].to_numpy() + 1e-9)
        wanted = (pdf["rate"].to_numpy() - base) * pdf["n"].to_numpy()
        owed, extra = 0.0, []
        for size, n, w in zip(pdf["size"].tolist(), pdf["n"].tolist(), wanted.tolist()):
            k = 0 if size <= 0 else int(min(n, max(0, np.floor((owed + w * size) / size + 0.5))))
            owed += (w - k) * size
            extra.append(k)
        return pdf[["source", "size", "n"]].assign(base=base.astype("int64"), extra=np.array(extra, dtype="int64"), rate=pdf["rate"], source_size=pdf["source_size"], target=pdf["target"])

    return fold


def mix(docs: DataFrame, text: str = "text", weights=WEIGHTS, total_share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, th, seq, size, source_size, target, rate, copies, taken): the decision on every row.

    ``th`` is the text's hash and ``seq`` the row's rank in its bin (0 in a bin that gives no extra copies).
    """
    t = named(text)
    sized = cut(docs.select(named("doc_id").alias("doc_id"), named("source").alias("source"), F.xxhash64(t).alias("th"), size_of(t).alias("size")))
    bins = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = targets(bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total_share, cap)
    state = tilts(bins, goals, cap)
    full = F.col("target") >= float(cap) * F.col("source_size") * (1 - 1e-12)
    rate = F.when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(40.0)))))
    rated = bins.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        F.col("b.source").alias("source"), "size", "n", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))
    plan = rated.groupBy("source").applyInPandas(_copies(cap), "source string, size long, n long, base long, extra long, rate double, source_size long, target double")
    # Which rows of a bin get the extra copy: those of the least hashes. A large bin is cut into parts by the hash, whose counts tell where the last copy falls,
    # so that no task ranks more than a part, and a bin without extra copies isn't ranked.
    plan = cut(plan.withColumn("parts", F.when(F.col("extra") > 0, F.ceil(F.col("n") / PART)).otherwise(F.lit(0)).cast("long")))
    order = F.xxhash64("doc_id", "th")
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    placed = sized.alias("d").join(plan.alias("p"), on).select("d.doc_id", "d.source", "d.th", "d.size", "base", "extra", "rate", "source_size", "target", "parts")
    placed = placed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.shiftright(order, 20), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    plain = placed.where("parts = 0").withColumn("seq", F.lit(0).cast("long"))
    ranked = placed.where("parts > 0")
    if not plan.where("parts > 1").isEmpty():
        several = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = ranked.where("parts > 1").groupBy("source", "size", "part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(several), F.lit(0)))
        counts = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("k"), "before")
        ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("k")), "left").drop("s", "z", "k")
    else:
        ranked = ranked.withColumn("before", F.lit(0).cast("long"))
    within = Window.partitionBy("source", "size", "part").orderBy(order, "doc_id", "th")
    ranked = ranked.withColumn("seq", F.coalesce("before", F.lit(0)) + F.row_number().over(within)).drop("before")
    out = plain.unionByName(ranked)
    copies = (F.col("base") + F.when((F.col("parts") > 0) & (F.col("seq") <= F.col("extra")), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "th", "seq", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def replicate(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; copies follow each other. Extra columns are carried, whatever their names."""
    i, s, h, total, rows, k, copies, copy = (hidden(x) for x in ("id", "source", "th", "sum", "rows", "k", "copies", "copy"))
    plan = mix(docs, text, **settings).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("th").alias(h)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    on = named("doc_id").eqNullSafe(F.col(i)) & named("source").eqNullSafe(F.col(s)) & (F.xxhash64(named(text)) == F.col(h))
    # Rows equal in id, source and text share the copies of all: the first gets what doesn't divide.
    j = docs.join(plan, on)
    one = j.where(F.col(rows) == 1).select(*given(docs), F.col(total).alias(copies))
    w = Window.partitionBy(i, s, h).orderBy(F.lit(1))
    several = j.where(F.col(rows) > 1).withColumn(k, F.row_number().over(w)).select(
        *given(docs), (F.floor(F.col(total) / F.col(rows)) + F.when(F.col(k) <= F.col(total) % F.col(rows), 1).otherwise(0)).cast("long").alias(copies))
    spread = one.union(several).where(F.col(copies) > 0)
    return spread.select(*given(docs), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).select(*given(docs))
