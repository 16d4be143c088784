"""Mixing sources to target weights by entropy balancing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.session import cut_lineage

#: Documents of one (source, size) group that one task ranks.
BLOCK_ROWS = 10_000
MAX_COPIES = 2
ROUNDS = 80
#: Groups per source that take up what rounding has left.
FIXES = 3
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(source, source_size) -> plus ``target``: the weights, dealt in code-point order of the sources (null last) and repeating, split
    ``share`` times the whole size; a source stops at MAX_COPIES times its own, and what is over goes to the others by weight.

    One row per source, ordered as a whole: a mixture names its sources. A source is capped as long as its cap over its weight is below the
    level that the rest would get, so running sums in that order give the level at which resharing ends.
    """
    # Spark compares strings by their bytes, which is code-point order
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MAX_COPIES).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rest = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", rest / F.sum("weight").over(after))
    # levels rise while sources are capped and fall after that: the largest one that fits is the one of the first source not capped
    level = F.max(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))).over(every)
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("rank", "weight", "cap", "level")


def rate(tilt: Column, size: Column, scale: Column) -> Column:
    """Rate of a document: the exponential tilt by its tokens, not above MAX_COPIES."""
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.try_divide(tilt * size, scale), F.lit(50.0))))


def solve_tilts(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, ..., target) plus ``scale`` and ``tilt``: the dual optimum of min sum KL(rate, 1) with sum(rate * size) = target and rate <= MAX_COPIES.

    Each round is one aggregation of (source, size, n) groups: gradient and curvature of the convex dual per source, then a Newton step, or the
    middle of the bracket where that step would leave it. Sums are exact decimals, so reruns agree. A source whose target is its cap needs no
    tilt: all its documents are taken MAX_COPIES times.
    """
    start = F.log(F.greatest(F.try_divide("target", "source_size"), F.lit(1e-12)))
    state = sources.withColumns({"scale": F.try_divide("moment", "source_size"), "tilt": start, "low": F.lit(-1e6), "high": F.lit(1e6), "gap": F.lit(1.0)})
    state = cut_lineage(state.withColumn("open", (F.col("source_size") > 0) & (F.col("target") < MAX_COPIES * F.col("source_size"))))
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(ROUNDS):
        at = groups.join(state.where("open").select("source", "tilt", "scale"), groups["source"].eqNullSafe(state["source"])).drop(state["source"])
        tokens = F.col("n") * F.col("size") * rate(F.col("tilt"), F.col("size"), F.col("scale"))
        slope = F.when(rate(F.col("tilt"), F.col("size"), F.col("scale")) < MAX_COPIES, F.try_divide(tokens * F.col("size"), F.col("scale"))).otherwise(0.0)
        sums = at.groupBy(F.col("source").alias("s")).agg(exact(tokens).alias("got"), exact(slope).alias("curve"))
        step = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").drop("s")
        step = step.withColumn("over", F.col("got") - F.col("target"))
        step = step.withColumn("high", F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("over") <= 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.col("tilt") - F.col("over") / F.when(F.col("curve") > 0, F.col("curve"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        # without a finite bracket the way back from a flat stretch is a doubling step
        middle = F.when((F.col("low") > -1e6) & (F.col("high") < 1e6), (F.col("low") + F.col("high")) / 2)
        middle = F.coalesce(middle, F.when(F.col("over") > 0, F.least(F.col("tilt") * 2, F.lit(-1.0))).otherwise(F.greatest(F.col("tilt") * 2, F.lit(1.0))))
        gap = F.when(F.col("open"), F.try_divide(F.abs("over"), F.col("target"))).otherwise(0.0)
        step = step.withColumn("gap", F.coalesce(gap, F.lit(0.0)))
        moved = F.when(inside, newton).otherwise(middle)
        step = step.withColumn("tilt", F.when(F.col("open") & (F.col("gap") > TOLERANCE), moved).otherwise(F.col("tilt")))
        state = cut_lineage(step.drop("over", "got", "curve").withColumn("open", F.col("open") & (F.col("gap") > TOLERANCE)))
        if not state.where("open").limit(1).collect():
            break
    return state.drop("low", "high", "gap", "open")


def group_copies(groups: DataFrame, solved: DataFrame) -> DataFrame:
    """(source, size, n, copies): whole copies for each (source, size) group.

    Rates times documents are added up from the largest size down and rounded as running totals; what is lost on one size is made up on the next
    smaller one. Then one group per source after another, each time the one that leaves the least, takes up the rest.
    """
    g = groups.join(solved.withColumnRenamed("source", "s"), groups["source"].eqNullSafe(F.col("s"))).drop("s")
    r = F.when(F.col("source_size") == 0, 1.0).when(F.col("target") >= MAX_COPIES * F.col("source_size"), float(MAX_COPIES)).otherwise(rate(F.col("tilt"), F.col("size"), F.col("scale")))
    run = Window.partitionBy("source").orderBy(F.col("size").desc())
    g = g.withColumn("rate", r).withColumn("upto", F.round(F.sum(F.col("n") * F.col("rate")).over(run)))
    g = g.withColumn("copies", (F.col("upto") - F.coalesce(F.lag("upto").over(run), F.lit(0.0))).cast("long"))
    g = g.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * MAX_COPIES))
    for _ in range(FIXES):
        g = g.withColumn("left", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("source")))
        fix = F.when(F.col("size") > 0, F.round(F.try_divide("left", "size"))).otherwise(0.0).cast("long")
        g = g.withColumn("fix", F.least(F.greatest(fix, -F.col("copies")), F.col("n") * MAX_COPIES - F.col("copies")))
        best = F.row_number().over(Window.partitionBy("source").orderBy(F.abs(F.col("left") - F.col("fix") * F.col("size")), "size"))
        g = g.withColumn("copies", F.col("copies") + F.when(best == 1, F.col("fix")).otherwise(0))
    return g.select("source", "size", "n", "copies", "rate", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: ``doc``, ``source``, size, source_size, target, rate, copies (0..2), taken = copies * size.

    ``target`` is what :func:`targets` gives the row's source; the copies of a source add up to its target but for less than its largest document,
    mostly a few words. A null text has size 0 and takes no words; null is a source of its own; a source without words has target 0; an
    empty table gives an empty result. Repeated rows are rows of their own: which of several rows of the same size gets the
    extra copy depends on a hash of ``doc``, so reruns agree. A hot source shrinks to its different sizes before any join, and a hot
    (source, size) group is ranked in blocks of about BLOCK_ROWS rows.
    """
    rows = cut_lineage(docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    groups = cut_lineage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("moment"))
    solved = solve_tilts(groups, targets(by_source, weights, share))
    plan = cut_lineage(group_copies(groups, solved))

    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    dealt = rows.join(plan, same(rows, plan)).drop(plan["source"]).drop(plan["size"])
    mixed = F.xxhash64("doc", F.lit("mix"))
    dealt = dealt.withColumn("hash", mixed).withColumn("block", F.pmod(mixed, F.ceil(F.col("n") / BLOCK_ROWS)))
    blocks = dealt.groupBy("source", "size", "block").agg(F.count("*").alias("rows"))
    blocks = blocks.withColumn("before", F.sum("rows").over(Window.partitionBy("source", "size").orderBy("block")) - F.col("rows"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("block").alias("b"), "before")
    dealt = dealt.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("block") == F.col("b"))).drop("s", "z", "b")
    place = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("hash", "doc")) - 1
    extra = F.col("copies") % F.col("n")
    more = F.floor((place + 1) * extra / F.col("n")) - F.floor(place * extra / F.col("n"))
    dealt = dealt.withColumn("own", (F.floor(F.col("copies") / F.col("n")) + more).cast("long"))
    return dealt.select(F.col("doc").alias(doc), F.col("source").alias(source), "size", "source_size", "target", "rate", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"))
