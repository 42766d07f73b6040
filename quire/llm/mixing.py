"""A mixture of sources with target shares of the total size.

Each source has a budget, its weight times the total. Its texts get hash-random keys, are sorted by
range within the source, and distributed prefix sums of their sizes cut the source at its budget.
A source smaller than its budget is taken whole as often as the budget and its cap allow, then cut
in a last epoch. The text at the cut is taken if that brings the source nearer to its budget, so a
source misses its budget by no more than half of one text, unless its cap or a lack of texts
prevents it; the report tells by how much.

Texts of sources without a positive weight, and of no source, are not taken. Weights of a source
listed more than once count once, the largest; a null cap counts as 1. Empty texts have no size and
are not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.ranks import ranges_for, running
from quire.operators.joins import join_small
from quire.session import cut


def plan(sizes: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """Per listed source what there is and what is wanted; ``epochs`` whole ones and a ``rest``.

    ``total`` is the size of the mixture, by default that of all texts.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("available"))
    have = cut(have)
    if total is None:
        total = have.agg(F.sum("available")).first()[0] or 0
    wanted = weights.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    both = wanted.join(have, "source", "left").fillna(0, ["texts", "available"])
    both = both.withColumn("total", F.lit(total).cast("bigint"))
    both = both.withColumn("budget", F.round(F.col("target_weight") * F.lit(total)).cast("bigint"))
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    both = both.withColumn("epochs", F.least(whole, F.col("max_repeats").cast("bigint")))
    return both.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0))


def fitting_total(sizes: DataFrame, weights: DataFrame, missing: float = 0.0) -> int:
    """The largest total of which sources with texts lack no more than the share ``missing`` for their caps.

    Sources without texts can't be met at any total and don't count. Reads one row per listed source.
    """
    rows = [(r.target_weight, r.available * r.max_repeats) for r in plan(sizes.filter("tokens > 0"), weights, 0).filter("target_weight > 0 and available > 0").collect()]

    def lacking(total: float) -> float:
        return sum(max(0.0, w * total - most) for w, most in rows) / total

    if not rows:
        return 0
    low, high = 0, max(int(most / w) for w, most in rows) + 1
    if missing >= sum(w for w, _ in rows):
        raise ValueError("all may be missing")
    while lacking(high) <= missing:
        high *= 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if lacking(middle) <= missing else (low, middle)
    return low


def mix(sizes: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``sizes`` has ``doc_id``, ``source`` and ``tokens``. Mixture: ``source``, ``doc_id``, ``epoch``
    from 1, ``tokens``; one row each time that a text is taken. Report: a row per listed source with
    weight, cap, what there was, budget, what was taken, its share of what all sources gave and of the
    total asked for.
    """
    sizes = cut(sizes.select("doc_id", "source", "tokens")).filter("tokens > 0")  # a filter first would count tokens twice
    sources = cut(plan(sizes, weights, total))
    most = sources.agg(F.max("texts")).first()[0] or 0
    wanted = sources.filter("budget > 0 and available > 0").select("source", "epochs", "rest")
    chosen = join_small(sizes, wanted, "source").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id"))
    placed = running(chosen, ["source"], "_key", "tokens", ranges_for(most), ["doc_id"])
    nearer = 2 * (F.col("rest") - F.col("before")) > F.col("tokens")
    taken = placed.withColumn("epochs", F.col("epochs") + nearer.cast("bigint")).filter("epochs > 0")
    mixture = taken.select("source", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs"))).alias("epoch"), "tokens")
    got = taken.groupBy("source").agg(F.sum("epochs").alias("taken_texts"), F.sum(F.col("tokens") * F.col("epochs")).alias("taken"), F.max("epochs").alias("most_repeats"))
    report = sources.join(got, "source", "left").fillna(0, ["taken_texts", "taken", "most_repeats"])
    listed = Window.partitionBy(F.lit(1))  # the listed sources, a few rows
    report = report.withColumn("_whole", F.sum("taken").over(listed))
    share = F.when(F.col("_whole") > 0, F.col("taken") / F.col("_whole")).otherwise(0.0)
    return mixture, report.select("source", "target_weight", "max_repeats", "texts", "available", "budget", "taken_texts", "taken", "most_repeats", share.alias("actual_share"), F.when(F.col("total") > 0, F.col("taken") / F.col("total")).otherwise(0.0).alias("share_of_total"), F.greatest(F.col("budget") - F.col("taken"), F.lit(0)).alias("missing"))


def checks(mixture: DataFrame, report: DataFrame, sizes: DataFrame) -> DataFrame:
    """What would break the rules, by listed source: ``source``, ``too_often`` and ``off``, both 0 or 1.

    ``too_often``: a text more often than the cap; ``off``: farther from the budget than half of the source's
    largest text, though more could be taken.
    """
    times = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"))
    most = times.groupBy("source").agg(F.max(F.greatest("n", "last")).alias("most"))
    largest = sizes.groupBy("source").agg(F.max("tokens").alias("largest"))
    both = report.join(most, "source", "left").join(largest, "source", "left").fillna(0, ["most", "largest"])
    spent = F.col("taken") >= F.col("available") * F.col("max_repeats")
    off = (F.abs(F.col("budget") - F.col("taken")) * 2 > F.col("largest")) & ~((F.col("taken") < F.col("budget")) & spent)
    return both.select("source", (F.col("most") > F.col("max_repeats")).cast("int").alias("too_often"), off.cast("int").alias("off"))
