"""Texts of varying length in containers of fixed capacity.

Large-item matching: texts above a third of the capacity go at most two to a container, by greedy
matching from the largest down, each with the largest that still fits; smaller texts, again from the
largest down, go into the smallest gap that takes them. Only sizes matter to this, and there are no
more than the capacity's number of them, so it runs exactly and for all texts at once on the counts
of each size, a table bounded by the capacity. It yields a plan of ranges: items of one size and of
these ranks go, so many each, to these containers. Items find their container by size and rank.

No text is split unless it alone exceeds the capacity; then it fills containers and only its last
piece is packed with others. Texts without tokens lie in the first container; null texts in none.
Repeated rows are items of their own.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.ranks import ranges_for, running
from quire.session import cut, shipped


@dataclass
class Plan:
    """Ranges of items: ``each`` items of ``size`` from ``rank`` on to each of the containers from ``first`` on."""

    rows: list[tuple[int, int, int, int]]  # size, rank, each, first
    containers: int


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts`` items of each size; sizes lie between 0 and the capacity."""
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges of containers
    open_gaps: list[int] = []  # the gaps that occur, sorted
    total = 0

    def put(size: int, each: int, first: int, n: int) -> None:
        rows.append((size, used[size], each, first))
        used[size] += each * n
        left[size] -= each * n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        other = large[at] if at >= 0 else None
        if other is None:
            n = left[size]
            put(size, 1, total, n)
            leave(capacity - size, total, n)
        elif other == size:
            n = left[size] // 2
            if n:
                put(size, 2, total, n)
                leave(capacity - 2 * size, total, n)
            elif at == 0:  # the last one has no partner left
                n = 1
                put(size, 1, total, 1)
                leave(capacity - size, total, 1)
            else:
                other, n = large[at - 1], 1
                put(size, 1, total, 1)
                put(other, 1, total, 1)
                leave(capacity - size - other, total, 1)
        else:
            n = min(left[size], left[other])
            put(size, 1, total, n)
            put(other, 1, total, n)
            leave(capacity - size - other, total, n)
        total += n
        for s in {size, other} - {None}:
            if not left[s]:
                large.remove(s)
    for size in sorted((s for s in left if 0 < 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                n = -(-left[size] // (capacity // size))
                leave(capacity, total, n)
                total += n
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                put(size, each, first, full)
                leave(gap - each * size, first, full)
            if full < n and left[size]:
                rest = left[size]
                if rest < each:
                    put(size, rest, first + full, 1)
                    leave(gap - rest * size, first + full, 1)
                    full += 1
            leave(gap, first + full, n - full)
    if left.get(0):
        put(0, left[0], 0, 1)
        total = max(total, 1)
    return Plan(rows, total)


def _place(plans: dict[int, Plan]):
    tables = {}
    for spec, p in plans.items():
        a = np.array(sorted(p.rows), np.int64).reshape(-1, 4)
        tables[spec] = (a, {s: np.searchsorted(a[:, 0], [s, s + 1]) for s in np.unique(a[:, 0])})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            container = np.zeros(len(part), np.int64)
            for (spec, size), rows in part.groupby(["spec_id", "tokens"]).indices.items():
                a, spans = tables[spec]
                low, high = spans[size]
                rank = part["rank"].to_numpy()[rows]
                at = low + np.searchsorted(a[low:high, 1], rank, "right") - 1
                container[rows] = a[at, 3] + (rank - a[at, 1]) // a[at, 2]
            yield part.drop(columns="rank").assign(container=container)

    return run


def pieces(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """Items of each capacity: ``spec_id``, ``doc_id``, ``piece``, ``start``, ``tokens``."""
    spec = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in specs])
    each = sizes.withColumn("s", F.explode(spec))
    last = F.greatest(F.ceil(F.col("tokens") / F.col("s.capacity")), F.lit(1)) - 1
    cut_up = each.select("s.*", "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return cut_up.select("spec_id", "doc_id", "piece", start.alias("start"), F.least(F.col("capacity"), F.col("tokens") - start).alias("tokens"))


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers of every item for every capacity.

    ``sizes`` has ``doc_id`` and ``tokens``; ``specs`` has ``spec_id`` and ``capacity_tokens``, a few
    rows; one without a positive capacity is left out. Columns: ``spec_id``, ``doc_id``, ``piece``,
    ``start`` and ``tokens`` of the piece within the text, and ``container``, from 0 in each spec.
    """
    schema = "spec_id int, doc_id bigint, piece bigint, start bigint, tokens bigint, container bigint"
    wanted = [(r.spec_id, r.capacity_tokens) for r in specs.filter("capacity_tokens > 0 and spec_id is not null").distinct().collect()]
    if not wanted:
        return sizes.sparkSession.createDataFrame([], schema)
    items = pieces(cut(sizes.select("doc_id", "tokens")), wanted)
    counts: dict[int, dict[int, int]] = {s: {} for s, _ in wanted}
    for r in items.groupBy("spec_id", "tokens").count().collect():  # at most the capacity's rows each
        counts[r.spec_id][r.tokens] = r["count"]
    plans = {s: plan(counts[s], c) for s, c in wanted}
    most = max((n for c in counts.values() for n in c.values()), default=0)
    keyed = items.select("*", F.xxhash64("doc_id", "piece").alias("_key"), F.lit(1).cast("bigint").alias("_one"))
    ranked = running(keyed, ["spec_id", "tokens"], "_key", "_one", ranges_for(most), ["doc_id", "piece"]).withColumnRenamed("before", "rank")
    return shipped(ranked).select("spec_id", "doc_id", "piece", "start", "tokens", "rank").mapInPandas(_place(plans), schema)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Of each capacity the number of containers, items and tokens, and the share of space used."""
    each = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum((F.col("piece") > 0).cast("int")).alias("p"))
    total = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    both = total.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id")
    return both.select("spec_id", "capacity_tokens", "containers", "items", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"))


def checks(packed: DataFrame, sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """What would break the rules, by capacity: ``spec_id``, ``capacity_tokens``, ``texts`` and four counts.

    ``lost``: tokens of texts in no container, or in two; ``split``: pieces of texts that are not above the
    capacity; ``overfull``: containers above it; ``crowded``: containers with more than two items above a third.
    """
    capacity = specs.select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    rows = packed.join(F.broadcast(capacity), "spec_id")
    each = rows.groupBy("spec_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"), F.count_if(3 * F.col("tokens") > F.col("capacity_tokens")).alias("large"))
    full = each.groupBy("spec_id", "capacity_tokens").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).cast("int").alias("overfull"), F.count_if(F.col("large") > 2).cast("int").alias("crowded"))
    texts = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"))
    placed = rows.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.min("capacity_tokens").alias("capacity"))
    met = texts.join(placed, "doc_id")
    text = met.groupBy("spec_id").agg(F.sum("n").alias("texts"), F.sum(F.abs(F.col("placed") - F.col("size"))).cast("int").alias("lost"), F.count_if((F.col("pieces") > F.col("n")) & (F.col("size") <= F.col("capacity"))).cast("int").alias("split"))
    return full.join(text, "spec_id").select("spec_id", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "texts", "lost", "split", "overfull", "crowded")
