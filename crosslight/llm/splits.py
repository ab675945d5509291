"""Problem 1: splits that keep related records together."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, cut, dense_in_groups, light_key, slices_for, small, state_key, state_light, uniform_hash

#: Target shares of the splits; they add up to 1.
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Bins that the differencing makes equal before whole bins go to splits.
BINS = 100


def keyed(samples: DataFrame) -> DataFrame:
    """rec_id with the keys of its light and state file. A null or blank light is taken from the state file's name; a
    record with neither is a group of its own (key `rec:<id>`)."""
    s = samples.select("rec_id", F.col("metadata.tl_id").alias("tl"), state_key(F.col("state_file")).alias("state"))
    own = light_key(F.col("tl"))
    named = state_light(F.col("state"))
    return s.select("rec_id", "state", F.when(own.isNotNull(), F.col("tl")).alias("spelled"), F.coalesce(own, named, F.col("state"), F.concat(F.lit("rec:"), F.col("rec_id").cast("string"))).alias("light"))


def _render(style: str, key: F.Column) -> F.Column:
    """`key` in a spelling style such as a_9: letters, separator, digits, letter case."""
    sep = style.strip("aA9") if style[:1] in "aA" and style[-1:] == "9" else "_"
    head, tail = F.regexp_extract(key, r"^([a-z]+)([0-9]+)$", 1), F.regexp_extract(key, r"^([a-z]+)([0-9]+)$", 2)
    head = F.upper(head) if style[:1] == "A" else head
    return F.when(head != "", F.concat(head, F.lit(sep), tail)).otherwise(key)


def majority_style(k: DataFrame) -> str:
    """The spelling style (case and separator) that most records use; ties go to the smaller style string."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("spelled", "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    top = k.where("spelled is not null").groupBy(shape.alias("s")).count().where(F.col("s").rlike("^[aA][^aA9]?9$")).orderBy(F.desc("count"), "s").first()
    return top["s"] if top else "a_9"


def related_groups(samples: DataFrame) -> DataFrame:
    """(rec_id, light, group_light): records related over lights and state files, spelled in any way.

    State files that several lights used link those lights; the graph has lights as nodes, so it is far smaller than
    the table. Repeated rows count as rows; null keys see `keyed`; an empty table gives no rows.
    """
    k = cut(keyed(samples))  # read four times
    style = majority_style(k)
    pairs = k.where("state is not null").select("state", "light").distinct()
    low = pairs.groupBy("state").agg(F.min("light").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    comp = connected_components(pairs.join(low, "state").where("light <> v").select(F.col("light").alias("u"), "v").distinct())
    named = comp.select(F.col("node").alias("light"), "root")
    best = named.groupBy("root").agg(F.min(_render(style, F.col("light"))).alias("g"))
    named = named.join(best, "root").select("light", "g")
    return k.join(named, "light", "left").select("rec_id", "light", F.coalesce("g", _render(style, F.col("light"))).alias("group_light"))


def balance(histogram: list[tuple[int, int]], bins: int) -> tuple[dict[int, tuple[int, list[int]]], np.ndarray]:
    """Largest differencing over items given as (weight, count). Returns for each weight the items each bin surely gets
    and the bins of the rest, and the bins' sums.

    Equal items are spread evenly; what is left of each weight is one partition of fewer than `bins` items. The two
    partitions with the largest spread are combined, heaviest slot with lightest, until one is left. Distinct weights
    of N records are at most sqrt(2N), which bounds the work and the memory.
    """
    base, heap, nodes = np.zeros(bins), [], []
    plan: dict[int, tuple[int, list[int]]] = {}
    for w, n in sorted(histogram):
        base += w * (n // bins)
        plan[w] = (n // bins, [])
        if r := n % bins:
            sums = np.zeros(bins)
            sums[:r] = w
            nodes.append(("leaf", w, r))
            heap.append((-w if r < bins else 0, len(nodes) - 1, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        pa, pb = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        nodes.append(("join", i, pa, j, pb))
        s = a[pa] + b[pb]
        heapq.heappush(heap, (-(s.max() - s.min()), len(nodes) - 1, s))
    total = base.copy()
    if heap:
        total += heap[0][2]
        stack = [(heap[0][1], np.arange(bins))]
        while stack:
            at, slot = stack.pop()
            if nodes[at][0] == "leaf":
                _, w, r = nodes[at]
                plan[w] = (plan[w][0], [int(x) for x in slot[:r]])
            else:
                _, i, pa, j, pb = nodes[at]
                sa, sb = np.empty_like(slot), np.empty_like(slot)
                sa[pa], sb[pb] = slot, slot
                stack += [(i, sa), (j, sb)]
    return plan, total


def allocate(sums: np.ndarray, proportions: dict[str, float]) -> list[str]:
    """The split of each bin: heaviest bins first, each to the split that lacks most of its target."""
    lack = {k: p * float(sums.sum()) for k, p in proportions.items()}
    out = [""] * len(sums)
    for b in np.argsort(-sums, kind="stable"):
        s = max(lack, key=lambda k: (lack[k], proportions[k]))
        out[int(b)] = s
        lack[s] -= float(sums[b])
    return out


def assign_splits(groups: DataFrame, proportions: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """(rec_id, group_light, split): whole groups to splits near `proportions`.

    Only the histogram of group sizes comes to the driver; groups learn their bin from their rank among groups of the
    same size, ranked in slices. A group larger than a split's share still goes whole to one split.
    """
    proportions = proportions or PROPORTIONS
    spark = groups.sparkSession
    sizes = cut(groups.groupBy("group_light").agg(F.count(F.lit(1)).alias("w")))
    histogram = [(r["w"], r["count"]) for r in sizes.groupBy("w").count().collect()]
    plan, sums = balance(histogram, bins)
    split = allocate(sums, proportions)
    names = list(proportions)
    rows = [(w, n * bins, bytes(names.index(split[b]) for b in rest).hex()) for w, (n, rest) in plan.items()]
    full = spark.createDataFrame(rows, "w bigint, full bigint, rest string")  # one row of each size, two characters a group
    by_bin, by_name = F.array(*[F.lit(x) for x in split]), F.array(*[F.lit(x) for x in names])
    of_rest = F.get(by_name, F.conv(F.substring("rest", (2 * (F.col("r") - F.col("full")) + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    ranked = dense_in_groups(sizes.withColumn("h", uniform_hash(F.col("group_light"))).withColumn("__id", F.col("group_light")), ["w"], "h", "r", slices_for(sum(n for _, n in histogram))).select("group_light", "w", "r")
    placed = ranked.join(small(full), "w").select("group_light", F.when(F.col("r") < F.col("full"), by_bin[(F.col("r") % bins).cast("int")]).otherwise(of_rest).alias("split"))
    return groups.select("rec_id", "group_light").join(small(placed), "group_light").select("rec_id", "group_light", "split")


def split_report(assigned: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(split, records, groups, share, target) of an assignment; splits without records do not appear."""
    proportions = proportions or PROPORTIONS
    g = assigned.groupBy("split", "group_light").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"))
    total = g.agg(F.sum("records").alias("t"))
    target = F.create_map(*[x for k, p in proportions.items() for x in (F.lit(k), F.lit(p))])
    return g.crossJoin(F.broadcast(total)).select("split", "records", "groups", (F.col("records") / F.col("t")).alias("share"), target[F.col("split")].alias("target"))
