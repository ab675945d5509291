"""Joins by position, by scenario and with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..scratch import cut


def zip_by_index(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Rows of both with the same explicit index; raises where either has an index more than once or one that the other
    lacks. The check is one aggregation on the join's own partitioning."""
    tagged = a.select(index, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(index, F.lit(0), F.lit(1)))
    bad = tagged.groupBy(index).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.count_if((F.col("x") != 1) | (F.col("y") != 1)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} indices are not in both tables once")
    return a.join(b, index)


def answers_to_prompts(prompts: DataFrame, completions: DataFrame, id_: str) -> DataFrame:
    """Each completion with its prompt; a completion without one goes."""
    return completions.join(prompts, id_)


def tasks(scenarios: DataFrame, lights: DataFrame, scenario: str, light: str) -> DataFrame:
    """(scenario, light, task): every scenario with its own lights, numbered in order of scenario and light from 0. The
    numbers are those within a scenario plus the tasks of earlier scenarios, so no task sorts all rows."""
    pairs = scenarios.select(scenario).distinct().join(lights.select(scenario, light).distinct(), scenario)
    n = pairs.groupBy(scenario).agg(F.count(F.lit(1)).alias("__n"))
    before = n.select(F.col(scenario), F.coalesce(F.sum("__n").over(W.orderBy(scenario).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row of each scenario
    own = F.row_number().over(W.partitionBy(scenario).orderBy(light)) - 1
    return pairs.withColumn("__i", own).join(before, scenario).select(scenario, light, (F.col("__i") + F.col("__b")).cast("bigint").alias("task"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds numbers from 0 in the order of the (unique) columns: a range sort, the counts of its partitions on the driver,
    and each row's place in its partition; no window over all rows. The sorted rows are written once, as a range sort
    need not fall alike twice."""
    d = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    d = cut(d.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1))
    sizes = {r["__p"]: r["count"] for r in d.groupBy("__p").count().collect()}
    start, total = [], 0
    for p in sorted(sizes):
        start.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(start, "__p int, __b bigint")
    return d.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def results_with_cycles(results: DataFrame, cycles: DataFrame, key: list[str]) -> DataFrame:
    """Results with the data of their cycle by scenario, light and cycle; a result without one keeps nulls."""
    return results.join(cycles, key, "left")


def with_fallback(parsed: DataFrame, defaults: DataFrame, key: str, plan: str, default: str) -> DataFrame:
    """Each row's parsed plan or, where it has none, its light's default one; `used_default` tells which."""
    j = parsed.join(defaults.select(key, default), key, "left")
    return j.withColumn("used_default", F.col(plan).isNull() & F.col(default).isNotNull()).withColumn(plan, F.coalesce(plan, default)).drop(default)


def merged_in_order(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all scenarios with their place in the given order, in `scenario` and `place`; a writer that sorts by
    place has them one after the other."""
    out = None
    for i, (name, d) in enumerate(parts.items()):
        one = d.withColumn("scenario", F.lit(name)).withColumn("place", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def with_baseline(samples: DataFrame, baseline: DataFrame, key: str = "state_file") -> DataFrame:
    """Each sample with `base`, the struct of its baseline's columns, null where there is none (a score then raises)."""
    b = baseline.select(F.col(key), F.struct(*[c for c in baseline.columns if c != key]).alias("base"))
    return samples.join(b, key, "left")
