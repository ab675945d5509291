"""Samples that are the same for a seed whatever the partitioning: hashes take the place of draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .joins import numbered


def order_key(seed: int, *cols: str) -> F.Column:
    return F.xxhash64(F.lit(seed), *cols)


def strata_quotas(df: DataFrame, strata: list[str], n: int, floor: bool = False) -> DataFrame:
    """(strata, size, quota): at least 1, else n times the stratum's share, rounded half to even (or down), at most all."""
    g = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    total = g.agg(F.sum("size").alias("total"))
    share = F.lit(n) * F.col("size") / F.col("total")
    want = F.floor(share) if floor else F.bround(share, 0)
    return g.crossJoin(F.broadcast(total)).select(*strata, "size", F.least(F.col("size"), F.greatest(F.lit(1), want)).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42, floor: bool = False) -> DataFrame:
    """Exactly n rows (all, if fewer): each stratum's quota by hash, then trimmed or topped up at random. Strata may grow
    with the data, so quotas meet their rows by a plain join that Spark may broadcast by size; the ranking by stratum
    keeps only the first n of each, and the final cut is a distributed top-k by (kept within quota, hash)."""
    q = strata_quotas(df, strata, n, floor)
    w = W.partitionBy(*strata).orderBy(order_key(seed, key), key)
    first = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    j = first.alias("a").join(q.select(*[F.col(c).alias(f"__{c}") for c in strata], "quota"), _same(strata))
    over = F.when(F.col("__rn") <= F.col("quota"), 0).otherwise(1)
    return j.orderBy(over, order_key(seed + 1, key), key).limit(n).select(*df.columns)


def _same(strata: list[str]) -> F.Column:
    out = F.lit(True)
    for c in strata:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"__{c}"))
    return out


def scenario_sample(df: DataFrame, scenario: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with each scenario's share cut down to whole rows, at least one, then filled or trimmed."""
    return stratified_sample(df, [scenario], key, n, seed, floor=True)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, key), key).limit(n)


def index_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn alike, in order of their key."""
    return uniform_sample(df, key, n, seed).orderBy(key)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, key), key)


def bootstrap_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, `draw` being their number: every draw picks a row number by hash and joins it. Rows are
    numbered by a range sort and the counts of its partitions; an empty table gives no rows."""
    rows = numbered(df, [key], "__row")
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(total)).where("__t > 0").select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("__t")).alias("__row"))
    return draws.join(rows, "__row").drop("__row")
