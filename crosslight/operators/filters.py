"""Rows that are kept or not, and gates before a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def low_traffic(waits: Column, least: float = 0.1) -> Column:
    """Whether a sample has too little traffic: its saturations add up to less than `least`. A list that is missing, or
    has a phase without a number, adds up to 0, as if it could not be read."""
    one = lambda w: F.when(w["pred_saturation"].isNotNull() & ~F.isnan(w["pred_saturation"]), w["pred_saturation"])
    whole = F.when(F.forall(waits, lambda w: one(w).isNotNull()), F.aggregate(waits, F.lit(0.0), lambda a, w: a + one(w)))
    return F.coalesce(whole, F.lit(0.0)) < least


def below_quantile(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """The rows whose value is at most the exact quantile of all; nulls go. The quantile is one row."""
    return df.crossJoin(F.broadcast(df.agg(F.percentile(value, F.lit(q)).alias("__q")))).where(F.col(value) <= F.col("__q")).drop("__q")


def fits_half(length: Column, most: int) -> Column:
    """At most half of the longest sequence; a missing length fits not."""
    return F.coalesce(length <= most // 2, F.lit(False))


def having(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` whose key `right` has; each once."""
    return left.join(right.select(key), key, "left_semi")


def lacking(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` whose key `right` has not, null keys included."""
    return left.join(right.select(key), key, "left_anti")


def history_window(df: DataFrame, time: str, seconds: int, now: Column | None = None) -> DataFrame:
    """The rows of the last `seconds` before `now`, or before the latest row (an aggregate of one row)."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    if now is not None:
        return df.where(F.col(time) >= now - step)
    return df.crossJoin(F.broadcast(df.agg(F.max(time).alias("__now")))).where(F.col(time) >= F.col("__now") - step).drop("__now")


def retention(df: DataFrame, time: str, hours: int = 24, now: Column | None = None) -> DataFrame:
    """What the history keeps: the last `hours`."""
    return history_window(df, time, hours * 3600, now)


def select_named(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows of the named scenarios; a name that no row has raises."""
    have = {r[0] for r in df.where(F.col(column).isin(*names)).select(column).distinct().collect()}  # at most the names
    if missing := sorted(set(names) - have):
        raise ValueError(f"unknown: {', '.join(missing)}")
    return df.where(F.col(column).isin(*names))


def even_phases(df: DataFrame, index: str) -> DataFrame:
    """Green phases, which have the even indices."""
    return df.where(F.col(index) % 2 == 0)


def integrity_gates(counts: dict[str, DataFrame], least: int = 1000, weights: dict[str, float] | None = None) -> dict[str, int]:
    """Raises unless every table has at least `least` rows and the weights add up to 1 within .001; returns the counts,
    taken in one job."""
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, d in counts.items()]
    n = {r["k"]: r["n"] for r in reduce(DataFrame.union, parts).collect()} if parts else {}
    if few := sorted(k for k, v in n.items() if v < least):
        raise ValueError(f"fewer than {least} rows: {', '.join(few)}")
    if weights is not None and abs(sum(weights.values()) - 1) > 0.001:
        raise ValueError(f"weights add up to {sum(weights.values())}")
    return n
