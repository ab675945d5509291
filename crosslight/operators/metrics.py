"""Weighted, distribution and run metrics. Every function takes a DataFrame and group columns and returns aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as x


def weighted_average(v: Column, w: Column) -> Column:
    """Sum of v*w over sum of w, rows of weight above 0 only; 0 when there are none."""
    on = w > 0
    return F.coalesce(F.try_divide(F.sum(F.when(on, v * w)), F.sum(F.when(on, w))), F.lit(0.0))


def throughput(passed: Column, duration: Column) -> Column:
    return F.when(duration > 0, passed / duration).otherwise(0.0)


def weighted_metrics(cycles: DataFrame, by: list[str], queue: Column, delay: Column, passed: Column, duration: Column) -> DataFrame:
    """Duration-weighted queue and delay, throughput, and counts: all cycles, and the seconds of those with samples."""
    d = F.when(duration > 0, duration)
    return cycles.groupBy(*by).agg(weighted_average(queue, duration).alias("avg_queue"), weighted_average(delay, duration).alias("avg_delay"), F.coalesce(F.try_divide(F.sum(F.when(duration > 0, passed)), F.sum(d)), F.lit(0.0)).alias("throughput"), F.count(F.lit(1)).alias("total_cycles"), F.coalesce(F.sum(d), F.lit(0)).alias("total_duration"))


def spread(c: Column, name: str) -> list[Column]:
    """Mean, max, min and sample deviation (0 for one value)."""
    return [F.avg(c).alias(f"avg_{name}"), F.max(c).alias(f"max_{name}"), F.min(c).alias(f"min_{name}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{name}")]


def traffic_metrics(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[x for n, c in measures.items() for x in spread(c, n)])


def answer_metrics(df: DataFrame, by: list[str], format_ok: Column, constraint_ok: Column, response: Column) -> DataFrame:
    """Rates and response times; missing times are left out. The order rate is the format rate."""
    rate = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(rate(format_ok).alias("format_rate"), rate(constraint_ok).alias("constraint_rate"), rate(format_ok).alias("order_rate"), *spread(response, "response"), F.count(response).alias("responses"))


def distribution_stats(c: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.coalesce(F.min(c), zero).alias("min_v"), F.coalesce(F.max(c), zero).alias("max_v"), F.coalesce(F.avg(c), zero).alias("mean_v"), F.coalesce(F.median(c), zero).alias("median_v")]


def filter_report(df: DataFrame, value: str, keep: Column) -> DataFrame:
    """Counts and distribution of all, kept and rejected rows in one pass of grouping sets; part is all, kept or rejected."""
    d = df.select(F.col(value).alias("v"), keep.alias("keep"))
    g = d.cube("keep").agg(F.grouping("keep").alias("g"), F.count(F.lit(1)).alias("n"), *distribution_stats(F.col("v")))
    part = F.when(F.col("g") == 1, "all").when(F.col("keep"), "kept").otherwise("rejected")
    return g.select(part.alias("part"), "n", "min_v", "max_v", "mean_v", "median_v")


def reward_distribution(df: DataFrame, by: list[str], c: str) -> DataFrame:
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    return df.groupBy(*by).agg(F.avg(c).alias("mean_v"), F.stddev_pop(c).alias("std_v"), F.min(c).alias("min_v"), F.max(c).alias("max_v"), *[F.percentile(c, F.lit(p)).alias(f"p{int(p * 100)}") for p in q])


def zero_std_ratio(c: Column) -> Column:
    """Share of steps whose deviation is below .01; a missing one counts as 1."""
    return F.avg(F.when(F.coalesce(c, F.lit(1.0)) < 0.01, 1.0).otherwise(0.0))


def reward_trend(df: DataFrame, by: list[str], order: list[str], value: str, segments: int = 10) -> DataFrame:
    """Mean of each of `segments` stretches of equal length in order; the last takes the rest, fewer rows make fewer."""
    w = W.partitionBy(*by)
    d = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    seg = F.least(F.floor((F.col("rn") - 1) / F.greatest(F.floor(F.col("n") / segments), F.lit(1))), F.lit(segments - 1))
    return d.groupBy(*by, seg.alias("segment")).agg(F.avg(value).alias("mean_v"), F.count(F.lit(1)).alias("n"))


def distribution_quality(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Whether values spread: deviation of .5, 30 % of them distinct, half not zero."""
    g = df.groupBy(*by).agg(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_v"), (F.countDistinct(c) / F.count(c)).alias("unique_share"), F.avg(F.when(F.col(c) != 0, 1.0).otherwise(0.0)).alias("nonzero_share"))
    return g.withColumn("passes", (F.col("std_v") >= 0.5) & (F.col("unique_share") >= 0.3) & (F.col("nonzero_share") >= 0.5))


def sampling_statistics(df: DataFrame, light: str, bucket: str) -> DataFrame:
    """(dimension, category, n): records of each light and of each bucket, in one pass of grouping sets; records without
    one do not count in its dimension."""
    g = df.groupingSets([(light,), (bucket,)], light, bucket).agg(F.grouping(light).alias("__g"), F.count(F.lit(1)).alias("n"))
    r = g.select(F.when(F.col("__g") == 0, "tl_id").otherwise("bucket").alias("dimension"), F.when(F.col("__g") == 0, F.col(light).cast("string")).otherwise(F.col(bucket)).alias("category"), "n")
    return r.where("category is not null")


def phase_id_histogram(df: DataFrame, text: str) -> DataFrame:
    """(phase_id, n): how often each id stands in the texts' JSON."""
    v = df.select(F.explode(F.regexp_extract_all(text, F.lit('"phase_id": ([0-9]+)'), F.lit(1))).alias("p"))
    return v.groupBy(F.col("p").cast("bigint").alias("phase_id")).agg(F.count(F.lit(1)).alias("n"))


def scenario_counts(paths: DataFrame, path: str) -> DataFrame:
    """(scenario, n, converted, fallback): samples of each scenario, and how many of their state files could be made
    relative."""
    p = F.coalesce(F.col(path), F.lit(""))
    ok = x.rel_state_path(p).startswith("outputs/")
    return paths.groupBy(x.scenario_label(p).alias("scenario")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("converted"), F.count_if(~ok).alias("fallback"))


def by_delay(df: DataFrame, delay: str, name: str) -> DataFrame:
    """Rows in order of their delay, those without a number last, ties by name: a range sort."""
    key = F.coalesce(F.expr(f"try_cast(`{delay}` as double)"), F.lit(float("inf")))
    return df.orderBy(key, name)


SUMMARY = ("passed_vehicles", "queue_vehicles", "total_delay")


def model_summary(cycles: DataFrame, by: list[str]) -> DataFrame:
    """The 22 columns of a model's summary (two of `by` among them): rates and response times of its answers, spread of
    passed and queued vehicles and delay, and the throughput over all seconds (`samples` holds one value a second). All
    models are one aggregation."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    four = lambda c: [F.coalesce(f(c), F.lit(0)).cast("double").alias(f"{c}_{n}") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_samp))]
    seconds = F.sum(F.when(F.size("samples") > 0, F.size("samples")))
    passed = F.sum(F.when(F.size("samples") > 0, F.col("passed_vehicles")))
    d = cycles.withColumnRenamed("llm_response_time", "response_time")
    return d.groupBy(*by).agg(rate("format_success").alias("format_success_rate"), rate("constraint_satisfied").alias("constraint_satisfaction_rate"), rate("format_success").alias("phase_order_correct_rate"), *four("response_time"), *[c for m in SUMMARY for c in four(m)], F.coalesce(F.try_divide(passed, seconds), F.lit(0.0)).alias("throughput"))
