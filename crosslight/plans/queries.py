"""The engine's own queries over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as x, timing as t
from ..operators import augment, filters, metrics, phases, sampling, traces, validation
from .registry import REGISTRY as REGISTRY, query, table


def phase_view(spark: SparkSession, d: str) -> DataFrame:
    """One sample per order, one phase per line item."""
    li = table(spark, d, "lineitem")
    lo = (5 + F.col("l_suppkey") % 20).cast("int")
    v = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("phase_id"), (F.col("l_quantity") / 40).alias("pred_saturation"), lo.alias("min_green"), (lo + 10 + F.col("l_partkey") % 60).cast("int").alias("max_green"))
    final = F.col("min_green") + (F.col("sample_id") + F.col("phase_id") * 7) % (F.col("max_green") - F.col("min_green") + 12)
    return v.withColumn("final", final.cast("bigint"))


def details(spark: SparkSession, d: str, run: bool = False) -> DataFrame:
    v = phase_view(spark, d)
    if run:
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("run"))
        v = v.join(o, "sample_id")
    return validation.phase_details(v)


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """The fact table by run; orders of status P count as badly formed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") != "P").alias("format_ok"))
    v = validation.phase_details(phase_view(spark, d).join(o, "sample_id"))
    return validation.status_details(v, ["run"], F.col("format_ok"))


@query
def weighted_metrics(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    m = metrics.weighted_metrics(li, ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber") - 1)
    return m.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("avg_queue", "avg_delay", "throughput")], "total_cycles", F.col("total_duration").cast("bigint").alias("total_duration"))


@query
def traffic_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.traffic_metrics(table(s, d, "lineitem"), ["l_returnflag"], {"queue": F.col("l_quantity"), "delay": F.col("l_extendedprice"), "passed": F.col("l_tax")})
    return m.select("l_returnflag", *[F.round(c, 4).alias(c) for c in m.columns[1:]])


@query
def llm_metrics(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    m = metrics.answer_metrics(e, ["event_type"], F.col("user_id") % 3 != 0, F.col("user_id") % 2 == 0, F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return m.select("event_type", *[F.round(c, 4).alias(c) for c in m.columns[1:-1]], "responses")


@query
def distribution_stats(s: SparkSession, d: str) -> DataFrame:
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("v"))
    r = metrics.filter_report(per, "v", F.col("v") >= 50)
    return r.select("part", "n", *[F.round(c, 4).alias(c) for c in ("min_v", "max_v", "mean_v", "median_v")])


@query
def reward_distribution(s: SparkSession, d: str) -> DataFrame:
    r = metrics.reward_distribution(table(s, d, "events"), ["event_type"], "value")
    return r.select("event_type", *[F.round(c, 4).alias(c) for c in r.columns[1:]])


@query
def reward_trend(s: SparkSession, d: str) -> DataFrame:
    r = metrics.reward_trend(table(s, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return r.select("event_type", F.col("segment").cast("bigint").alias("segment"), F.round("mean_v", 2).alias("mean_v"), "n")


@query
def zero_std_ratio(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.round(metrics.zero_std_ratio(F.when(F.col("event_id") % 7 != 0, F.col("value") / 1000)), 6).alias("ratio"))


@query
def distribution_quality(s: SparkSession, d: str) -> DataFrame:
    q = metrics.distribution_quality(table(s, d, "lineitem"), ["l_suppkey"], "l_discount")
    return q.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("std_v", "unique_share", "nonzero_share")], "passes")


@query
def target_green(s: SparkSession, d: str) -> DataFrame:
    return phase_view(s, d).select("sample_id", "phase_id", t.target_green(F.col("pred_saturation"), F.col("min_green"), F.col("max_green")).alias("target"), t.baseline_green(F.col("pred_saturation"), F.col("min_green"), F.col("max_green")).alias("baseline"))


@query
def proportional_solution(s: SparkSession, d: str) -> DataFrame:
    w = F.array_sort(F.collect_list(F.struct("phase_id", "pred_saturation", "min_green", "max_green")))
    g = phase_view(s, d).groupBy("sample_id").agg(w.alias("w"))
    return g.select("sample_id", F.explode(t.proportional_solution(F.col("w"))).alias("p")).select("sample_id", "p.phase_id", "p.final")


@query
def phase_deviation(s: SparkSession, d: str) -> DataFrame:
    return details(s, d).select("sample_id", "phase_id", "target_green", F.round("deviation", 6).alias("deviation"), "is_match", "is_clip", "in_range")


@query
def phase_sat_score(s: SparkSession, d: str) -> DataFrame:
    return details(s, d).select("sample_id", "phase_id", F.round(t.phase_sat_score(F.col("final"), F.col("target_green"), F.col("min_green"), F.col("max_green")), 6).alias("score"))


@query
def constraint_flags(s: SparkSession, d: str) -> DataFrame:
    return validation.sample_flags(details(s, d), [])


@query
def failure_buckets(s: SparkSession, d: str) -> DataFrame:
    return validation.failure_buckets(statuses(s, d), ["run"])


@query
def run_summary(s: SparkSession, d: str) -> DataFrame:
    v = validation.run_summary(details(s, d, True), ["run"])
    return v.select("run", "samples", *[F.round(c, 6).alias(c) for c in ("constraint_rate", "match_rate", "mean_dev", "median_dev", "max_dev")], "passes")


@query
def analysis_summary(s: SparkSession, d: str) -> DataFrame:
    return validation.analysis_summary(statuses(s, d), ["run"])


@query
def deviation_matrix(s: SparkSession, d: str) -> DataFrame:
    return validation.deviation_matrix(statuses(s, d), "run")


@query
def clip_summary(s: SparkSession, d: str) -> DataFrame:
    return validation.clip_summary(statuses(s, d), "run")


@query
def threshold_alignment(s: SparkSession, d: str) -> DataFrame:
    v = validation.threshold_alignment(statuses(s, d), "run")
    return v.select("run", "hard_fail", "hard_pass", F.round("near_share", 6).alias("near_share"), F.round("mean_closeness", 6).alias("mean_closeness"), "hard_fail_examples", "hard_pass_examples")


@query
def run_comparison(s: SparkSession, d: str) -> DataFrame:
    r = details(s, d, True).groupBy("run").agg(F.countDistinct("sample_id").alias("total_samples"), F.round(F.avg(F.col("is_match").cast("double")), 6).alias("match_rate"))
    return validation.run_comparison(r)


@query
def failure_examples(s: SparkSession, d: str) -> DataFrame:
    return validation.failure_examples(statuses(s, d), ["run"], 5)


@query
def length_quantile_filter(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("len"))
    return filters.below_quantile(docs, "len", 0.9)


@query
def stratified_quota(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "orders")
    return sampling.strata_quotas(v, ["o_orderpriority", "o_orderstatus"], 500)


@query
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Rows of each stratum in the sample; as quotas add up to at least 500, what is trimmed depends on hashes."""
    g = sampling.stratified_sample(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 500)
    q = sampling.strata_quotas(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], 500)
    n = g.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    off = q.agg(F.abs(F.sum("quota") - 500).alias("off"))
    j = q.join(n, ["o_orderpriority", "o_orderstatus"], "left").crossJoin(F.broadcast(off))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("quota")) <= F.col("off")
    return j.select("o_orderpriority", "o_orderstatus", "quota", near.alias("near_quota"), (F.coalesce("n", F.lit(0)) == F.coalesce("keys", F.lit(0))).alias("without_repeats"))


@query
def uniform_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.uniform_sample(table(s, d, "customer").select("c_custkey"), "c_custkey", 100).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query
def cycle_boundary(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    b = traces.cycle_boundaries(e, "user_id", ["ts", "event_id"], "event_type", "click")
    return b.select("user_id", "event_id", "is_boundary", "cycle_count")


@query
def phase_switch(s: SparkSession, d: str) -> DataFrame:
    return traces.phase_switches(table(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "prev", "event_type")


@query
def ring_buffer(s: SparkSession, d: str) -> DataFrame:
    return traces.last_points(table(s, d, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", F.col("rn").cast("bigint").alias("rn"))


@query
def dedupe_first(s: SparkSession, d: str) -> DataFrame:
    f = traces.first_rows(table(s, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    return f.where("value > 10").select("user_id", "event_id")


@query
def max_pressure(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "out").otherwise("in").alias("side"), "l_quantity")
    p = traces.phase_pressure(li, ["l_suppkey", "l_linenumber"], "side", "l_quantity").withColumn("pressure", F.round("pressure", 4))
    return traces.max_pressure(p, ["l_suppkey"], "pressure", "l_linenumber").select("l_suppkey", "l_linenumber", "pressure")


@query
def start_end_queue(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("step")).agg(F.sum("l_quantity").alias("queue"))
    return traces.start_end(q, ["l_suppkey"], "step", 2, "queue").select("l_suppkey", F.col("step").cast("bigint").alias("step"), "queue", "delta")


@query
def as_of_value(s: SparkSession, d: str) -> DataFrame:
    """Each view with the latest value of its user's purchases at or before it; all events of both kinds."""
    e = table(s, d, "events")
    l_, r = e.where("event_type = 'view'").select("user_id", "ts"), e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return traces.as_of(l_, r, "user_id", "ts", "value").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("value", 6).alias("value"))


@query
def baseline_semi(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return filters.having(table(s, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey")


@query
def resume_anti(s: SparkSession, d: str) -> DataFrame:
    done = augment.completed_ids(table(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return filters.lacking(table(s, d, "customer").select("c_custkey"), done, "c_custkey")


@query
def baseline_improvement(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    g = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).alias("n"))
    st = lambda p, q, z: F.struct(p.cast("double").alias("passed"), q.cast("double").alias("queue"), z.cast("double").alias("delay"))
    j = o.join(g, "o_custkey")
    return j.select("o_orderkey", F.round(t.improvement_score(st(F.col("n"), F.col("a"), F.col("a") / 2), st(F.col("n") + 1, F.col("o_totalprice"), F.col("o_totalprice") / 2)), 6).alias("score"))


@query
def counterfactual_grid(s: SparkSession, d: str) -> DataFrame:
    return augment.counterfactual_grid(table(s, d, "nation").select("n_nationkey")).select("n_nationkey", F.col("duration").cast("bigint").alias("duration"))


@query
def conflict_pairs(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("lane"))
    return phases.conflict_pairs(v, "l_orderkey", "l_linenumber", "lane")


@query
def greedy_mutex(s: SparkSession, d: str) -> DataFrame:
    """Lights whose choice tosses no coin, as coins cannot be drawn alike elsewhere."""
    v = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("tl_id"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").alias("phase_index"), F.array_distinct(F.array((F.col("l_suppkey") % 5).cast("string"), (F.col("l_partkey") % 5).cast("string"))).alias("green_lanes"))
    kept = phases.valid_lights(phases.greedy_mutex(v).where("not tossed"))
    return kept.select("tl_id", F.array_join("kept", ",").alias("kept"))


@query
def format_scores(s: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    return table(s, d, "api_responses").select("response_id", x.score_format_approx(c).alias("approx"), F.round(x.score_think_length(c), 6).alias("think"), x.score_format_exact(c).alias("exact"))


@query
def unwrap_response(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "api_responses").where("content is not null").select("response_id", F.length(x.unwrap_response(F.col("content"))).cast("bigint").alias("n"))


@query
def state_paths(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "train_samples").where("state_file is not null")
    return v.select("rec_id", x.rel_state_path(F.col("state_file")).alias("path"), x.sample_id(F.col("metadata.tl_id"), F.col("prediction.as_of")).alias("sample_id"))


@query
def saturation_buckets(s: SparkSession, d: str) -> DataFrame:
    g = phase_view(s, d).groupBy("sample_id").agg(F.avg("pred_saturation").alias("m")).select((F.col("sample_id") % 10).alias("light"), t.saturation_bucket(F.col("m")).alias("bucket"))
    return metrics.sampling_statistics(g, "light", "bucket").select("category", "n")


@query
def congestion(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    i = t.congestion_index(F.col("v") / 100, F.col("n"), F.lit(2), F.col("v"))
    return h.select("hour", F.round(i, 6).alias("idx"), t.congestion_level(F.round(i, 6)).alias("level"))


@query
def tumbling_windows(s: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    g = table(s, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "event_type", "n")


@query
def synthetic_samples(s: SparkSession, d: str) -> DataFrame:
    """Whether the synthetic phases keep their bounds, and how the saturation ranges are met, in twentieths."""
    v = augment.explode_phases(augment.synthesize(s, 20000), "sample_id", "phase_waits")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)) * 20, 0).alias
    p = F.col("pred_saturation")
    inside = F.min(F.col("min_green").between(5, 60) & F.col("max_green").between(15, 140) & (F.col("max_green") - F.col("min_green")).between(10, 80) & F.col("capacity").between(15, 60) & p.between(0, 2.5))
    return v.agg(F.countDistinct("sample_id").alias("samples"), inside.alias("inside"), share(p < 0.2)("lowest"), share((p >= 0.2) & (p < 0.6))("low"), share((p >= 0.6) & (p < 1.0))("high"), share(p >= 1.0)("above"))


@query
def diversified_samples(s: SparkSession, d: str) -> DataFrame:
    """Every variant's phases with what must hold for it: as many as the sample's, limits and capacity in bounds."""
    v = table(s, d, "train_samples").select("rec_id", F.col("prediction.phase_waits").alias("o"), augment.diversify(F.col("prediction.phase_waits"), F.col("rec_id")).alias("w"))
    ok = F.forall("w", lambda w: (w["min_green"] >= 5) & (w["max_green"] <= 150) & (w["min_green"] <= w["max_green"]) & (w["capacity"] >= 15) & (w["pred_saturation"] >= 0) & (F.abs(w["pred_wait"] - w["pred_saturation"] * w["capacity"]) <= 0.0051))
    return v.select("rec_id", F.size("w").cast("bigint").alias("n"), ok.alias("inside"))
