"""Phase details of scored plans, failure buckets and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import plans, text as x, timing as t

FAILED = ("format_failure", "constraint_failure")


def phase_details(phases: DataFrame) -> DataFrame:
    """Adds target, deviation, match flag, clip flag (the target lies on a limit) and range flag to (sample_id, phase_id,
    pred_saturation, min_green, max_green, final); a missing final leaves deviation and match null and is out of range."""
    sat = plans.saturation_of(F.struct("pred_saturation"))
    raw = t.half_even(F.col("max_green") * F.greatest(F.lit(0.0), sat))
    d = phases.withColumn("raw_target", raw).withColumn("target_green", t.target_green(sat, F.col("min_green"), F.col("max_green")))
    d = d.withColumn("deviation", t.deviation(F.col("final"), F.col("target_green"), F.col("min_green"), F.col("max_green")))
    on_limit = (F.col("target_green") == F.col("min_green")) | (F.col("target_green") == F.col("max_green"))
    return d.withColumn("is_match", F.col("deviation") <= 0.1).withColumn("is_clip", on_limit).withColumn("in_range", F.coalesce(F.col("final").between(F.col("min_green"), F.col("max_green")), F.lit(False)))


def status_details(details: DataFrame, by: list[str], format_ok: Column | None = None) -> DataFrame:
    """The fact table of the reports: details with constraint_status and failure_bucket. A sample that fails the format
    (`format_ok` false in any row) or a constraint (a phase out of range) is reduced to the detail of its first phase;
    the phases of others are saturation matches or mismatches. One shuffle by sample: its few phases are folded as an
    array. A failed detail's missing deviation is no match."""
    own = [c for c in details.columns if c not in (*by, "sample_id")]
    d = details.withColumn("__f", F.coalesce(format_ok, F.lit(False)) if format_ok is not None else F.lit(True))
    g = d.groupBy(*by, "sample_id").agg(F.array_sort(F.collect_list(F.struct("phase_id", *[c for c in own if c != "phase_id"]))).alias("ps"), F.min("__f").alias("f"), F.min("in_range").alias("ok"))
    bad = F.when(~F.col("f"), FAILED[0]).when(~F.col("ok"), FAILED[1])
    e = g.select(*by, "sample_id", bad.alias("bad"), F.explode(F.when(bad.isNotNull(), F.slice("ps", 1, 1)).otherwise(F.col("ps"))).alias("p")).select(*by, "sample_id", "p.*", "bad")
    e = e.withColumn("is_match", F.coalesce("is_match", F.lit(False)))
    bucket = F.coalesce("bad", F.when(F.col("is_match"), "saturation_match").otherwise("saturation_mismatch"))
    return e.withColumn("constraint_status", F.coalesce("bad", F.lit("constraint_pass"))).withColumn("failure_bucket", bucket).drop("bad")


def checked(samples: DataFrame, answer: str, waits: str) -> DataFrame:
    """Adds `elems`, `fmt` and `cst` flags and `details` (null where they cannot be computed) of each answer; the plan is
    parsed once. Null answers count as empty."""
    a = F.coalesce(F.col(answer), F.lit(""))
    d = samples.withColumn("elems", plans.elements(x.solution_text(a))).withColumn("fmt", plans.format_flags(a))
    return d.withColumn("cst", plans.constraint_flags(F.col("elems"), F.col(waits))).withColumn("details", plans.phase_details(F.col("elems"), F.col(waits)))


def answer_details(samples: DataFrame, sample_id: str, waits: str) -> DataFrame:
    """The same fact table from `checked` answers: a failed one gives one detail, of its first phase with what its plan
    says of it (the last element of that id); one without phases gives a detail without phase."""
    bad = F.when(~F.col("fmt.all_pass"), FAILED[0]).when(~F.col("cst.all_pass") | F.col("details").isNull(), FAILED[1])
    w = F.get(F.col(waits), 0)
    own = F.try_element_at(F.reverse(F.filter("elems", lambda p: p["phase_id"] == w["phase_id"])), F.lit(1))
    raw, sat = t.half_even(w["max_green"] * F.greatest(F.lit(0.0), plans.saturation_of(w))), F.when(w.isNotNull(), plans.saturation_of(w))
    target = t.target_green(plans.saturation_of(w), w["min_green"], w["max_green"])
    dev = t.deviation(own["final"], target, w["min_green"], w["max_green"])
    first = F.struct(w["phase_id"].alias("phase_id"), sat.alias("pred_saturation"), w["min_green"].alias("min_green"), w["max_green"].alias("max_green"), raw.alias("raw_target"), target.alias("target_green"), own["final"].alias("final"), dev.alias("deviation"), F.coalesce(dev <= 0.1, F.lit(False)).alias("is_match"), F.coalesce(target.isin(w["min_green"], w["max_green"]), F.lit(False)).alias("is_clip"))
    e = samples.select(F.col(sample_id).alias("sample_id"), bad.alias("bad"), F.posexplode(F.when(bad.isNotNull(), F.array(first)).otherwise(F.col("details"))).alias("pos", "p")).select("sample_id", "pos", "p.*", "bad")
    bucket = F.coalesce("bad", F.when(F.col("is_match"), "saturation_match").otherwise("saturation_mismatch"))
    return e.withColumn("constraint_status", F.coalesce("bad", F.lit("constraint_pass"))).withColumn("failure_bucket", bucket).drop("bad")


def exclude_failures(details: DataFrame) -> DataFrame:
    return details.where(~F.col("failure_bucket").isin(*FAILED))


def sample_flags(details: DataFrame, by: list[str]) -> DataFrame:
    """One row per sample: phases, those in range, and whether all are."""
    return details.groupBy(*by, "sample_id").agg(F.count(F.lit(1)).alias("phases"), F.sum(F.col("in_range").cast("int")).alias("in_range"), F.min(F.col("in_range")).alias("constraint_ok"))


def failure_buckets(details: DataFrame, by: list[str]) -> DataFrame:
    """From `status_details` or `answer_details`: format and constraint failures, which count samples, and saturation
    matches and mismatches, which count phases. One aggregation, as a failed sample has one detail."""
    b = F.col("failure_bucket")
    return details.groupBy(*by).agg(*[F.count_if(b == n).alias(n) for n in (*FAILED, "saturation_mismatch", "saturation_match")])


def validation_summary(checks: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """From `checked` answers: totals, rates and counts of format and constraint checks, statistics of the deviations of
    all answers that have them (constraint failures included), `evaluable` answers (those that also pass), and whether
    both rates reach `least`. Two levels, answers and then phases, of one aggregation each."""
    flag = lambda c: F.count_if(F.col(c))
    s = checks.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), flag("fmt.all_pass").alias("format_pass"), flag("cst.all_pass").alias("constraint_pass"), flag("cst.order_ok").alias("order_pass"), flag("cst.whole_ok").alias("integer_pass"), flag("cst.range_ok").alias("range_pass"), F.count_if(F.col("cst.all_pass") & F.col("details").isNotNull()).alias("evaluable"))
    p = checks.select(*by, F.explode("details").alias("p")).groupBy(*by).agg(F.avg(F.col("p.is_match").cast("double")).alias("match_rate"), F.avg("p.deviation").alias("mean_dev"), F.median("p.deviation").alias("median_dev"), F.max("p.deviation").alias("max_dev"))
    j = s.join(p, by, "left") if by else s.crossJoin(p)
    j = j.withColumn("match_rate", F.coalesce("match_rate", F.lit(0.0))).withColumn("format_rate", F.try_divide("format_pass", "samples")).withColumn("constraint_rate", F.try_divide("constraint_pass", "samples"))
    return j.withColumn("passes", (F.col("format_rate") >= least) & (F.col("constraint_rate") >= least))


def run_summary(details: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """The same rates from phase rows of samples whose format is fine."""
    s = sample_flags(details, by).groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("constraint_ok").cast("double")).alias("constraint_rate"))
    p = details.groupBy(*by).agg(F.avg(F.col("is_match").cast("double")).alias("match_rate"), F.avg("deviation").alias("mean_dev"), F.median("deviation").alias("median_dev"), F.max("deviation").alias("max_dev"))
    return s.join(p, by).withColumn("passes", F.col("constraint_rate") >= least)


def analysis_summary(details: DataFrame, by: list[str]) -> DataFrame:
    """Of all details, failed ones included: deviations near the threshold, clip flags, and those that match."""
    d = F.col("deviation")
    return details.groupBy(*by).agg(F.count_if((d >= 0.08) & (d <= 0.15)).alias("near_threshold"), F.count_if("is_clip").alias("clip"), F.count_if(F.col("is_clip") & F.col("is_match")).alias("clip_match"))


def run_comparison(runs: DataFrame) -> DataFrame:
    """(run, total_samples, match_rate) with the difference to the smallest run, to 2 digits; ties by name. The smallest
    run is an aggregate of one row, so no window takes all runs into one task."""
    first = runs.agg(F.min_by("match_rate", F.struct("total_samples", "run")).alias("__first"))
    return runs.crossJoin(F.broadcast(first)).withColumn("delta", F.round(F.col("match_rate") - F.col("__first"), 2)).drop("__first")


def check_runs(runs: DataFrame) -> DataFrame:
    """Raises unless all runs share a sample_mode and each manifest has its run's size."""
    bad = runs.agg(F.countDistinct("sample_mode").alias("modes"), F.count_if(~F.col("manifest_size").eqNullSafe(F.col("total_samples"))).alias("off")).first()
    if bad["modes"] > 1:
        raise ValueError("runs differ in sample_mode")
    if bad["off"]:
        raise ValueError("manifest_size differs from total_samples")
    return runs


def deviation_matrix(details: DataFrame, run: str) -> DataFrame:
    """By run, of the details of samples that did not fail: those in each deviation bucket, and in each saturation bucket
    how many there are, match and do not. Details without a deviation do not count."""
    d = exclude_failures(details).where("deviation is not null")
    b, p = t.deviation_bucket(F.col("deviation")), t.pred_bucket(F.coalesce("pred_saturation", F.lit(0.0)))
    cols = [F.count_if(b == n).alias(n) for n in ("match", "near_miss", "large")]
    cols += [F.count_if(p == n).alias(f"{n}_total") for n in ("low", "mid", "high")] + [F.count_if((p == n) & F.col("is_match")).alias(f"{n}_match") for n in ("low", "mid", "high")] + [F.count_if((p == n) & ~F.col("is_match")).alias(f"{n}_mismatch") for n in ("low", "mid", "high")]
    return d.groupBy(run).agg(*cols)


def clip_summary(details: DataFrame, run: str) -> DataFrame:
    """By run, of the details of samples that did not fail: clip flags, and those that do not match."""
    d = exclude_failures(details).where("deviation is not null")
    return d.groupBy(run).agg(F.count_if("is_clip").alias("clip"), F.count_if(F.col("is_clip") & ~F.col("is_match")).alias("clip_mismatch"))


def threshold_alignment(details: DataFrame, run: str, k: int = 5) -> DataFrame:
    """By run, of the details of samples that did not fail: cases in which the score's closeness and the match disagree,
    with the first k of each as sample-phase, and the mean closeness. The share near the threshold is of all of them,
    those without a deviation included."""
    d = exclude_failures(details).withColumn("c", t.closeness(F.col("deviation")))
    dev, c = F.col("deviation"), F.col("c")
    fail, passed = F.coalesce((c > 0.8) & ~F.col("is_match"), F.lit(False)), F.coalesce((c < 0.5) & F.col("is_match"), F.lit(False))
    g = d.groupBy(run).agg(F.count_if(fail).alias("hard_fail"), F.count_if(passed).alias("hard_pass"), (F.count_if((dev >= 0.05) & (dev <= 0.2)) / F.count(F.lit(1))).alias("near_share"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_closeness"))
    for name, keep in (("hard_fail_examples", fail), ("hard_pass_examples", passed)):
        g = g.join(first_examples(d.where(keep), [run], k).withColumnRenamed("examples", name), run, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return g


def first_examples(details: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The first k details of each group in order of sample and phase, as sample-phase; ranked before they are gathered,
    which Spark does with a limit in each partition first."""
    w = W.partitionBy(*by).orderBy("sample_id", "phase_id")
    d = details.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return d.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample_id", "phase_id"))), lambda y: F.concat_ws("-", y["sample_id"], y["phase_id"])), ",").alias("examples"))


def failure_examples(details: DataFrame, by: list[str], k: int | None = 5) -> DataFrame:
    """(by, category, sample_id, phase_id, deviation): examples of each of five categories, the first k of each in order
    of sample and phase (all without k), repeats by deviation. A detail can be of several; failed samples are examples of their failure only,
    without deviation."""
    b, ok = F.col("failure_bucket"), ~F.col("failure_bucket").isin(*FAILED)
    cats = [(FAILED[0], b == FAILED[0]), (FAILED[1], b == FAILED[1]), ("saturation_mismatch", b == "saturation_mismatch"), ("large_deviation", ok & (F.col("deviation") > 0.1)), ("clip_sensitive", ok & F.col("is_clip"))]
    e = details.withColumn("category", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in cats]), lambda n: n.isNotNull())))
    e = e.withColumn("deviation", F.when(ok, F.round("deviation", 4)))
    if k is not None:
        e = e.withColumn("rn", F.row_number().over(W.partitionBy(*by, "category").orderBy("sample_id", "phase_id", "deviation"))).where(F.col("rn") <= k)
    return e.select(*by, "category", "sample_id", "phase_id", F.when(ok, F.col("deviation")).alias("deviation"))
