"""Augmented and synthetic samples from hashed columns, and records for training and teachers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timing import unit_random


#: The new ids of phases 0, 2, 4, ... in each remapping.
REMAPPED = [
    [1, 2, 3, 4, 5], [1, 2, 3], [2, 3, 4, 5, 6], [3, 4, 5, 6, 7], [1, 3, 5, 7, 9],
    [1, 3, 5], [3, 5, 7], [5, 6, 7, 8, 9], [10, 11, 12, 13, 14], [0, 1, 2, 3, 4],
]
#: The ids of a synthetic sample's phases.
PHASE_IDS = [
    [1, 2, 3, 4], [1, 2, 3], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6],
    [2, 3, 4, 5], [3, 4, 5, 6],
    [1, 3, 5], [1, 3, 5, 7], [1, 3],
    [0, 1, 2, 3], [1, 2, 4, 6], [0, 1, 3, 5],
    [2, 4, 6, 8], [1, 4, 7], [0, 3, 6],
    [0, 1, 2, 3], [0, 2, 4, 6],
    [1, 2], [3, 4], [1, 4], [2, 5],
    [0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6],
    [5, 6, 7, 8], [0, 2, 4], [0, 4, 6], [0, 4, 8], [0, 6, 8],
]


def whole_random(low: Column | int, high: Column | int, key: Column, salt: str) -> Column:
    """A whole number in [low, high], uniform and of its own for each key and salt."""
    low, high = (F.lit(c) if isinstance(c, int) else c for c in (low, high))
    return (low + F.floor(unit_random(key, F.lit(salt)) * (high - low + 1))).cast("int")


def mixture(key: Column, salt: str, weights: list[float], values: list[Column]) -> Column:
    """One of the values, chosen with the weights by a hash of key and salt, so that choices of different salts are
    independent; the last takes the rest."""
    u, out = unit_random(key, F.lit(salt)), values[-1]
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(u < sum(weights[: i + 1]), values[i]).otherwise(out)
    return out


def perturb_green(low: Column, high: Column, key: Column) -> Column:
    """(min_green, max_green) by one of four strategies (.3, .2, .2, .3): a raised minimum with a width of 15 to 60, a
    range of 5 to 15 either side of the middle, both drawn low, or each moved by up to 30 percent; at most 150."""
    pair = lambda a, b: F.struct(a.cast("int").alias("min_green"), b.cast("int").alias("max_green"))
    raised = whole_random(F.greatest(low, F.lit(20)), F.greatest(F.lit(60), low), key, "g1")
    half, middle = whole_random(5, 15, key, "g3"), F.floor((low + high) / 2)
    share = lambda salt: unit_random(key, F.lit(salt)) * 0.6 - 0.3
    moved = F.greatest(F.lit(5), low + (low * share("g6")).cast("int"))
    return mixture(key, "green", [0.3, 0.2, 0.2, 0.3], [
        pair(raised, F.least(raised + whole_random(15, 60, key, "g2"), F.lit(150))),
        pair(F.greatest(F.lit(5), middle - half), middle + half),
        pair(whole_random(5, 25, key, "g4"), whole_random(30, 55, key, "g5")),
        pair(moved, F.least(F.greatest(moved + 10, high + (high * share("g7")).cast("int")), F.lit(150))),
    ])


def perturb_saturation(sat: Column, key: Column) -> Column:
    """By one of three strategies (.2, .2, .6): anything up to 2, low for high and high for low within .2, or moved by up
    to .3; never below 0, to 4 digits."""
    shift = lambda salt, by: unit_random(key, F.lit(salt)) * (2 * by) - by
    return F.round(F.greatest(F.lit(0.0), mixture(key, "sat", [0.2, 0.2, 0.6], [unit_random(key, F.lit("s1")) * 2, 1 - sat + shift("s2", 0.2), sat + shift("s3", 0.3)])), 4)


def diversify(waits: Column, key: Column) -> Column:
    """Phases with ids remapped by one template for the sample (an even id up to 8 that the template has; others are
    raised by 1 to 5), perturbed green limits and saturation, capacity moved by -10 to 15 but at least 15, and the waiting
    that follows. Missing saturations count 0."""
    remap = F.get(F.array(*[F.array(*map(F.lit, r)) for r in REMAPPED]), whole_random(0, len(REMAPPED) - 1, key, "remap"))

    def one(w: Column, i: Column) -> Column:
        k = F.concat_ws("-", key.cast("string"), i.cast("string"))
        old = w["phase_id"]
        id_ = F.coalesce(F.when((old >= 0) & (old % 2 == 0), F.get(remap, (old / 2).cast("int"))), old + whole_random(1, 5, k, "id"))
        green, sat = perturb_green(w["min_green"], w["max_green"], k), perturb_saturation(F.coalesce(F.nanvl(w["pred_saturation"], F.lit(0.0)), F.lit(0.0)), k)
        cap = F.greatest(F.lit(15), w["capacity"] + whole_random(-10, 15, k, "cap"))
        return F.struct(id_.cast("int").alias("phase_id"), sat.alias("pred_saturation"), green["min_green"].alias("min_green"), green["max_green"].alias("max_green"), cap.cast("int").alias("capacity"), F.round(sat * cap, 2).alias("pred_wait"))

    return F.transform(waits, one)


def synthesize(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n synthetic samples (sample_id, tl_id, sim_time, date, cycle_count, as_of, phase_waits): ids by one of 28
    templates, limits and capacity uniform, saturation from four ranges (.25, .25, .3, .2), times of 366 days between 06
    and 22 o'clock."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    ids = F.get(F.array(*[F.array(*map(F.lit, r)) for r in PHASE_IDS]), whole_random(0, len(PHASE_IDS) - 1, key, "ids"))

    def one(p: Column, i: Column) -> Column:
        k = F.concat_ws("-", key.cast("string"), i.cast("string"))
        u = unit_random(k, F.lit("v"))
        sat = F.round(mixture(k, "range", [0.25, 0.25, 0.3, 0.2], [u * 0.2, 0.2 + u * 0.4, 0.6 + u * 0.4, 1.0 + u * 1.5]), 4)
        lo, cap = whole_random(5, 60, k, "lo"), whole_random(15, 60, k, "cap")
        hi = F.least(lo + whole_random(10, 80, k, "hi"), F.lit(150))
        return F.struct(p.alias("phase_id"), sat.alias("pred_saturation"), lo.alias("min_green"), hi.alias("max_green"), cap.alias("capacity"), F.round(sat * cap, 2).alias("pred_wait"))

    second = whole_random(6, 22, key, "h") * 3600 + whole_random(0, 59, key, "m") * 60 + whole_random(0, 59, key, "s")
    as_of = F.date_format(F.timestamp_seconds(F.lit(1767225600) + whole_random(0, 365, key, "day") * 86400 + second), "yyyy-MM-dd HH:mm:ss")
    base = spark.range(n).select(F.concat(F.lit("syn-"), F.col("id").cast("string")).alias("sample_id"), F.concat(F.lit("synthetic_"), whole_random(1, 200, key, "tl").cast("string")).alias("tl_id"), (unit_random(key, F.lit("sim")) * 86400).alias("sim_time"), whole_random(1, 100, key, "cycle").alias("cycle_count"), as_of.alias("as_of"), F.transform(ids, one).alias("phase_waits"))
    return base.withColumn("date", F.substring("as_of", 1, 10))


def union_all_sources(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, repeats kept; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def counterfactual_grid(phases: DataFrame, low: int = 20, high: int = 90, step: int = 10) -> DataFrame:
    """Every phase with every duration, by a generator in place of a join."""
    return phases.withColumn("duration", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))


def explode_phases(samples: DataFrame, id_: str, waits: str) -> DataFrame:
    return samples.select(id_, F.posexplode(waits).alias("pos", "w")).select(id_, "pos", "w.*")


def first_valid_attempt(attempts: DataFrame, id_: str = "id") -> DataFrame:
    """(id, status, attempt, content): the first valid answer; else api_error if a call failed before, else
    constraint_failed, with the last try. `attempts` has (id, attempt, content, valid, failed)."""
    g = attempts.groupBy(id_).agg(F.min(F.when(F.col("valid"), F.struct("attempt", "content"))).alias("ok"), F.min(F.when(F.col("failed"), F.col("attempt"))).alias("err"), F.max(F.struct("attempt", "content")).alias("last"))
    good = F.col("ok").isNotNull() & (F.col("err").isNull() | (F.col("err") > F.col("ok.attempt")))
    return g.select(id_, F.when(good, "success").when(F.col("err").isNotNull(), "api_error").otherwise("constraint_failed").alias("status"), F.when(good, F.col("ok.attempt")).otherwise(F.col("last.attempt")).alias("attempt"), F.when(good, F.col("ok.content")).otherwise(F.col("last.content")).alias("content"))


def assemble(results: DataFrame, system: str, drop_first_line: bool = False) -> DataFrame:
    """Records of three messages from successful results with a plan; others are skipped."""
    ok = status_success(F.col("status"), F.col("solution"))
    answer = F.concat(F.lit("<start_working_out>"), F.coalesce("think_text", F.lit("")), F.lit("<end_working_out><SOLUTION>"), F.to_json("solution"), F.lit("</SOLUTION>"))
    m = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    body = F.regexp_replace("prompt", r"^[^\n]*\n?", "") if drop_first_line else F.col("prompt")
    return results.where(ok).select(*[c for c in results.columns if c not in ("prompt", "think_text", "solution", "status")], F.array(m("system", F.lit(system)), m("user", body), m("assistant", answer)).alias("messages"))


def status_success(status: Column, solution: Column) -> Column:
    """No status or success, and a plan of at least one phase."""
    return (status.isNull() | (status == "success")) & F.coalesce(F.size(solution) > 0, F.lit(False))


def assembly_stats(joined: DataFrame, by: list[str]) -> DataFrame:
    """(total, constraint_violations, empty_thinks, mean_think) of rows (think, solution, phase_waits): a phase in the wrong
    place and a final outside its limits count one violation each, over the phases both have; the mean length counts
    empty reasoning as 0."""
    n = F.least(F.size("solution"), F.size("phase_waits"))
    pairs = F.zip_with(F.slice("solution", 1, F.greatest(n, F.lit(0))), F.slice("phase_waits", 1, F.greatest(n, F.lit(0))), lambda p, w: F.when(p["phase_id"].eqNullSafe(w["phase_id"]), 0).otherwise(1) + F.when(F.coalesce(p["final"].between(w["min_green"], w["max_green"]), F.lit(False)), 0).otherwise(1))
    bad = F.coalesce(F.aggregate(pairs, F.lit(0), lambda a, b: a + b), F.lit(0))
    think = F.coalesce("think", F.lit(""))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(bad).alias("constraint_violations"), F.count_if(~think.rlike(r"\S")).alias("empty_thinks"), F.avg(F.length(think)).alias("mean_think"))


def success_progress(results: DataFrame, by: list[str]) -> DataFrame:
    """(done, success, success_rate, mean_think) so far: the rate in percent of all rows, the mean reasoning of the
    successful ones (0 for none)."""
    ok = F.col("status") == "success"
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("done"), F.count_if(ok).alias("success"), F.sum(F.when(ok, F.coalesce("think_length", F.lit(0)))).alias("__t"))
    return g.select(*by, "done", "success", (F.col("success") * 100 / F.col("done")).alias("success_rate"), F.coalesce(F.try_divide("__t", "success"), F.lit(0.0)).alias("mean_think"))


def completed_ids(results: DataFrame, id_: str, status: str = "status", success_only: bool = False) -> DataFrame:
    """Ids that are done: with any status, or only the successful ones."""
    return (results.where(F.col(status) == "success") if success_only else results).where(F.col(id_).isNotNull()).select(id_).distinct()


def counterfactual_outcomes(grid: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """The grid's cases with what a trace says came of them; cases that were not run keep nulls."""
    return grid.join(outcomes, key, "left")
