"""Operators on phase and lane traces: cycles, switches, pressure, queues, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import timing as t


def cycle_boundaries(steps: DataFrame, key: str, order: list[str], phase: str, first_green: int | str) -> DataFrame:
    """Adds prev, is_boundary (the phase becomes the first green one) and the running cycle_count."""
    w = W.partitionBy(key).orderBy(*order)
    d = steps.withColumn("prev", F.lag(phase).over(w))
    is_b = F.coalesce((F.col("prev") != first_green) & (F.col(phase) == first_green), F.lit(False)).cast("int")
    return d.withColumn("is_boundary", is_b).withColumn("cycle_count", F.sum("is_boundary").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def phase_switches(steps: DataFrame, key: str, order: list[str], phase: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return steps.withColumn("prev", F.lag(phase).over(w)).where(F.col("prev") != F.col(phase))


def last_points(df: DataFrame, by: list[str], order: list[str], k: int = 20) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; later steps that drop unusable rows come after, so one that cannot be used still blocks
    the others."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def max_pressure(phases: DataFrame, by: list[str], pressure: str, index: str) -> DataFrame:
    """The phase of largest pressure, the first of equal ones."""
    w = W.partitionBy(*by).orderBy(F.col(pressure).desc(), index)
    return phases.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def phase_pressure(lanes: DataFrame, by: list[str], side: str, halting: str) -> DataFrame:
    """Halting on incoming lanes together less the mean on outgoing ones; a side without lanes counts 0."""
    z = F.lit(0.0)
    return lanes.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col(side) == "in", F.col(halting))), z) - F.coalesce(F.avg(F.when(F.col(side) == "out", F.col(halting))), z)).alias("pressure"))


def phase_lane_queue(phases: DataFrame, lane_steps: DataFrame, step: str = "step") -> DataFrame:
    """(tl_id, phase_index, step, queue, lanes): halting on the green lanes of each phase at each step; a lane without a
    row adds nothing, a phase none of whose lanes has one gives no row."""
    e = phases.select("tl_id", "phase_index", F.explode(F.array_distinct("green_lanes")).alias("lane_id"))
    return e.join(lane_steps.select("tl_id", "lane_id", step, "halting"), ["tl_id", "lane_id"]).groupBy("tl_id", "phase_index", step).agg(F.sum("halting").alias("queue"), F.count(F.lit(1)).alias("lanes"))


def vehicles_left(lane_steps: DataFrame, by: list[str], step: str = "step", vehicle: str = "vehicle_id") -> DataFrame:
    """(by, passed): vehicles seen at the first step of each group and not at its last, from one row for each vehicle and
    step. First and last come from an aggregate without vehicles; only their rows are compared, as counts by vehicle, so
    no set is ever gathered. A group of one step has 0."""
    ends = lane_steps.groupBy(*by).agg(F.min(step).alias("__a"), F.max(step).alias("__z"))
    at = lane_steps.join(ends, by).where((F.col(step) == F.col("__a")) | (F.col(step) == F.col("__z")))
    v = at.where(F.col(vehicle).isNotNull()).groupBy(*by, vehicle).agg(F.max(F.col(step) == F.col("__a")).alias("a"), F.max(F.col(step) == F.col("__z")).alias("z"))
    n = v.groupBy(*by).agg(F.count_if(F.col("a") & ~F.col("z")).alias("passed"))
    return ends.join(n, by, "left").select(*by, F.coalesce("passed", F.lit(0)).alias("passed"))


def cycle_metrics(lane_steps: DataFrame, by: list[str]) -> DataFrame:
    """From (by, step, lane_id, halting, waiting, vehicle_ids): vehicles that left between first and last step, the mean
    of the summed queue, the summed waiting time and the seconds. A cycle's steps are added up before cycles are; of the
    vehicles only those of the first and last step are looked at."""
    flow = lane_steps.groupBy(*by, "step").agg(F.sum("halting").alias("q"), F.sum("waiting").alias("wt"))
    g = flow.groupBy(*by).agg(F.avg("q").alias("avg_queue"), F.sum("wt").alias("total_delay"), F.count(F.lit(1)).alias("duration"))
    left = vehicles_left(lane_steps.select(*by, "step", F.explode_outer("vehicle_ids").alias("vehicle_id")), by)
    return g.join(left, by).select(*by, "passed", "avg_queue", "total_delay", "duration")


def plan_outcome(lane_steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, passed, queue, delay) of steps tagged by their plan: vehicles that left, the queue at the last step and the
    waiting summed over all steps."""
    flow = lane_steps.groupBy(*by, "step").agg(F.sum("halting").alias("q"), F.sum("waiting").alias("wt"))
    g = flow.groupBy(*by).agg(F.max_by("q", "step").alias("queue"), F.sum("wt").alias("delay"))
    left = vehicles_left(lane_steps.select(*by, "step", F.explode_outer("vehicle_ids").alias("vehicle_id")), by)
    return g.join(left, by).select(*by, "passed", "queue", "delay")


def junction_counts(vehicles: DataFrame, lanes: DataFrame, by: list[str]) -> DataFrame:
    """(by, vehicle_count, mean_speed, halting_count, waiting_time) for each direction: `vehicles` has a row (speed,
    waiting) of each vehicle, `lanes` the halting of each lane. Means are over vehicles, 0 for none; directions come from
    either."""
    v = vehicles.groupBy(*by).agg(F.count(F.lit(1)).alias("vehicle_count"), F.avg("speed").alias("mean_speed"), F.avg("waiting").alias("waiting_time"))
    h = lanes.groupBy(*by).agg(F.sum("halting").alias("halting_count"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return h.join(v, by, "full").select(*by, z("vehicle_count"), F.coalesce("mean_speed", F.lit(0.0)).alias("mean_speed"), z("halting_count"), F.coalesce("waiting_time", F.lit(0.0)).alias("waiting_time"))


def phase_traffic(phases: DataFrame, lanes: DataFrame) -> DataFrame:
    """(tl_id, phase_index, queue, passed): halting and moving vehicles of a phase's lanes by lane, to two digits; lanes
    without a row count in the number of lanes, a phase without lanes has 0."""
    e = phases.select("tl_id", "phase_index", F.size("green_lanes").alias("n"), F.explode_outer("green_lanes").alias("lane_id"))
    j = e.join(lanes.select("tl_id", "lane_id", "halting", "vehicles"), ["tl_id", "lane_id"], "left")
    n = F.greatest(F.max("n"), F.lit(1))
    moving = F.greatest(F.lit(0), F.col("vehicles") - F.col("halting"))
    return j.groupBy("tl_id", "phase_index").agg(F.round(F.coalesce(F.sum("halting"), F.lit(0)) / n, 2).alias("queue"), F.round(F.coalesce(F.sum(moving), F.lit(0)) / n, 2).alias("passed"))


def net_state(lanes: DataFrame, key: str, measures: list[str], digits: int = 2) -> DataFrame:
    """(key, lanes, total of each measure) of every light and, as `all`, of the whole net, in one rollup."""
    r = lanes.rollup(key).agg(F.grouping(key).alias("__g"), F.count(F.lit(1)).alias("lanes"), *[F.round(F.sum(m), digits).alias(m) for m in measures])
    return r.select(F.when(F.col("__g") == 1, "all").otherwise(F.col(key).cast("string")).alias(key), "lanes", *measures)


def distinct_lanes(df: DataFrame, key: str, lanes: str) -> DataFrame:
    """(key, lane) of every lane a light controls, each once."""
    return df.select(key, F.explode(lanes).alias("lane")).distinct()


def start_end(queues: DataFrame, key: list[str], step: str, cycle: int, queue: str) -> DataFrame:
    """Each cycle start with the queue a cycle later (offset join); the growth is never negative, a missing end adds 0."""
    end = queues.select(*key, (F.col(step) - cycle).alias(step), F.col(queue).alias("end_queue"))
    return queues.join(end, [*key, step], "left").withColumn("delta", F.greatest(F.lit(0), F.coalesce("end_queue", queue) - F.col(queue)))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before its time: one union and a window, no range join."""
    u = left.select(key, time, F.lit(1).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v")).unionByName(right.select(key, time, F.lit(0).alias("__l"), F.col(value).alias("__v")))
    w = W.partitionBy(key).orderBy(time, "__l").rowsBetween(W.unboundedPreceding, W.currentRow)
    return u.withColumn(value, F.last("__v", True).over(w)).where("__l = 1").select(key, time, value)


def kpis(lanes: DataFrame, by: list[str], step: str) -> DataFrame:
    """Indicators from (by, step, vehicles, halting, waiting): of each step the lanes' mean saturation ((vehicles +
    halting) * 5 / 100), queue (5 m a halting vehicle) and delay; of these mean and maximum over the steps, vehicles in
    all, vehicles for each step times 3600, and the index from the number of lanes of the last step with its level."""
    s = lanes.groupBy(*by, step).agg(F.avg((F.col("vehicles") + F.col("halting")) * 5 / 100).alias("sat"), F.avg(F.col("halting") * 5).alias("q"), F.avg("waiting").alias("d"), F.sum("vehicles").alias("v"), F.count(F.lit(1)).alias("n"))
    g = s.groupBy(*by).agg(F.avg("sat").alias("average_saturation"), F.sum("v").alias("total_vehicles"), F.avg("q").alias("average_queue_length"), F.max("sat").alias("max_saturation"), F.max("q").alias("max_queue_length"), F.avg("d").alias("__d"), F.count(F.lit(1)).alias("__s"), F.max_by("n", step).alias("__n"))
    i = t.congestion_index(F.col("average_saturation"), F.col("average_queue_length"), F.col("__n"), F.col("__d"))
    g = g.withColumn("vehicle_throughput", F.col("total_vehicles") / F.col("__s") * 3600).withColumn("average_delay", F.col("__d")).withColumn("congestion_index", i).drop("__d", "__s", "__n")
    return g.withColumn("congestion_level", t.congestion_level(F.col("congestion_index")))
