"""Scalar expressions on phases, saturations and green times. Nulls stay null unless a default is stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def half_even(x: Column) -> Column:
    """Rounds to a whole number, ties to even."""
    return F.bround(x, 0).cast("bigint")


def estimate_capacity(lanes: Column, capped: bool = True) -> Column:
    """15 a lane, at least 15 and, if capped, at most 60; `lanes` is an array."""
    c = F.greatest(F.lit(15), F.size(lanes) * 15)
    return F.least(F.lit(60), c) if capped else c


def saturation(queue: Column, capacity: Column, digits: int = 4) -> Column:
    """queue / capacity, 0 where the capacity is 0 or missing."""
    return F.coalesce(F.round(F.try_divide(queue, capacity), digits), F.lit(0.0))


def unit_random(*key: Column | str) -> Column:
    """Uniform in [0, 1), the same for the same key whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def normal_random(*key: Column | str) -> Column:
    """Standard normal from two uniform hashes."""
    u, v = F.greatest(unit_random(*key, F.lit("u")), F.lit(1e-12)), unit_random(*key, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def gauss_noise(value: Column, key: Column, ratio: float = 0.1, least: float = 0.0) -> Column:
    return F.greatest(value + normal_random(key) * F.abs(value) * ratio, F.lit(least))


def time_variation(low: Column, high: Column, key: Column) -> Column:
    """Struct (min_green, max_green): each moved by 2 to 5 either way, held in [5, 60] and [30, 120], swapped if out of order."""
    def moved(x: Column, name: str, a: int, b: int) -> Column:
        step = (2 + 3 * unit_random(key, F.lit(name))) * F.when(unit_random(key, F.lit(name + "s")) < 0.5, -1).otherwise(1)
        return clamp(x + step, F.lit(float(a)), F.lit(float(b))).cast("int")

    lo, hi = moved(low, "min", 5, 60), moved(high, "max", 30, 120)
    return F.struct(F.least(lo, hi).alias("min_green"), F.greatest(lo, hi).alias("max_green"))


def time_config(low: Column, high: Column, key: Column) -> Column:
    """Struct (min_dur, max_dur): given values where positive, else drawn from [5, 30] and [60, 120]; held in [5, 120]."""
    lo = clamp(F.when(low > 0, low).otherwise(5 + 25 * unit_random(key, F.lit("a"))), F.lit(5.0), F.lit(120.0))
    hi = clamp(F.when(high > 0, high).otherwise(60 + 60 * unit_random(key, F.lit("b"))), F.lit(5.0), F.lit(120.0))
    return F.struct(F.least(lo, hi).alias("min_dur"), F.greatest(lo, hi).alias("max_dur"))


def pred_queue(initial: Column, end: Column, key: Column | None = None, ratio: float = 0.1) -> Column:
    """The queue at a cycle's end: the first one and what the cycle added, which is never negative; with a key, noise of
    that ratio is drawn by it and the result not below 0."""
    q = initial + F.greatest(F.lit(0), end - initial)
    return q if key is None else gauss_noise(q.cast("double"), key, ratio)


def format_ts(base: Column, seconds: Column) -> Column:
    return F.date_format(F.to_timestamp(base) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def scenario_date(index: Column) -> Column:
    """The day with that number (from 1) in months of 28 days of 2026."""
    return F.format_string("2026-%02d-%02d", (F.floor(index / 28) + 1).cast("int"), (index % 28 + 1).cast("int"))


def target_green(sat: Column, low: Column, high: Column) -> Column:
    return clamp(half_even(high * F.greatest(F.lit(0.0), sat)), low.cast("bigint"), high.cast("bigint"))


def baseline_green(sat: Column, low: Column, high: Column) -> Column:
    return (low + F.least(sat, F.lit(1.0)) * (high - low)).cast("bigint")


def proportional_solution(waits: Column) -> Column:
    """Plan (phase_id, final) in the phases' order: green by each phase's share of the largest saturation."""
    top = F.array_max(F.transform(waits, lambda w: w["pred_saturation"]))

    def one(w: Column) -> Column:
        lo, hi, s = w["min_green"], w["max_green"], w["pred_saturation"]
        flat = (hi == lo) | (s == 0) | F.coalesce(top <= 0, F.lit(True))
        g = F.when(flat, lo.cast("bigint")).otherwise(half_even(lo + F.try_divide(s, top) * (hi - lo)))
        return F.struct(w["phase_id"].alias("phase_id"), clamp(g, lo.cast("bigint"), hi.cast("bigint")).alias("final"))

    return F.transform(waits, one)


def deviation(final: Column, target: Column, low: Column, high: Column) -> Column:
    return F.abs(final - target) / F.greatest(high - low, F.lit(1))


def phase_sat_score(final: Column, target: Column, low: Column, high: Column, near: float = 0.35, exact: float = 0.4, one_off: float = 0.15, clip_bonus: float = 0.0, clip_penalty: float = 0.0) -> Column:
    """Score of a green time by its deviation from the target, never below 0: bands up to .05, .1 and .2, a near-miss
    penalty that shrinks towards .2, bonuses for an exact hit and one second off, and a bonus or penalty where the target
    lies on a limit."""
    d, off = deviation(final, target, low, high), F.abs(final - target)
    band = F.when(d <= 0.05, 1.0).when(d <= 0.1, 0.8).when(d <= 0.2, F.greatest(F.lit(0.0), 0.3 - (d - 0.1) * 3)).otherwise(0.0)
    miss = F.when((d > 0.1) & (d <= 0.2), near * (0.2 - d) / 0.1).otherwise(0.0)
    hit = F.when(off == 0, exact).when(off == 1, one_off).otherwise(0.0)
    on_limit = (target == low) | (target == high)
    clip = F.when(on_limit & (off == 0), clip_bonus).when(on_limit & (d > 0.1), -clip_penalty).otherwise(0.0)
    return F.greatest(F.lit(0.0), band - miss + hit + clip)


def congestion_index(sat: Column, queue: Column, lanes: Column, delay: Column) -> Column:
    return 0.4 * F.least(sat, F.lit(1.0)) + 0.3 * F.least(F.coalesce(F.try_divide(queue, 50 * lanes), F.lit(0.0)), F.lit(1.0)) + 0.3 * F.least(delay / 60, F.lit(1.0))


def congestion_level(index: Column) -> Column:
    return F.when(index < 0.3, "free").when(index < 0.5, "light").when(index < 0.7, "moderate").when(index < 0.9, "heavy").otherwise("severe")


def saturation_bucket(x: Column) -> Column:
    return F.when(x < 0.3, "low").when(x < 0.7, "med").when(x.isNotNull(), "high")


def deviation_bucket(d: Column) -> Column:
    return F.when(d <= 0.1, "match").when(d <= 0.3, "near_miss").when(d.isNotNull(), "large")


def pred_bucket(s: Column) -> Column:
    return F.when(s <= 0.3, "low").when(s <= 0.7, "mid").when(s.isNotNull(), "high")


def closeness(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def seconds_to_steps(seconds: Column, step: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(seconds / F.coalesce(F.nullif(step, F.lit(0.0)), F.lit(1.0))))


def improvement_score(base: Column, now: Column, weights: tuple[float, float, float] = (0.3, 0.4, 0.3), steepness: float = 1.0, most: float = 5.0, negative: float = 0.5) -> Column:
    """Reward of an outcome (struct passed, queue, delay) against a baseline: weighted relative gains, more passed and
    less queue and delay being better; logarithmic above 0, linear below down to `-most * negative`. A baseline of 0 adds
    nothing, a missing one raises."""
    rel = lambda n, up: F.when(base[n] > 0, (now[n] - base[n]) * (1.0 if up else -1.0) / (F.greatest(base[n], F.lit(1.0)) if n == "delay" else base[n])).otherwise(0.0)
    x = weights[0] * rel("passed", True) + weights[1] * rel("queue", False) + weights[2] * rel("delay", False)
    up = F.log(1 + steepness * F.greatest(x, F.lit(0.0))) / F.log(F.lit(1 + steepness)) * most
    return F.when(base.isNull(), F.raise_error(F.lit("no baseline for the sample")).cast("double")).when(x >= 0, up).otherwise(F.greatest(x * most, F.lit(-most * negative)))
