"""Phases of traffic lights: green lanes, conflicts, mutually exclusive choice, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def green_lanes(phases: DataFrame, links: DataFrame) -> DataFrame:
    """(tl_id, phase_index, state, green_lanes): lanes whose signal in the state is G or g; lights without links drop
    out, links that a state is too short for are ignored. Of repeated links the last in the file's order counts (`place`);
    where links have no place, the largest from_lane."""
    last = F.max_by("from_lane", "place") if "place" in links.columns else F.max("from_lane")
    k = links.groupBy("tl_id", "link_index").agg(last.alias("from_lane"))
    e = phases.select("tl_id", "phase_index", "state", F.posexplode(F.split("state", "")).alias("link_index", "c"))
    lit_ = e.join(k, ["tl_id", "link_index"]).where(F.col("c").isin("G", "g")).groupBy("tl_id", "phase_index").agg(F.array_sort(F.collect_set("from_lane")).alias("green_lanes"))
    known = phases.join(links.select("tl_id").distinct(), "tl_id", "left_semi")
    return known.join(lit_, ["tl_id", "phase_index"], "left").withColumn("green_lanes", F.coalesce("green_lanes", F.array().cast("array<string>")))


def has_green(state: F.Column) -> F.Column:
    return state.rlike("[Gg]")


def conflict_pairs(lanes: DataFrame, tl: str, phase: str, lane: str) -> DataFrame:
    """(tl, a, b): phases a < b of a light that share a lane, from (tl, phase, lane): an equi-join on the lane, not a
    comparison of all phases."""
    d = lanes.select(tl, phase, lane).distinct()
    a, b = d.select(tl, lane, F.col(phase).alias("a")), d.select(tl, lane, F.col(phase).alias("b"))
    return a.join(b, [tl, lane]).where("a < b").select(tl, "a", "b").distinct()


def greedy_mutex(phases: DataFrame, stop_on_lost_tie: bool = True, seed: int = 42) -> DataFrame:
    """(tl_id, kept, tossed): phases chosen in list order. A phase is compared with the kept ones; at the first that shares
    a lane it takes its place if it has more lanes and is dropped if it has fewer; equal numbers are decided by a hash of
    light and phase (`tossed` tells that a light had such a case). A lost tie ends the comparison or, without
    `stop_on_lost_tie`, goes on to the next kept phase. What took a place is not compared again, so kept phases may still
    overlap. Phases of a light are few; they are folded as one array in the JVM."""
    p = F.struct(F.col("pos").alias("pos"), F.col("phase_index").alias("phase_index"), F.col("green_lanes").alias("lanes"), (F.pmod(F.xxhash64("tl_id", "pos", F.lit(seed)), F.lit(2)) == 0).alias("wins"))
    arr = phases.groupBy("tl_id").agg(F.array_sort(F.collect_list(p)).alias("ps"))
    kind = "array<struct<pos:int,phase_index:int,lanes:array<string>,wins:boolean>>"

    def step(acc: F.Column, x: F.Column) -> F.Column:
        kept = acc["kept"]
        overlap = lambda y: F.arrays_overlap(y["lanes"], x["lanes"])
        more = lambda y: F.size(x["lanes"]) > F.size(y["lanes"])
        tie = lambda y: F.size(x["lanes"]) == F.size(y["lanes"])
        decides = lambda y: overlap(y) if stop_on_lost_tie else overlap(y) & ~(tie(y) & ~x["wins"])
        at = F.array_position(F.transform(kept, lambda y: F.coalesce(decides(y), F.lit(False))), True)
        any_overlap = F.exists(kept, lambda y: F.coalesce(overlap(y), F.lit(False)))
        y0 = F.get(kept, (at - 1).cast("int"))
        takes = more(y0) | (tie(y0) & x["wins"])
        now = F.when(~any_overlap, F.concat(kept, F.array(x))).when((at > 0) & takes, F.transform(kept, lambda y, i: F.when(i + 1 == at, x).otherwise(y))).otherwise(kept)
        coin = any_overlap & F.exists(kept, lambda y: F.coalesce(overlap(y) & tie(y), F.lit(False))) if not stop_on_lost_tie else (at > 0) & tie(y0)
        return F.struct(now.alias("kept"), (acc["tossed"] | F.coalesce(coin, F.lit(False))).alias("tossed"))

    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(False).alias("tossed"))
    folded = arr.select("tl_id", F.aggregate("ps", start, step).alias("f"))
    return folded.select("tl_id", F.transform("f.kept", lambda y: y["phase_index"]).alias("kept"), "f.tossed")


def valid_lights(kept: DataFrame) -> DataFrame:
    return kept.where(F.size("kept") >= 2)


def renumber(phases: DataFrame, by: list[str], order: str) -> DataFrame:
    return phases.withColumn("number", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)


def net_stats(phases: DataFrame, kept: DataFrame) -> DataFrame:
    """One row (total_tl, valid_tl, skipped_tl, total_phases, filtered_phases, conflict_count): lights there are, those
    with two phases or more left, others; the phases of the valid ones, phases without green, and phases with green that
    the choice of exclusive ones dropped. `phases` has (tl_id, state), `kept` (tl_id, kept)."""
    p = phases.groupBy("tl_id").agg(F.count_if(has_green(F.col("state"))).alias("green"), F.count_if(~has_green(F.col("state"))).alias("dark"))
    j = p.join(kept.select("tl_id", F.size("kept").alias("n")), "tl_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.col("n") >= 2
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return j.agg(F.count(F.lit(1)).alias("total_tl"), F.count_if(ok).alias("valid_tl"), F.count_if(~ok).alias("skipped_tl"), z(F.when(ok, F.col("n"))).alias("total_phases"), z("dark").alias("filtered_phases"), z(F.col("green") - F.col("n")).alias("conflict_count"))
