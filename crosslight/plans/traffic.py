"""Queries on traces, samples and filters. Line items stand in for a trace: suppliers are lights, line numbers steps,
order keys vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import plans, text as x, timing as t
from ..operators import augment, filters, joins, metrics, phases, sampling, traces
from .registry import checked_by, table


def lane_steps(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    ids = F.array(F.col("l_orderkey").cast("string"), F.concat(F.lit("p"), F.col("l_partkey") % 50))
    return li.select(F.col("l_suppkey").alias("tl_id"), F.col("l_linenumber").alias("step"), F.concat(F.lit("lane"), F.col("l_partkey") % 4).alias("lane_id"), F.col("l_quantity").alias("halting"), F.col("l_tax").alias("waiting"), ids.alias("vehicle_ids"))


ENDS = """e as (select l_suppkey, min(l_linenumber) a, max(l_linenumber) z from lineitem group by 1),
 v as (select l_suppkey, l_linenumber, unnest([l_orderkey::varchar, 'p' || l_partkey % 50]) id from lineitem),
 gone as (select e.l_suppkey, count(distinct v.id) passed from e join v on v.l_suppkey = e.l_suppkey and v.l_linenumber = e.a where not exists (select 1 from v y where y.l_suppkey = e.l_suppkey and y.l_linenumber = e.z and y.id = v.id) group by 1),
 st as (select l_suppkey, l_linenumber, sum(l_quantity) q, sum(l_tax) w from lineitem group by 1, 2)"""


@checked_by(f"with {ENDS} select l_suppkey tl_id, coalesce(max(passed), 0) passed, round(avg(q), 4) avg_queue, round(sum(w), 4) total_delay, count(*) duration from st left join gone using (l_suppkey) group by 1")
def cycle_metrics(s: SparkSession, d: str) -> DataFrame:
    m = traces.cycle_metrics(lane_steps(s, d), ["tl_id"])
    return m.select("tl_id", "passed", F.round("avg_queue", 4).alias("avg_queue"), F.round("total_delay", 4).alias("total_delay"), "duration")


@checked_by(f"with {ENDS} select l_suppkey tl_id, coalesce(max(passed), 0) passed, arg_max(q, l_linenumber) \"queue\", round(sum(w), 4) delay from st left join gone using (l_suppkey) group by 1")
def plan_outcome(s: SparkSession, d: str) -> DataFrame:
    m = traces.plan_outcome(lane_steps(s, d), ["tl_id"])
    return m.select("tl_id", "passed", "queue", F.round("delay", 4).alias("delay"))


@checked_by(f"with {ENDS} select e.l_suppkey, coalesce(passed, 0) passed from e left join gone using (l_suppkey)")
def vehicles_left(s: SparkSession, d: str) -> DataFrame:
    v = lane_steps(s, d).select("tl_id", "step", F.explode("vehicle_ids").alias("vehicle_id"))
    return traces.vehicles_left(v, ["tl_id"]).select(F.col("tl_id").alias("l_suppkey"), "passed")


def phase_lanes(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("tl_id"), (F.col("l_linenumber") % 3).alias("phase_index"), F.concat(F.lit("lane"), F.col("l_orderkey") % 6).alias("lane"))
    return li.groupBy("tl_id", "phase_index").agg(F.collect_set("lane").alias("green_lanes"))


PHASE_LANES = "pl as (select distinct l_suppkey tl_id, l_linenumber % 3 phase_index, 'lane' || l_orderkey % 6 lane_id from lineitem)"


@checked_by(f"with {PHASE_LANES} select pl.tl_id, phase_index, l_linenumber step, sum(l_quantity) \"queue\", count(*) lanes from pl join lineitem on l_suppkey = tl_id and 'lane' || l_partkey % 4 = lane_id group by 1, 2, 3")
def phase_lane_queue(s: SparkSession, d: str) -> DataFrame:
    return traces.phase_lane_queue(phase_lanes(s, d), lane_steps(s, d))


@checked_by(f"""with {PHASE_LANES}, n as (select tl_id, phase_index, count(*) n from pl group by 1, 2), l as (select l_suppkey tl_id, 'lane' || l_partkey % 4 lane_id, sum(l_quantity) h, count(*) * 40 v from lineitem group by 1, 2)
 select pl.tl_id, pl.phase_index, round(coalesce(sum(h), 0) / max(n), 2) "queue", round(coalesce(sum(greatest(0, v - h)), 0) / max(n), 2) passed from pl join n using (tl_id, phase_index) left join l on l.tl_id = pl.tl_id and l.lane_id = pl.lane_id group by 1, 2""")
def phase_traffic(s: SparkSession, d: str) -> DataFrame:
    lanes = lane_steps(s, d).groupBy("tl_id", "lane_id").agg(F.sum("halting").alias("halting"), (F.count(F.lit(1)) * 40).alias("vehicles"))
    return traces.phase_traffic(phase_lanes(s, d), lanes)


@checked_by("""with v as (select l_suppkey, l_returnflag, count(*) vehicle_count, avg(l_discount * 100) s, avg(l_tax) w from lineitem where l_linenumber < 3 group by 1, 2), h as (select l_suppkey, l_returnflag, sum(l_quantity) q from lineitem group by 1, 2)
 select l_suppkey, l_returnflag, coalesce(vehicle_count, 0) vehicle_count, round(coalesce(s, 0), 4) mean_speed, q halting_count, round(coalesce(w, 0), 6) waiting_time from h left join v using (l_suppkey, l_returnflag)""")
def junction_counts(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    v = li.where("l_linenumber < 3").select("l_suppkey", "l_returnflag", (F.col("l_discount") * 100).alias("speed"), F.col("l_tax").alias("waiting"))
    c = traces.junction_counts(v, li.select("l_suppkey", "l_returnflag", F.col("l_quantity").alias("halting")), ["l_suppkey", "l_returnflag"])
    return c.select("l_suppkey", "l_returnflag", "vehicle_count", F.round("mean_speed", 4).alias("mean_speed"), "halting_count", F.round("waiting_time", 6).alias("waiting_time"))


@checked_by("""with s as (select l_suppkey, l_linenumber, avg((2 + l_quantity) * 5 / 100) sat, avg(l_quantity * 5) q, avg(l_tax) w, count(*) * 2 v, count(*) n from lineitem group by 1, 2),
 g as (select l_suppkey, avg(sat) a, sum(v)::bigint v, avg(q) q, max(sat) ms, max(q) mq, avg(w) w, count(*) k, arg_max(n, l_linenumber) n from s group by 1), i as (select *, round(0.4::double * least(a, 1) + 0.3::double * least(q / (50 * n), 1) + 0.3::double * least(w / 60, 1), 6) idx from g)
 select l_suppkey, round(a, 4) average_saturation, v total_vehicles, round(q, 4) average_queue_length, round(ms, 4) max_saturation, round(mq, 4) max_queue_length, round(v / k * 3600, 4) vehicle_throughput, round(w, 6) average_delay, idx congestion_index,
 case when idx < 0.3::double then 'free' when idx < 0.5 then 'light' when idx < 0.7::double then 'moderate' when idx < 0.9::double then 'heavy' else 'severe' end congestion_level from i""")
def intersection_kpis(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("step"), F.lit(2).alias("vehicles"), F.col("l_quantity").alias("halting"), F.col("l_tax").alias("waiting"))
    k = traces.kpis(v, ["l_suppkey"], "step").withColumn("congestion_index", F.round("congestion_index", 6))
    cols = ("average_saturation", "average_queue_length", "max_saturation", "max_queue_length", "vehicle_throughput")
    return k.select("l_suppkey", "total_vehicles", *[F.round(c, 4).alias(c) for c in cols], F.round("average_delay", 6).alias("average_delay"), "congestion_index", t.congestion_level(F.col("congestion_index")).alias("congestion_level"))


@checked_by("select coalesce(s_nationkey::varchar, 'all') s_nationkey, count(*) lanes, round(sum(s_acctbal), 2) s_acctbal from supplier group by rollup (s_nationkey)")
def net_state_snapshot(s: SparkSession, d: str) -> DataFrame:
    return traces.net_state(table(s, d, "supplier").select("s_nationkey", "s_acctbal"), "s_nationkey", ["s_acctbal"])


@checked_by("select distinct l_suppkey tl_id, 'lane' || l_orderkey % 6 lane from lineitem")
def distinct_lanes(s: SparkSession, d: str) -> DataFrame:
    return traces.distinct_lanes(phase_lanes(s, d), "tl_id", "green_lanes")


@checked_by("select event_id from events where ts >= (select max(ts) from events) - interval 2 hour")
def history_window(s: SparkSession, d: str) -> DataFrame:
    return filters.history_window(table(s, d, "events").select("event_id", "ts"), "ts", 7200).select("event_id")


@checked_by("select event_id from events where ts >= (select max(ts) from events) - interval 24 hour")
def history_retention(s: SparkSession, d: str) -> DataFrame:
    return filters.retention(table(s, d, "events").select("event_id", "ts"), "ts").select("event_id")


@checked_by("select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
def selected_scenarios(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return filters.select_named(n, "r_name", ["ASIA", "EUROPE"]).select("n_nationkey")


@checked_by("select l_orderkey, l_linenumber from lineitem where l_linenumber % 2 = 0")
def even_phases(s: SparkSession, d: str) -> DataFrame:
    return filters.even_phases(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber")


@checked_by("select 'customer' \"name\", count(*) n from customer union all select 'orders', count(*) from orders")
def integrity_gates(s: SparkSession, d: str) -> DataFrame:
    n = filters.integrity_gates({k: table(s, d, k) for k in ("customer", "orders")}, 100, {"throughput": 0.3, "queue": 0.4, "delay": 0.3})
    return s.createDataFrame(sorted(n.items()), "name string, n bigint")


@checked_by("select c_custkey, c_name, c_acctbal from customer")
def workspace_zip(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return joins.zip_by_index(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal"), "c_custkey")


@checked_by("select r_name, n_nationkey, row_number() over (order by r_name, n_nationkey) - 1 task from nation join region on n_regionkey = r_regionkey")
def scenario_tasks(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey")
    return joins.tasks(n, n, "r_name", "n_nationkey")


@checked_by("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 task_id from orders")
def numbering(s: SparkSession, d: str) -> DataFrame:
    return joins.numbered(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "task_id").select("o_orderkey", "task_id")


@checked_by("select s_name, row_number() over (order by coalesce(try_cast(delay as double), 'inf'::double), s_name) - 1 place from (select s_name, case when s_suppkey % 4 = 0 then 'n/a' else s_acctbal::varchar end delay from supplier)")
def comparison_sort(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "supplier").select("s_name", F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("delay"))
    v = v.withColumn("k", F.coalesce(F.expr("try_cast(delay as double)"), F.lit(float("inf"))))
    return joins.numbered(v, ["k", "s_name"], "place").select("s_name", "place")


@checked_by("select 'original' \"source\", count(*) n from orders union all select 'variant', count(*) from customer union all select 'synthetic', 300")
def united_sources(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, "orders").select(F.lit("original").alias("source"), "o_orderkey"), table(s, d, "customer").select(F.lit("variant").alias("source"), "c_custkey"), augment.synthesize(s, 300).select(F.lit("synthetic").alias("source"), "sample_id")]
    return augment.union_all_sources(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@checked_by("select o_orderkey, c_acctbal is null missing, round(coalesce(c_acctbal, 0), 2) passed from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def task_baselines(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("passed"))
    j = joins.with_baseline(table(s, d, "orders").select("o_orderkey", "o_custkey"), b, "o_custkey")
    return j.select("o_orderkey", F.col("base").isNull().alias("missing"), F.round(F.coalesce("base.passed", F.lit(0.0)), 2).alias("passed"))


SPREAD = lambda c, n: f"round(coalesce(avg({c}), 0), 4) {n}_avg, coalesce(max({c}), 0)::double {n}_max, coalesce(min({c}), 0)::double {n}_min, round(coalesce(stddev_samp({c}), 0), 4) {n}_std"


@checked_by(f"""select l_returnflag model_name, l_linestatus scenario, round(avg((l_quantity > 10)::int), 6) format_success_rate, round(avg((l_quantity > 20)::int), 6) constraint_satisfaction_rate, round(avg((l_quantity > 10)::int), 6) phase_order_correct_rate,
 {SPREAD("case when l_linenumber <> 3 then l_tax end", "response_time")}, {SPREAD("l_quantity", "passed_vehicles")}, {SPREAD("l_linenumber", "queue_vehicles")}, {SPREAD("l_discount", "total_delay")},
 round(sum(case when l_linenumber > 1 then l_quantity end) / sum(l_linenumber - 1), 6) throughput from lineitem group by 1, 2""")
def model_summary(s: SparkSession, d: str) -> DataFrame:
    """All models and scenarios in one grouped job."""
    m = metrics.model_summary(model_cycles(s, d), ["model_name", "scenario"])
    rates = [c for c in m.columns if c.endswith("_rate") or c == "throughput"]
    return m.select("model_name", "scenario", *[F.round(c, 6).alias(c) for c in rates], *[F.round(c, 4).alias(c) if c.endswith(("_avg", "_std")) else F.col(c) for c in m.columns[2:] if c not in rates])


def model_cycles(s: SparkSession, d: str, where: str = "true") -> DataFrame:
    li = table(s, d, "lineitem").where(where)
    seconds = F.when(F.col("l_linenumber") > 1, F.sequence(F.lit(1), F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>"))
    return li.select(F.col("l_returnflag").alias("model_name"), F.col("l_linestatus").alias("scenario"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cycle_index"), F.col("l_quantity").alias("passed_vehicles"), F.col("l_linenumber").alias("queue_vehicles"), F.col("l_discount").alias("total_delay"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("llm_response_time"), (F.col("l_quantity") > 10).alias("format_success"), (F.col("l_quantity") > 20).alias("constraint_satisfied"), seconds.alias("samples"))


@checked_by("""with p as (select l_orderkey, count(*) filter (l_returnflag <> 'N') green, count(*) filter (l_returnflag = 'N') dark from lineitem group by 1)
 select count(*) total_tl, count(*) filter (least(green, 3) >= 2) valid_tl, count(*) filter (least(green, 3) < 2) skipped_tl, sum(case when least(green, 3) >= 2 then least(green, 3) else 0 end)::bigint total_phases, sum(dark)::bigint filtered_phases, sum(green - least(green, 3))::bigint conflict_count from p""")
def net_stats(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("tl_id"), F.when(F.col("l_returnflag") != "N", "rG").otherwise("rr").alias("state"))
    kept = li.where(phases.has_green(F.col("state"))).groupBy("tl_id").agg(F.slice(F.collect_list(F.lit(1)), 1, 3).alias("kept"))
    return phases.net_stats(li, kept)


@checked_by("""select o_orderkey, least(60, greatest(15, 15 * n))::bigint capacity, greatest(15, 15 * n)::bigint uncapped, round(p / (15 * n), 8) saturation, greatest(0, ceil(p / 7))::bigint steps, strftime(timestamp '2026-03-05 00:00:00' + to_seconds((o_orderkey % 90000)::bigint), '%Y-%m-%d %H:%M:%S') "at",
 '2026-' || lpad(((o_orderkey % 300 + 1) // 28 + 1)::varchar, 2, '0') || '-' || lpad(((o_orderkey % 300 + 1) % 28 + 1)::varchar, 2, '0') "day", round(p + greatest(0, n * 100 - p), 5) pred_queue from (select o_orderkey, o_custkey % 6 + 1 n, o_totalprice / 1000 p from orders)""")
def timing_expressions(s: SparkSession, d: str) -> DataFrame:
    n, p = (F.col("o_custkey") % 6 + 1).cast("int"), F.col("o_totalprice") / 1000
    lanes = F.array_repeat(F.lit("lane"), n)
    return table(s, d, "orders").select("o_orderkey", t.estimate_capacity(lanes).cast("bigint").alias("capacity"), t.estimate_capacity(lanes, False).cast("bigint").alias("uncapped"), t.saturation(p, n * 15, 8).alias("saturation"), t.seconds_to_steps(p, F.lit(7.0)).alias("steps"), t.format_ts(F.lit("2026-03-05 00:00:00"), F.col("o_orderkey") % 90000).alias("at"), t.scenario_date(F.col("o_orderkey") % 300 + 1).alias("day"), F.round(t.pred_queue(p, n * 100), 5).alias("pred_queue"))


@checked_by("select count(*) n, true noise_in_bounds, true centred, true greens_in_bounds, true durations_in_bounds, true queue_not_negative from orders")
def noise_bounds(s: SparkSession, d: str) -> DataFrame:
    """What must hold for drawn values of all orders: noise of a tenth is not negative and centred on its value, green
    limits and durations keep their bounds and order."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    g, c = t.time_variation(F.lit(5.0) + k % 30, F.lit(40.0) + k % 60, k), t.time_config(F.when(k % 2 == 0, F.lit(12.0)), F.when(k % 3 == 0, F.lit(80.0)), k)
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", t.gauss_noise(v, k).alias("z"), g.alias("g"), c.alias("c"), t.pred_queue(v, v + 5, k).alias("q"))
    rel = F.col("z") / F.col("o_totalprice") - 1
    ok = (F.col("g.min_green").between(5, 60)) & F.col("g.max_green").between(5, 120) & (F.col("g.min_green") <= F.col("g.max_green"))
    dur = F.col("c.min_dur").between(5, 120) & F.col("c.max_dur").between(5, 120) & (F.col("c.min_dur") <= F.col("c.max_dur"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("z") >= 0).alias("noise_in_bounds"), ((F.abs(F.avg(rel)) < 0.02) & (F.abs(F.stddev(rel) - 0.1) < 0.02)).alias("centred"), F.min(ok).alias("greens_in_bounds"), F.min(dur).alias("durations_in_bounds"), F.min(F.col("q") >= 0).alias("queue_not_negative"))


@checked_by("select 700::bigint n, true known, true repeats from customer limit 1")
def bootstrap_sample(s: SparkSession, d: str) -> DataFrame:
    """Draws with replacement from a tenth of the draws' number of rows, so repeats are certain; all are of the table."""
    c = sampling.uniform_sample(table(s, d, "customer").select("c_custkey"), "c_custkey", 70)
    b = sampling.bootstrap_sample(c, "c_custkey", 700).join(table(s, d, "customer").select(F.col("c_custkey").alias("k")), F.col("c_custkey") == F.col("k"), "left")
    return b.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("k").isNotNull()).alias("known"), (F.countDistinct("c_custkey") <= 70).alias("repeats"))


@checked_by("""with g as (select o_orderpriority, count(*) size from orders group by 1) select o_orderpriority, least(size, greatest(1, floor(50 * size / (select sum(size) from g)::double)))::bigint quota, true near_quota from g""")
def scenario_sample(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    q = sampling.strata_quotas(o, ["o_orderpriority"], 50, True)
    n = sampling.scenario_sample(o, "o_orderpriority", "o_orderkey", 50).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    off = q.agg((50 - F.sum("quota")).alias("off"))
    return q.join(n, "o_orderpriority", "left").crossJoin(F.broadcast(off)).select("o_orderpriority", "quota", F.coalesce("n", F.lit(0)).between(F.col("quota"), F.col("quota") + F.col("off")).alias("near_quota"))


@checked_by("select count(*) n, count(distinct c_custkey) keys, 25::bigint drawn from customer")
def shuffles_and_indices(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey")
    drawn = sampling.index_sample(c, "c_custkey", 25).agg(F.count(F.lit(1)).alias("drawn"))
    return sampling.shuffled(c, "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys")).crossJoin(F.broadcast(drawn))


@checked_by("""with l as (select l_suppkey, l_linenumber % 3 p, 'lane' || l_orderkey % 6 lane, sum(l_quantity) q from lineitem group by 1, 2, 3), a as (select l_suppkey, list_sort(list_distinct(list(lane))) lanes from l group by 1),
 r as (select l_suppkey, p, list(lane) own, sum(q) q from l group by 1, 2), o as (select r.*, lanes, list_sort(list_transform(own, lambda w: list_position(lanes, w) - 1)) idx from r join a using (l_suppkey))
 select l_suppkey, '路口场景描述：该路口有' || count(*) || '个相位，分别是[' || string_agg((rn - 1)::varchar, ', ' order by p) || ']，有' || any_value(len(lanes)) || '个车道，分别是[' || array_to_string(list_transform(range(any_value(len(lanes))), lambda i: i::varchar), ', ') || ']，其中' || string_agg('相位' || p || '控制车道[' || array_to_string(list_transform(idx, lambda i: i::varchar), ', ') || ']', '，' order by p)
 || chr(10) || '交通状态描述：目前该交叉口的当前相位为0，当前相位持续时间为30。' || chr(10) || string_agg('相位(' || p || ')控制的车道的排队车辆为' || printf('%.2f', q) || '，通过车辆数为' || printf('%.2f', q / 2) || '。', chr(10) order by p) body from (select *, row_number() over (partition by l_suppkey order by p) rn from o) group by 1""")
def state_texts(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 3).alias("phase"), F.concat(F.lit("lane"), F.col("l_orderkey") % 6).alias("lane"), "l_quantity")
    p = li.groupBy("l_suppkey", "phase").agg(F.collect_set("lane").alias("lanes"), F.sum("l_quantity").alias("queue")).withColumn("passed", F.col("queue") / 2)
    g = p.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("phase", "lanes", "queue", "passed"))).alias("ps"))
    return g.select("l_suppkey", x.state_text(F.col("ps"), F.lit(0), F.lit(30)).alias("body"))


@checked_by("""select p_partkey, replace(replace(p_brand || '/' || p_type || chr(92) || 'x', '/', '_'), chr(92), '_') safe, 'state_2026-01-02_T03-04-05_' || p_name || '.xml.gz' file, regexp_matches(p_type, '[Gg]') green, p_name stripped, 'sys' || p_name || '!</s>' || 'q' || '<start_working_out>' chat from part""")
def text_expressions(s: SparkSession, d: str) -> DataFrame:
    m = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    chat = F.array(m("system", F.lit("sys")), m("assistant", F.concat("p_name", F.lit("!"))), m("user", F.lit("q")))
    return table(s, d, "part").select("p_partkey", x.safe_name(F.concat("p_brand", F.lit("/"), "p_type", F.lit("\\x"))).alias("safe"), x.state_filename(F.lit("2026-01-02"), F.lit("03:04:05"), F.col("p_name")).alias("file"), phases.has_green(F.col("p_type")).alias("green"), x.strip_suffix_tokens(F.concat("p_name", F.lit("<|im_end|> \n<|pad|>"))).alias("stripped"), x.chat_render(chat, generate=True).alias("chat"))


@checked_by("""select l_suppkey, n_nationkey phase, duration::bigint duration, q outcome from (select s_suppkey l_suppkey, s_nationkey n_nationkey from supplier) cross join generate_series(20, 90, 10) g(duration) left join (select l_suppkey k, l_linenumber * 10 + 10 dur, sum(l_quantity) q from lineitem group by 1, 2) o on o.k = l_suppkey and o.dur = duration""")
def counterfactual_outcomes(s: SparkSession, d: str) -> DataFrame:
    grid = augment.counterfactual_grid(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("phase")))
    o = table(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_linenumber") * 10 + 10).alias("duration")).agg(F.sum("l_quantity").alias("outcome"))
    return augment.counterfactual_outcomes(grid, o, ["l_suppkey", "duration"]).select("l_suppkey", "phase", F.col("duration").cast("bigint").alias("duration"), "outcome")


@checked_by("select l_orderkey, sum(l_quantity)::bigint total, count(*) n from lineitem group by 1")
def default_plans(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), (F.col("l_linenumber") * 2).alias("phase_index"), F.col("l_quantity").alias("duration")))).alias("t"))
    p = plans.default_plan(F.col("t"))
    return g.select("l_orderkey", plans.plan_total(p).alias("total"), F.size(p).cast("bigint").alias("n"))
