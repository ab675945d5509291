"""Queries over sources, sinks and streams: each writes with a sink into the session's shared folder, or runs a stream into
it, and reads what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import phases, validation
from ..scratch import path
from ..sources import readers, sinks
from ..streaming import windows
from .queries import statuses
from .registry import checked_by, table
from .traffic import SPREAD, model_cycles


def light_phases(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").where("l_orderkey < 400")
    return li.select(F.col("l_orderkey").cast("string").alias("tl_id"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") * 2).alias("phase_index"), F.lit("Gr").alias("state"), F.array(F.concat(F.lit("b"), F.col("l_partkey")), F.concat(F.lit("a"), F.col("l_suppkey"))).alias("green_lanes"), F.col("l_quantity").alias("min_dur"), (F.col("l_quantity") + 5).alias("max_dur"))


@checked_by("""select l_orderkey::varchar tl_id, row_number() over (partition by l_orderkey order by l_linenumber, 'a' || l_suppkey, 'b' || l_partkey, l_quantity) - 1 pos, (l_linenumber * 2)::int phase_index, 'a' || l_suppkey || ',b' || l_partkey lanes, l_quantity min_dur from lineitem where l_orderkey < 400""")
def phase_config_round_trip(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "phase-config")
    sinks.phase_config(light_phases(s, d), p, "net.xml")
    r = readers.phase_config(s, p)
    return r.select("tl_id", F.col("pos").cast("bigint").alias("pos"), "phase_index", F.array_join("green_lanes", ",").alias("lanes"), "min_dur")


@checked_by("select count(distinct l_orderkey) total_tl, count(distinct l_orderkey) valid_tl, 0::bigint skipped_tl, count(*) total_phases, 'net.xml' source_file from lineitem where l_orderkey < 400")
def phase_config_metadata(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "phase-config")
    sinks.phase_config(light_phases(s, d), p, "net.xml")
    return s.read.schema("metadata struct<total_tl:bigint,valid_tl:bigint,skipped_tl:bigint,total_phases:bigint,source_file:string>").json(p).select("metadata.*")


@checked_by("select rec_id, prompt, prediction.as_of as_of, len(prediction.phase_waits)::bigint n, state_file, metadata.tl_id tl_id from train_samples")
def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "jsonl")
    t = table(s, d, "train_samples").select("rec_id", "prompt", F.struct("prediction.as_of", F.transform("prediction.phase_waits", lambda w: w.withField("pred_saturation", F.nanvl(w["pred_saturation"], F.lit(None).cast("double")))).alias("phase_waits")).alias("prediction"), "state_file", "metadata")
    sinks.jsonl(t, p)
    r = readers.jsonl(s, p, "rec_id bigint, " + readers.SAMPLE, strict=True)
    return r.select("rec_id", "prompt", "prediction.as_of", F.size("prediction.phase_waits").cast("bigint").alias("n"), "state_file", "metadata.tl_id")


@checked_by("select count(*) n, (select count(*) from orders where o_orderkey % 5 = 0) bad, (select count(*) from orders where o_orderkey % 5 = 0) skipped, true numbered from orders where o_orderkey % 5 <> 0")
def tolerant_jsonl(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "tolerant")
    o = table(s, d, "orders")
    o.select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('{"k": '), F.col("o_orderkey"), F.lit(", oops"))).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k")))).alias("value")).write.text(p)
    rows, bad, skipped = readers.jsonl_tolerant(s, p, "k bigint")
    return rows.where("k is not null").agg(F.count(F.lit(1)).alias("n")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad"), F.coalesce(F.min("line") >= 1, F.lit(True)).alias("numbered"))).crossJoin(skipped.agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped")))


@checked_by("select o_orderkey, o_totalprice > 100000 keep from orders")
def split_write(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "split")
    sinks.split(table(s, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 100000, p)
    return s.read.schema("o_orderkey bigint, keep boolean").json(p)


@checked_by("select count(*) n, count(distinct o_custkey) ids from (select distinct o_custkey from orders)")
def append_results(s: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches, the second twice: each id is there once."""
    p = path(s, "append")
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus")
    for part in (o.where("o_orderstatus <> 'F'"), o, o):
        sinks.append_results(part, p, "o_custkey")
    return s.read.schema("o_custkey bigint").json(p).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("ids"))


@checked_by("select l_linestatus scenario, l_suppkey tl_id, (l_linenumber)::int cycle_index, count(*) n from lineitem where l_suppkey < 20 group by 1, 2, 3")
def cycle_files(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "cycles")
    li = table(s, d, "lineitem").where("l_suppkey < 20").select(F.col("l_linestatus").alias("scenario"), F.col("l_suppkey").alias("tl_id"), F.col("l_linenumber").alias("cycle_index"), "l_quantity")
    sinks.cycles(li.repartition("scenario", "tl_id", "cycle_index"), p)
    r = s.read.schema("scenario string, tl_id bigint, cycle_index int, l_quantity double").json(p)
    return r.groupBy("scenario", "tl_id", "cycle_index").agg(F.count(F.lit(1)).alias("n"))


@checked_by(f"""select l_returnflag model_name, l_linestatus scenario, 22::bigint "columns", {SPREAD("l_quantity", "passed_vehicles")} from lineitem group by 1, 2""")
def summary_extended(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "summary")
    sinks.summary_extended(model_cycles(s, d), p)
    r = s.read.option("header", True).csv(p)
    four = [F.round(F.col(f"passed_vehicles_{n}").cast("double"), 4).alias(f"passed_vehicles_{n}") for n in ("avg", "max", "min", "std")]
    return r.select("model_name", "scenario", F.lit(len(r.columns)).cast("bigint").alias("columns"), *four)


@checked_by("select l_returnflag model_name, count(*) cycles, round(avg((l_quantity > 10)::int), 6) format_rate, max(l_quantity) passed_max, 'v1' setting from lineitem where l_suppkey = 7 group by 1")
def final_json(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "final")
    c = model_cycles(s, d, "l_suppkey = 7")
    sinks.final_json(c.drop("scenario"), ["model_name"], "cycle_index", p, {"plan": "v1"})
    r = s.read.schema("metadata struct<model_name:string,config:map<string,string>>, cycles array<struct<cycle_index:bigint>>, summary struct<llm:struct<format_success_rate:double>,traffic:struct<passed_vehicles_max:double>>").json(p)
    return r.select("metadata.model_name", F.size("cycles").cast("bigint").alias("cycles"), F.round("summary.llm.format_success_rate", 6).alias("format_rate"), F.col("summary.traffic.passed_vehicles_max").alias("passed_max"), F.col("metadata.config")["plan"].alias("setting"))


@checked_by("select 'm' || n_nationkey model, n_regionkey::varchar avg_delay, '' throughput, count(*) over () n from nation")
def merged_results(s: SparkSession, d: str) -> DataFrame:
    """Runs' files of different columns, summaries among them, merged and written as a comparison."""
    p, n = path(s, "runs"), table(s, d, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("model"), F.col("n_regionkey").cast("string").alias("avg_delay"), F.col("n_name").alias("other"))
    sinks.csv(n.where("model < 'm2'").select("other", "model", "avg_delay"), f"{p}/run1")
    sinks.csv(n.where("model >= 'm2'").select("avg_delay", "model"), f"{p}/run2")
    sinks.comparison(readers.result_csvs(s, p), f"{p}-comparison")
    r = s.read.option("header", True).option("nullValue", "\0").csv(f"{p}-comparison")
    total = r.agg(F.count(F.lit(1)).alias("n"))
    return r.crossJoin(F.broadcast(total)).select("model", "avg_delay", F.coalesce("throughput", F.lit("")).alias("throughput"), "n")


@checked_by("select l_suppkey::varchar tl_id, 2::bigint n, (sum(l_quantity) * 2)::bigint total from lineitem where l_suppkey < 10 group by 1")
def kpi_table(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "kpis")
    g = table(s, d, "lineitem").where("l_suppkey < 10").groupBy(F.col("l_suppkey").cast("string").alias("tl_id")).agg(F.sum("l_quantity").alias("total_vehicles"))
    k = g.select(F.lit("2026-01-01 00:00:00").cast("timestamp").alias("ts"), "tl_id", *[F.col(c) if c == "total_vehicles" else F.lit("free" if c == "congestion_level" else 0.5).alias(c) for c in sinks.KPI_COLUMNS])
    for _ in range(2):
        sinks.append_kpis(k, p)
    r = s.read.schema(sinks.kpi_schema()).option("header", True).csv(p)
    return r.groupBy("tl_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_vehicles").cast("bigint").alias("total"))


@checked_by("select count(*) n, 'r,c' head from (select distinct o_orderpriority from orders)")
def text_report(s: SparkSession, d: str) -> DataFrame:
    """The lines of a markdown report, all groups in it."""
    text = sinks.report(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("r")).agg(F.count(F.lit(1)).alias("c")), "Orders")
    lines = [x for x in text.split("\n") if x.startswith("|")]
    return s.createDataFrame([(len(lines) - 2, ",".join(c.strip() for c in lines[0].strip("|").split("|")))], "n bigint, head string")


@checked_by("select 7::int seed, 100::int requested_samples, count(*) manifest_size, 'random' sample_mode, count(*) ids from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def validation_files(s: SparkSession, d: str) -> DataFrame:
    p, sd = path(s, "validation"), statuses(s, d)
    sinks.validation_outputs(sd, validation.failure_buckets(sd, ["run"]), p, 7, 100, "random")
    m = s.read.schema("seed int, requested_samples int, manifest_size bigint, sample_mode string").json(f"{p}/manifest")
    ids = s.read.schema("sample_id bigint").json(f"{p}/manifest_ids").agg(F.countDistinct("sample_id").alias("ids"))
    return m.crossJoin(F.broadcast(ids))


@checked_by("select r_name, n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'AFRICA')")
def merged_scenarios(s: SparkSession, d: str) -> DataFrame:
    """Files of two scenarios merged in the given order; a stale third file stays out."""
    p, n = path(s, "scenarios"), table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey")
    for name in ("ASIA", "AFRICA", "EUROPE"):
        sinks.jsonl(n.where(F.col("r_name") == name), f"{p}/{name}")
    return readers.merged_jsonl(s, [f"{p}/ASIA", f"{p}/AFRICA"], "r_name string, n_nationkey int").select("r_name", "n_nationkey")


@checked_by("select 'a' run, count(*) total_samples from orders union all select 'b', count(*) from customer")
def run_inputs(s: SparkSession, d: str) -> DataFrame:
    p, runs = path(s, "named"), {}
    for name, t in (("a", "orders"), ("b", "customer")):
        runs[name] = f"{p}/{name}"
        sinks.jsonl(table(s, d, t).agg(F.count(F.lit(1)).alias("total_samples")), runs[name])
    return readers.named_runs(s, runs, "total_samples bigint").select("run", "total_samples")


@checked_by("select round(avg(value), 4) reward, count(*) n from events where event_id % 3 <> 0")
def train_log(s: SparkSession, d: str) -> DataFrame:
    """A log of lines in both kinds of quotes, with others between them, read back."""
    p, e = path(s, "log"), table(s, d, "events")
    line = F.concat(F.lit("{'loss': 0.5, 'reward': "), F.col("value").cast("string"), F.lit(", 'reward_std': 0.25}"))
    e.select(F.when(F.col("event_id") % 3 == 0, F.lit("step reward reward_std")).when(F.col("event_id") % 3 == 1, line).otherwise(F.translate(line, "'", '"')).alias("value")).write.text(p)
    return readers.train_log(s, p).agg(F.round(F.avg("reward"), 4).alias("reward"), F.count(F.lit(1)).alias("n"))


@checked_by("select strftime(ts, '%Y-%m-%d %H:%M:%S') \"at\", round(value, 6) \"queue\", (event_id % 4)::int phase from events where event_id <= 200")
def history_file(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "history")
    e = table(s, d, "events").where("event_id <= 200").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("a"), F.col("value").alias("b"), (F.col("event_id") % 4).cast("int").alias("c"), "event_id")
    g = e.agg(F.array_sort(F.collect_list(F.struct("event_id", "a", "b", "c"))).alias("x"))
    sinks.jsonl(g.select(F.col("x.a").alias("timestamps"), F.transform("x.b", lambda v: F.create_map(F.lit("1"), v)).alias("phase_queues"), F.col("x.c").alias("phases")).coalesce(1), p)
    r = readers.history(s, p)
    return r.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round(F.col("phase_queues")[1], 6).alias("queue"), "phase")


@checked_by("""select s_suppkey::varchar tl_id, 0 "number", 1 phase_index, 'e' || s_suppkey || '_1' lanes from supplier where s_suppkey <= 50""")
def network_phases(s: SparkSession, d: str) -> DataFrame:
    """A network written as XML, each light with a short and a long phase and a link given twice: the long phase's lanes
    by the last link, numbered anew."""
    p, k = path(s, "net"), F.col("s_suppkey").cast("string")
    light = F.concat(F.lit('<tlLogic id="'), k, F.lit('"><phase duration="4" state="y"/><phase duration="30" state="G"/></tlLogic>\n<connection tl="'), k, F.lit('" linkIndex="0" from="z" to="f" fromLane="9" toLane="0"/>\n<connection tl="'), k, F.lit('" linkIndex="0" from="e'), k, F.lit('" to="f" fromLane="1" toLane="0"/>'))
    lights = table(s, d, "supplier").where("s_suppkey <= 50").agg(F.array_join(F.array_sort(F.collect_list(light)), "\n").alias("x"))
    lights.select(F.concat(F.lit("<net>\n"), "x", F.lit("\n</net>")).alias("value")).coalesce(1).write.text(p)
    links, ph = readers.network(s, p)
    long_ = ph.where("duration >= 10").withColumn("number", F.row_number().over(readers.by_light()) - 1)
    g = phases.green_lanes(ph, links).join(long_.select("tl_id", "phase_index", "number"), ["tl_id", "phase_index"])
    return g.join(readers.light_ids(ph), "tl_id", "left_semi").select("tl_id", "number", "phase_index", F.array_join("green_lanes", ",").alias("lanes"))


@checked_by("select l_suppkey::varchar tl_id, l_linenumber step, sum(l_quantity)::bigint halting from lineitem group by 1, 2")
def trace_files(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "trace") + ".json"
    li = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("tl_id"), F.col("l_linenumber").alias("step"), F.lit("l").alias("lane_id"), F.col("l_quantity").cast("int").alias("halting"), F.col("l_tax").alias("waiting"), F.array(F.col("l_orderkey").cast("string")).alias("vehicle_ids"))
    sinks.jsonl(li, p)
    return readers.sim_trace(s, p).groupBy("tl_id", "step").agg(F.sum("halting").alias("halting"))


@checked_by("select true is_comparison")
def newest_comparison(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "newest")
    for i in range(2):
        sinks.csv(table(s, d, "region"), f"{p}/comparison_{i}")
    last = readers.latest_file(s, f"{p}/*", "part-*.csv")
    return s.createDataFrame([("/comparison_1/" in (last or ""),)], "is_comparison boolean")


def drained(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    p = path(s, name)
    windows.drain(stream, f"{p}/out", f"{p}/checkpoint")
    return s.read.schema(stream.schema).parquet(f"{p}/out")


STAMP = "yyyy-MM-dd HH:mm:ss"
LAST = "m as (select max(ts) - interval 10 minute m from events)"


@checked_by(f"with {LAST} select strftime(time_bucket(interval 1 hour, ts, timestamp '1970-01-01 00:05:00'), '%Y-%m-%d %H:%M:%S') w_start, event_type, count(*) n, round(sum(value), 4) total from events, m where time_bucket(interval 1 hour, ts, timestamp '1970-01-01 00:05:00') + interval 1 hour <= m group by 1, 2")
def stream_tumbling(s: SparkSession, d: str) -> DataFrame:
    """Hours shifted by a warm-up of 5 minutes, as far as the watermark has closed them."""
    r = drained(s, windows.window_kpis(windows.event_stream(s, d), "1 hour", start="5 minutes"), "tumbling")
    return r.select(F.date_format("w_start", STAMP).alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))


@checked_by(f"with {LAST}, w as (select event_type, time_bucket(interval 10 minute, ts) - to_minutes(i * 10) a from events, range(6) t(i)) select strftime(a, '%Y-%m-%d %H:%M:%S') w_start, event_type, count(*) n from w, m where a + interval 1 hour <= m group by 1, 2")
def stream_sliding(s: SparkSession, d: str) -> DataFrame:
    """Continuous collection: an hour's indicators every ten minutes."""
    r = drained(s, windows.window_kpis(windows.event_stream(s, d), "1 hour", "10 minutes"), "sliding")
    return r.select(F.date_format("w_start", STAMP).alias("w_start"), "event_type", "n")


@checked_by(f"""with {LAST}, p as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 5 minute, true) f from events), g as (select *, sum(f::int) over (partition by user_id order by ts rows unbounded preceding) k from p)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') w_start, count(*) n from g group by user_id, k having max(ts) + interval 5 minute <= (select m from m)""")
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    r = drained(s, windows.session_kpis(windows.event_stream(s, d), "5 minutes"), "sessions")
    return r.select("user_id", F.date_format("w_start", STAMP).alias("w_start"), "n")


@checked_by("""with p as (select *, lag(event_type) over (partition by user_id order by ts, event_id) prev from events), b as (select *, (prev is not null and prev <> 'click' and event_type = 'click')::int b from p)
 select user_id, event_id, c cycle_count from (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint c from b) where b = 1""")
def stream_cycles(s: SparkSession, d: str) -> DataFrame:
    return drained(s, windows.detect_cycles(windows.event_stream(s, d), "user_id", "event_type", "click"), "cycles")


@checked_by("select event_type, string_agg(event_id::varchar, ',' order by rn desc) event_ids from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events) where rn <= 20 group by 1")
def stream_ring_buffer(s: SparkSession, d: str) -> DataFrame:
    p = path(s, "ring")
    windows.drain_batches(windows.last_values(windows.event_stream(s, d), "event_type"), lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{p}/out/b{i}"), f"{p}/checkpoint")
    r = s.read.schema("event_type string, event_ids string, batch bigint").parquet(f"{p}/out/*")
    return r.groupBy("event_type").agg(F.max_by("event_ids", "batch").alias("event_ids"))


@checked_by("select event_id from events")
def stream_retained(s: SparkSession, d: str) -> DataFrame:
    """Nothing of one batch is late; repeats within 24 hours would go."""
    return drained(s, windows.retained(windows.event_stream(s, d), "event_id").select("event_id"), "retained")


@checked_by("select count(distinct user_id) n, count(distinct user_id) ids from events")
def stream_resume(s: SparkSession, d: str) -> DataFrame:
    """The same stream twice, the second time without its checkpoint: ids are written once."""
    p = path(s, "resume")
    for i in range(2):
        windows.resume_stream(windows.event_stream(s, d).select("user_id", "event_id"), f"{p}/out", f"{p}/checkpoint{i}", "user_id")
    return s.read.schema("user_id bigint").json(f"{p}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("ids"))


@checked_by("select true some_batches, count(*) \"rows\" from events")
def stream_progress(s: SparkSession, d: str) -> DataFrame:
    heard = windows.Progress()
    s.streams.addListener(heard)
    try:
        drained(s, windows.event_stream(s, d).select("event_id"), "progress")
        s.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        s.streams.removeListener(heard)
    return s.createDataFrame([(heard.batches > 0, heard.rows)], "some_batches boolean, rows bigint")


@checked_by("""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') "hour", count(*) n from events where ts >= (select min(ts) from events) + interval 90 second group by 1""")
def stream_flushed(s: SparkSession, d: str) -> DataFrame:
    """Collected with a flush every interval until all is there; what came before a warm-up of 90 s is left out."""
    import time

    p, e = path(s, "flushed"), table(s, d, "events")
    first = e.agg(F.min("ts").cast("timestamp").alias("t")).first()["t"]
    rows = windows.event_stream(s, d).where(F.col("ts") >= F.lit(first) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(90))).select("ts")
    q = windows.collect(rows, f"{p}/out", f"{p}/checkpoint", "1 second")
    q.processAllAvailable()
    q.stop()
    for _ in range(20):
        if not q.isActive:
            break
        time.sleep(0.5)
    return s.read.schema("ts timestamp").parquet(f"{p}/out").groupBy(F.date_format(F.date_trunc("hour", "ts"), STAMP).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
