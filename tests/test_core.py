import json

import pytest
from pyspark.sql import functions as F

from crosslight.functions import text as x, timing as t
from crosslight.operators import augment, metrics, phases, sampling, traces, validation
from crosslight.sources import readers, sinks
from crosslight.streaming import windows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_target_green(spark):
    L = F.lit
    r = one(spark, a=t.target_green(L(0.1), L(5), L(100)), b=t.target_green(L(0.1), L(20), L(100)), c=t.target_green(L(1.5), L(10), L(60)), d=t.target_green(L(0.75), L(5), L(50)), e=t.target_green(L(0.25), L(5), L(50)))
    assert tuple(r) == (10, 20, 60, 38, 12)


def test_phase_score(spark):
    got = [one(spark, s=t.phase_sat_score(F.lit(f), F.lit(40), F.lit(10), F.lit(50)))["s"] for f in (40, 41, 44, 45, 48, 50)]
    assert got == pytest.approx([1.4, 1.15, 0.8, 0.0, 0.0, 0.0])


def test_weighted(spark):
    d = spark.createDataFrame([(10.0, 1.0), (20.0, 2.0), (30.0, 3.0)], "v double, w double")
    assert d.agg(metrics.weighted_average(F.col("v"), F.col("w"))).first()[0] == pytest.approx(23.3333333)
    z = spark.createDataFrame([(10.0, 1.0), (20.0, 0.0), (30.0, 3.0)], "v double, w double")
    assert z.agg(metrics.weighted_average(F.col("v"), F.col("w"))).first()[0] == 25.0
    assert d.limit(0).agg(metrics.weighted_average(F.col("v"), F.col("w"))).first()[0] == 0.0
    c = spark.createDataFrame([(10, 100.0, 60, 120), (20, 200.0, 30, 60), (7, 7.0, 7, 0)], "q int, d double, p int, s int")
    r = metrics.weighted_metrics(c, [], F.col("q"), F.col("d"), F.col("p"), F.col("s")).first()
    assert r["avg_queue"] == pytest.approx(13.3333333) and r["avg_delay"] == pytest.approx(133.3333333) and r["throughput"] == 0.5 and (r["total_cycles"], r["total_duration"]) == (3, 180)


PLANS = ['[{"phase_id":0,"final":30}]', '[{"phase_id":0,"final":30.0}]', '[{"phase_id":0,"final":true}]', '[{"phase_id":0,"final":"30"}]', '{"phase_id":0,"final":3}', '[{"phase_id":0},5]', '[1] junk', "[{'phase_id':0}]", "", "[]", None]


def test_plan_parser_against_json(spark):
    d = spark.createDataFrame([(p,) for p in PLANS], "p string").select("p", x.plan_parse("p").alias("r"), x.plan_native(F.col("p")).alias("n"))
    for row in d.collect():
        try:
            v = json.loads(row["p"] or "")
        except ValueError:
            v = None
        assert row["r"]["is_list"] == isinstance(v, list) == row["n"], row["p"]
        if isinstance(v, list) and v and isinstance(v[0], dict):
            f = v[0].get("final")
            assert row["r"]["elems"][0]["final"] == (int(f) if isinstance(f, int) else None)


def test_output_parsing(spark):
    a = F.lit("<start_working_out>ABC<end_working_out><SOLUTION>[]</SOLUTION>\u3000")
    r = one(spark, t=x.think_text(a), s=x.solution_text(a), e=x.score_format_exact(a), n=x.solution_text(F.lit("no plan")), ap=x.score_format_approx(a))
    assert tuple(r) == ("ABC", "[]", 3.0, None, 1.5)


def test_details_and_buckets(spark):
    d = spark.createDataFrame([(1, 0, 0.8, 10, 50, 40), (1, 1, 0.5, 10, 50, 90), (2, 0, 0.5, 10, 50, None), (3, 0, 0.5, 10, 50, 25), (4, 0, 0.1, 10, 50, 10), (4, 1, None, 10, 50, 30)], "sample_id int, phase_id int, pred_saturation double, min_green int, max_green int, final int").withColumn("run", F.lit("r"))
    v = validation.phase_details(d)
    assert {(r["sample_id"], r["phase_id"]) for r in v.where("is_clip").collect()} == {(4, 0), (4, 1)}
    s = validation.status_details(v, ["run"], F.col("sample_id") != 3)
    assert validation.failure_buckets(s, ["run"]).first().asDict() == {"run": "r", "format_failure": 1, "constraint_failure": 2, "saturation_mismatch": 1, "saturation_match": 1}
    assert s.count() == 5 and validation.status_details(v.limit(0), ["run"]).count() == 0


def test_run_checks(spark):
    d = spark.createDataFrame([("a", 50, 50, "x", 0.98), ("b", 2000, 2000, "y", 0.55)], "run string, total_samples int, manifest_size int, sample_mode string, match_rate double")
    with pytest.raises(ValueError, match="sample_mode"):
        validation.check_runs(d)
    assert validation.run_comparison(d).orderBy("run").collect()[1]["delta"] == -0.43


def test_stratified_sample_is_exact_and_stable(spark):
    d = spark.range(200).select("id", (F.col("id") % 5).alias("tl"), (F.col("id") % 3).alias("b"))
    a, b = (sorted(r["id"] for r in sampling.stratified_sample(d.repartition(n), ["tl", "b"], "id", 50).collect()) for n in (1, 8))
    assert a == b and len(a) == 50 and sampling.stratified_sample(d, ["tl", "b"], "id", 500).count() == 200


def test_cycles_and_mutex(spark):
    s = spark.createDataFrame([("a", i, p) for i, p in enumerate([2, 0, 1, 2, 0, 0, 1])], "tl string, step int, phase int")
    assert [r["cycle_count"] for r in traces.cycle_boundaries(s, "tl", ["step"], "phase", 0).orderBy("step").collect()] == [0, 1, 1, 1, 2, 2, 2]
    p = spark.createDataFrame([("n", 0, 0, ["a"]), ("n", 1, 2, ["b"]), ("n", 2, 4, ["b", "c"]), ("n", 3, 6, ["c", "b", "d"]), ("n", 4, 8, ["a", "z"])], "tl_id string, pos int, phase_index int, green_lanes array<string>")
    r = phases.greedy_mutex(p).first()
    assert r["kept"] == [8, 6] and not r["tossed"]


def test_network_and_logs(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<net>\n<tlLogic id="t"><phase duration="30" state="Gr"/><phase duration="4" state="yr" minDur="3"/></tlLogic>\n<connection tl="t" linkIndex="0" from="e" to="f" fromLane="1" toLane="0"/>\n</net>')
    links, ph = readers.network(spark, str(tmp_path / "n.xml"))
    assert phases.green_lanes(ph, links).orderBy("phase_index").collect()[0]["green_lanes"] == ["e_1"]
    assert [r["number"] for r in readers.default_timing(ph, "t").collect()] == [0]
    (tmp_path / "log.txt").write_text("x\n{'loss': 0.5, 'reward': 1.2, 'reward_std': 0.3}\n{\"reward\": 2.0, \"reward_std\": 0}\n{reward reward_std\n")
    assert sorted(r["reward"] for r in readers.train_log(spark, str(tmp_path / "log.txt")).collect()) == [1.2, 2.0]
    sinks.split(spark.range(4), F.col("id") > 1, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("keep = 'true'").count() == 2


def test_augment(spark):
    d = augment.explode_phases(augment.synthesize(spark, 300), "sample_id", "phase_waits")
    assert d.where("min_green > max_green or pred_saturation < 0 or pred_saturation > 2.5 or max_green > 150").count() == 0
    a = spark.createDataFrame([(1, 0, "bad", False, False), (1, 1, "ok", True, False), (2, 0, "x", False, True), (3, 0, "y", False, False)], "id int, attempt int, content string, valid boolean, failed boolean")
    assert [(r["id"], r["status"]) for r in augment.first_valid_attempt(a).orderBy("id").collect()] == [(1, "success"), (2, "api_error"), (3, "constraint_failed")]


def test_perturbations_are_independent_and_in_proportion(spark):
    k = F.col("id")
    d = spark.range(20000).select(augment.perturb_green(F.lit(30), F.lit(90), k).alias("g"), augment.perturb_saturation(F.lit(0.9), k).alias("s"), augment.diversify(F.expr("array(named_struct('phase_id',0,'pred_saturation',0.9D,'min_green',30,'max_green',90,'capacity',30), named_struct('phase_id',7,'pred_saturation',null,'min_green',30,'max_green',90,'capacity',30))"), k).alias("w"))
    r = d.agg(F.min("g.min_green").alias("a"), F.max("g.max_green").alias("b"), F.min(F.col("g.max_green") > 0).alias("c"), F.avg((F.col("g.max_green") - F.col("g.min_green")).cast("double")).alias("m"), F.avg((F.col("s") < 0.35).cast("double")).alias("low"), F.corr(F.col("g.min_green").cast("double"), F.col("s")).alias("r"), F.countDistinct(F.col("w")[0]["phase_id"]).alias("ids"), F.min(F.col("w")[1]["phase_id"]).alias("lo"), F.max(F.col("w")[1]["phase_id"]).alias("hi")).first()
    assert r["a"] >= 5 and r["b"] <= 150 and abs(r["low"] - (0.2 * 0.175 + 0.2)) < 0.015 and abs(r["r"]) < 0.03
    assert r["ids"] == 6 and (r["lo"], r["hi"]) == (8, 12)


def test_filters_and_joins(spark):
    from crosslight.operators import filters, joins

    w = "array<struct<pred_saturation:double>>"
    d = spark.createDataFrame([(1, [(0.05,), (0.02,)]), (2, [(0.5,)]), (3, [(0.5,), (None,)]), (4, None), (5, []), (6, [(float("nan"),)])], f"id int, w {w}")
    assert {r["id"] for r in d.where(filters.low_traffic(F.col("w"))).collect()} == {1, 3, 4, 5, 6}
    with pytest.raises(ValueError, match="unknown: z"):
        filters.select_named(spark.createDataFrame([("a",)], "n string"), "n", ["a", "z"])
    with pytest.raises(ValueError, match="fewer"):
        filters.integrity_gates({"t": spark.range(3)}, 10)
    with pytest.raises(ValueError, match="weights"):
        filters.integrity_gates({}, 10, {"a": 0.5})
    with pytest.raises(ValueError, match="indices"):
        joins.zip_by_index(spark.range(3), spark.range(4), "id")
    n = joins.numbered(spark.range(1000).repartition(7), ["id"], "i")
    assert n.where("i <> id").count() == 0 and n.count() == 1000 and joins.numbered(spark.range(0), ["id"], "i").count() == 0
    assert sampling.bootstrap_sample(spark.range(0), "id", 5).count() == 0 and sampling.bootstrap_sample(spark.range(3), "id", 50).groupBy("id").count().count() == 3


def test_vehicles_and_traces(spark):
    t = spark.createDataFrame([("a", 1, "l", 2, 1.0, ["x", "y"]), ("a", 1, "m", 0, 1.0, ["z"]), ("a", 2, "l", 1, 2.0, ["y", "q"]), ("b", 5, "l", 0, 0.0, None), ("c", 1, "l", 1, 1.0, []), ("c", 2, "l", 3, 1.0, ["k"])], "tl string, step int, lane_id string, halting int, waiting double, vehicle_ids array<string>")
    got = {r["tl"]: (r["passed"], r["avg_queue"], r["total_delay"], r["duration"]) for r in traces.cycle_metrics(t, ["tl"]).collect()}
    assert got == {"a": (2, 1.5, 4.0, 2), "b": (0, 0.0, 0.0, 1), "c": (0, 2.0, 2.0, 2)}
    assert {r["tl"]: (r["passed"], r["queue"]) for r in traces.plan_outcome(t, ["tl"]).collect()} == {"a": (2, 1), "b": (0, 0), "c": (0, 3)}
    assert traces.cycle_metrics(t.limit(0), ["tl"]).count() == 0


def test_cycle_counts_with_resets():
    import numpy as np

    p = np.array(["b", "a", "b", "a", "b", "a"], object)
    hit, total = windows.boundaries(p, "", "a")
    assert list(total) == [0, 1, 1, 2, 2, 3] and list(np.flatnonzero(hit)) == [1, 3, 5]
    hit, total = windows.boundaries(p, "b", "a", np.array([False, False, False, True, False, False]))
    assert list(np.flatnonzero(hit)) == [1, 5] and list(total) == [0, 1, 1, 0, 0, 1]


def test_configs_and_reports(spark, tmp_path):
    assert readers.load_config(str(tmp_path / "none.json")) == readers.BenchmarkConfig()
    (tmp_path / "c.json").write_text('{"simulation": {"cycle_duration": 30}, "logging": {"level": "debug"}}')
    c = readers.load_config(str(tmp_path / "c.json"))
    assert (c.cycle_duration, c.log_level, c.warmup_seconds) == (30, "debug", 300)
    (tmp_path / "c.json").write_text('{"simulation": {"cycle_duration": 0, "warmup_seconds": 9999}}')
    with pytest.raises(ValueError, match="cycle_duration, simulation_seconds"):
        readers.load_config(str(tmp_path / "c.json"))
    (tmp_path / "m.json").write_text('{"models": ["a", {"name": "b", "structured_output": false}]}')
    assert readers.load_models(str(tmp_path / "m.json")) == [("a", True), ("b", False)]
    (tmp_path / "s.sumocfg").write_text('<configuration><input><net-file value="n/x.net.xml"/><route-files value="a.xml, b.xml"/></input><time><end value="900"/></time></configuration>')
    assert readers.network_path(str(tmp_path / "s.sumocfg")).endswith("/n/x.net.xml") and readers.simulation_end(str(tmp_path / "s.sumocfg")) == 900
    out = readers.rewritten_config(str(tmp_path / "s.sumocfg"), str(tmp_path / "t.sumocfg"), end=60)
    assert readers.simulation_end(out) == 60 and readers.network_path(out) == readers.network_path(str(tmp_path / "s.sumocfg"))
    assert sinks.report(spark.range(2500), "T").count("|\n") == 2502
    with pytest.raises(ValueError, match="more than 10"):
        sinks.report(spark.range(11), "T", 10)


def test_results_of_any_columns(spark, tmp_path):
    for name, text in {"r1/a.csv": 'x,model,avg_delay\n1,"m, one",2.5\n2,m2,\n', "r2/b.csv": "avg_delay,model\n7,m3\n", "r2/summary.csv": "model\nno\n", "r3/c.csv": "model\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    r = readers.result_csvs(spark, str(tmp_path))
    assert sorted((x["model"], x["avg_delay"], x["throughput"]) for x in r.collect()) == [("m, one", "2.5", ""), ("m2", "", ""), ("m3", "7", "")]


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from crosslight import scratch

    conf = SimpleNamespace(get=lambda k, d=None: d)
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None, getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(far)
    assert scratch.folder(spark)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(i, f"2026-01-01 00:{i:02d}:00", 1, "abc"[i % 3], 1.0) for i in range(12)]
    d = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.expr("cast(ts as timestamp_ntz)"))
    d.coalesce(1).write.parquet(str(src / "events.parquet"))
    st = spark.readStream.schema(d.schema).parquet(str(src / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    windows.drain(windows.detect_cycles(st, "user_id", "event_type", "a"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["cycle_count"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3]
    windows.drain(windows.window_kpis(st, "5 minutes", late="0 seconds", by=()), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).agg(F.sum("n")).first()[0] == 10


def test_entry_without_training_data_package(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "crosslight.llm", None)
    monkeypatch.delitem(sys.modules, "crosslight.llm.queries", raising=False)
    assert not any(k.startswith("p1_") for k in e.queries()) and "weighted_metrics" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
