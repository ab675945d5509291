"""Parsing, checks and rewards of answers against plain Python, and the reports on a fixture with known numbers."""
import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from crosslight.functions import plans, text as x
from crosslight.operators import validation

WAIT = "array<struct<phase_id:int,pred_saturation:double,min_green:int,max_green:int,capacity:int>>"


def answer(plan):
    return f"<start_working_out>why<end_working_out><SOLUTION>{plan}</SOLUTION>"


def frame(spark, rows):
    return spark.createDataFrame([(k, a, None if w is None else [(*p, 30) for p in w]) for k, a, w in rows], f"sample_id string, completion string, waits {WAIT}")


@pytest.fixture(scope="module")
def three(spark):
    """One answer without tags, one out of range, one with a phase off its target and one on it."""
    rows = [("f", "no tags at all", [(0, 0.1, 20, 60)]), ("c", answer('[{"phase_id": 1, "final": 10}]'), [(1, 0.5, 20, 60)]), ("s", answer('[{"phase_id": 2, "final": 20}, {"phase_id": 3, "final": 40}]'), [(2, 0.75, 10, 50), (3, 1.0, 10, 40)])]
    return validation.checked(frame(spark, rows), "completion", "waits")


def test_failure_buckets(three):
    d = validation.answer_details(three, "sample_id", "waits")
    assert validation.failure_buckets(d, []).first().asDict() == {"format_failure": 1, "constraint_failure": 1, "saturation_mismatch": 1, "saturation_match": 1}
    got = {(r["sample_id"], r["phase_id"]): r for r in d.collect()}
    assert {k: r["failure_bucket"] for k, r in got.items()} == {("f", 0): "format_failure", ("c", 1): "constraint_failure", ("s", 2): "saturation_mismatch", ("s", 3): "saturation_match"}
    assert (got["s", 2]["raw_target"], got["s", 2]["target_green"], got["s", 3]["target_green"]) == (38, 38, 40)
    assert validation.analysis_summary(d, []).first().asDict() == {"near_threshold": 0, "clip": 2, "clip_match": 1}
    e = {(r["category"], r["sample_id"], r["phase_id"]) for r in validation.failure_examples(d, [], None).collect()}
    assert e == {("format_failure", "f", 0), ("constraint_failure", "c", 1), ("saturation_mismatch", "s", 2), ("large_deviation", "s", 2), ("clip_sensitive", "s", 3)}


def test_summary(three):
    r = validation.validation_summary(three, []).first()
    assert (r["samples"], r["format_pass"], r["constraint_pass"], r["order_pass"], r["integer_pass"], r["range_pass"], r["evaluable"], r["passes"]) == (3, 2, 1, 2, 2, 1, 1, False)
    assert r["match_rate"] == pytest.approx(1 / 3) and r["max_dev"] == pytest.approx(0.5)  # of c, which fails, one deviation too
    assert validation.validation_summary(three.limit(0), []).first()["samples"] == 0


def test_alignment_and_clip(spark):
    rows = [("r", "a", 1, 0.8, 0.125, False, False), ("r", "b", 2, 0.5, 0.0, True, False), ("r", "c", 3, 1.0, 0.2, False, True)]
    d = spark.createDataFrame(rows, "run string, sample_id string, phase_id int, pred_saturation double, deviation double, is_match boolean, is_clip boolean").withColumn("failure_bucket", F.when(F.col("is_match"), "saturation_match").otherwise("saturation_mismatch"))
    failed = d.limit(1).withColumn("failure_bucket", F.lit("constraint_failure"))
    r = validation.threshold_alignment(d.union(failed), "run").first()
    assert (r["hard_fail"], r["hard_pass"], round(r["near_share"], 2), r["hard_fail_examples"], r["hard_pass_examples"]) == (1, 0, 0.67, "a-1", "")
    assert validation.clip_summary(d.union(failed), "run").first().asDict() == {"run": "r", "clip": 1, "clip_mismatch": 1}
    assert validation.deviation_matrix(d.union(failed), "run").first()["near_miss"] == 2


TEXTS = ['[{"phase_id":0,"final":30}]', '[{"phase_id":0,"final":30.7}]', '[{"phase_id":0,"final":true}]', '[{"phase_id":0,"final":"30"}]', '{"phase_id":0,"final":3}', '[{"phase_id":0},5]', "[1] junk", "[{'phase_id':0}]", "", "[]", '[{"phase_id":1,"final":12},{"phase_id":2,"final":80}]', '[{"phase_id":1,"final":12},{"phase_id":2,"final":20}]', '[{"phase_id":0,"final":12},{"phase_id":3,"final":20}]', '[{"final":9},{"phase_id":1,"final":2}]', '[7,{"phase_id":1,"final":20}]', "17", '"x"', '[{"phase_id":"0","final":20},{"phase_id":1,"final":20}]', '[{"phase_id":0,"final":null},{"phase_id":1,"final":20}]']


def timing(text, n, low, high):
    """What the ladder gives, by a JSON library."""
    m = re.search(r"<SOLUTION>\s*(.*?)\s*</SOLUTION>", text, re.S | re.I)
    body = (m.group(1) if m else text).strip()
    if not body:
        return "empty"
    try:
        v = json.loads(body)
    except ValueError:
        return "json"
    if not isinstance(v, list):
        return "not_list"
    if len(v) != n:
        return "length"
    for i, e in enumerate(v):
        if not isinstance(e, dict):
            return "not_object"
        for k in ("phase_id", "final"):
            if k not in e:
                return "no_" + k
        if not isinstance(e["phase_id"], int):
            return "phase_id_type"
        if not isinstance(e["final"], int | float):
            return "final_type"
        if e["phase_id"] not in (i, i + 1):
            return "order"
        if not low <= int(e["final"]) <= high:
            return "range"
    return None


def test_timing_ladder(spark):
    rows = [(wrap.format(t), n) for t in TEXTS for wrap in ("{}", "so <solution> {} </SOLUTION> end") for n in (1, 2)]
    d = spark.createDataFrame(rows, "a string, n int").select("a", "n", plans.parse_timing(F.col("a"), F.col("n"), F.lit(10), F.lit(60)).alias("p"))
    for r in d.collect():
        assert r["p"]["error"] == timing(r["a"], r["n"], 10, 60), (r["a"], r["n"])
        if r["p"]["error"] is None:
            assert r["p"]["total"] == sum(p["final"] for p in r["p"]["plan"])


def test_elements_against_json(spark):
    d = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", plans.elements(F.col("t")).alias("e"))
    for r in d.collect():
        try:
            v = json.loads(r["t"] or "")
        except ValueError:
            v = None
        assert (r["e"] is not None) == isinstance(v, list), r["t"]
        for e, w in zip(r["e"] or [], v if isinstance(v, list) else []):
            f = w.get("final") if isinstance(w, dict) else None
            assert e["is_obj"] == isinstance(w, dict) and e["final"] == (int(f) if isinstance(f, int) else None)


def test_output_errors(spark):
    rows = [("reason<end_working_out><SOLUTION>[]</SOLUTION>", None), (answer("[1]"), None), ("<start_working_out>ABC</start_working_out><SOLUTION>[]</SOLUTION>", None), ("none", "no_end_tag"), ("x<end_working_out>", "no_solution"), (answer("[{"), "bad_json"), (answer('{"a":1}'), "not_list"), (None, "no_end_tag")]
    d = spark.createDataFrame(rows, "a string, want string").select("a", "want", plans.parse_output(F.col("a")).alias("p")).collect()
    assert [r["p"]["error"] for r in d] == [r["want"] for r in d] and d[2]["p"]["think_length"] == 3


def test_constraint_errors_phase_by_phase(spark):
    w = [(0, 0.5, 10, 60), (1, 0.5, 10, 60)]
    plan = lambda *p: json.dumps([{"phase_id": i, "final": f} for i, f in p])
    cases = {plan((0, 10), (1, 60)): None, plan((0, 10)): "length", plan((1, 10), (0, 10)): "order", plan((0, "x"), (1, 10)): "whole number", plan((0, 80), (1, 10)): "range", plan((0, 80), (5, 10)): "range", "nothing": "no plan"}
    d = frame(spark, [(str(i), answer(p), w) for i, p in enumerate(cases)])
    got = {r["sample_id"]: r["e"] for r in d.select("sample_id", plans.constraint_error(plans.elements(x.solution_text(F.col("completion"))), F.col("waits")).alias("e")).collect()}
    assert [got[str(i)] for i in range(len(cases))] == list(cases.values())


def test_rewards(spark):
    w = [(0, 0.8, 10, 50), (1, 0.5, 10, 60)]
    rows = [("good", answer('[{"phase_id":0,"final":40},{"phase_id":1,"final":30}]'), w), ("order", answer('[{"phase_id":1,"final":30},{"phase_id":0,"final":40}]'), w), ("range", answer('[{"phase_id":0,"final":80},{"phase_id":1,"final":30}]'), w), ("none", "text", w), ("null", None, w), ("no phases", answer("[]"), []), ("null phases", answer("[]"), None)]
    s = {r["sample_id"]: r for r in plans.scored(frame(spark, rows), "completion", "waits").collect()}
    assert s["good"]["score_saturation"] == pytest.approx(1.4) and all(s[k]["score_saturation"] == -0.25 for k in s if k != "good")
    assert s["good"]["score_constraints"] == 2.0 > s["range"]["score_constraints"] == 1.5 > s["order"]["score_constraints"] == 1.0 > s["none"]["score_constraints"] == -2.0
    assert s["no phases"]["score_constraints"] == 0.0 and s["null phases"]["score_constraints"] == s["null"]["score_constraints"] == -2.0
    assert s["good"]["score_format_exact"] == s["order"]["score_format_exact"] == 3.0
    with pytest.raises(ValueError, match="exists"):
        plans.register_reward("saturation", lambda a, e, w: e)


def test_improvement_gate(spark):
    w = [(0, 0.8, 10, 50)]
    st = lambda *v: F.struct(*[F.lit(float(c)).alias(n) for c, n in zip(v, ("passed", "queue", "delay"))])
    d = frame(spark, [("good", answer('[{"phase_id":0,"final":40}]'), w), ("range", answer('[{"phase_id":0,"final":99}]'), w), ("none", "text", w)]).withColumn("e", plans.elements(x.solution_text(F.col("completion"))))
    s = {r["sample_id"]: r["s"] for r in d.select("sample_id", plans.score_improvement(F.col("completion"), F.col("e"), F.col("waits"), st(10, 10, 10), st(12, 10, 10)).alias("s")).collect()}
    assert s["good"] > 0 and s["range"] == s["none"] == 0.0
    null = F.lit(None).cast("struct<passed:double,queue:double,delay:double>")
    assert d.where("sample_id = 'none'").select(plans.score_improvement(F.col("completion"), F.col("e"), F.col("waits"), null, st(1, 1, 1))).first()[0] == 0.0


def test_texts(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    r = one(a=x.scenario_label(F.lit("outputs/states/arterial4x4_3/s")), b=x.scenario_label(F.lit("outputs/states/arterial4x4_10/s")), c=x.score_think_length(F.lit("x" * 350 + x.END), linear=True))
    assert (r["a"], r["b"], r["c"]) == ("unknown", "arterial4x4_10", pytest.approx(0.25))
    body = json.dumps({"prediction": {"as_of": "t", "phase_waits": [{"phase_id": 1, "pred_saturation": 0.5, "min_green": 5, "max_green": 9}, {"phase_id": 2, "pred_wait": 3.0, "pred_saturation": 1.0, "min_green": 5, "max_green": 9, "capacity": 10}]}})
    p = one(p=x.inject_pred_wait(F.lit(x.INPUT_OPEN + body + x.INPUT_CLOSE), "w"), q=x.inject_pred_wait(F.lit("no input"), "w"))
    w = json.loads(re.search(f"{x.INPUT_OPEN}(.*){x.INPUT_CLOSE}", p["p"], re.S).group(1))["prediction"]["phase_waits"]
    assert [e["pred_wait"] for e in w] == [15.0, 3.0] and p["q"] == "no input"
    with pytest.raises(Exception, match="unknown scenario"):
        spark.range(1).select(x.scenario_cfg_path(F.concat(F.lit("outputs/states/elsewhere/"), F.col("id")))).collect()


def test_flags_match_python(spark):
    """Order, whole numbers and ranges over plans of every shape."""
    w = [(0, 0.5, 10, 60), (1, 0.5, 10, 60)]
    parts = ['{"phase_id":0,"final":20}', '{"phase_id":1,"final":99}', '{"phase_id":1,"final":1.5}', "7", '{"phase_id":1}']
    texts = [f"[{','.join(p)}]" for n in range(4) for p in itertools.product(parts, repeat=n) if n < 3 or p[0] != p[1]]
    d = frame(spark, [(t, answer(t), w) for t in texts])
    for r in d.select("sample_id", plans.constraint_flags(plans.elements(x.solution_text(F.col("completion"))), F.col("waits")).alias("f")).collect():
        plan, whole, inside = json.loads(r["sample_id"]), True, True
        for (_, _, lo, hi), e in zip(w, plan):
            if not isinstance(e, dict):
                whole = inside = False
                break
            if not isinstance(e.get("final"), int):
                whole = False
            elif not lo <= e["final"] <= hi:
                inside = False
        order = [e.get("phase_id") for e in plan if isinstance(e, dict)] == [0, 1]
        assert tuple(r["f"])[:3] == (order, whole, inside), r["sample_id"]
