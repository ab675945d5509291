"""Plans in answers: native typed parsing, error ladders, checks and rewards. Everything stays in the JVM: JSON is read as
VARIANT, whose element types tell 30 from 30.0, true and "30"; only `text.plan_parse` (strict to the letter) uses Python.

A plan is an array of elements (is_obj, has_id, has_final, id_type, final_type, phase_id, final, number): `phase_id` and
`final` are null unless they are whole numbers or booleans (which count 0 and 1), `number` is any number. JSON that
repeats a key, holds NaN or goes beyond 64 bits is no plan here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import text as x, timing as t

#: Fixed value: how an answer's tags end the reasoning.
END_TAGS = r"(?:<end_working_out>|</start_working_out>)"
WHOLE = ("BIGINT", "BOOLEAN")


def whole_json(text: Column) -> Column:
    """Whether a text is JSON with nothing but blanks around it (two arrays or objects in a row pass for one)."""
    shape = text.rlike(r"(?sU)^\s*(?:\{.*\}|\[.*\]|\"[^\"]*\"|-?[0-9.eE+-]+|true|false|null)\s*$")
    return F.coalesce(shape & F.try_parse_json(text).isNotNull(), F.lit(False))


def elements(text: Column) -> Column:
    """The plan in a JSON text; null when it is no JSON array with nothing but blanks around it."""
    v = F.try_parse_json(F.when(text.rlike(r"(?sU)^\s*\[.*\]\s*$"), text))

    def one(e: Column) -> Column:
        kind = lambda k: F.schema_of_variant(F.try_variant_get(e, k, "variant"))
        it, ft = kind("$.phase_id"), kind("$.final")
        number = F.when(ft.isin(*WHOLE) | (ft == "DOUBLE") | ft.startswith("DECIMAL"), F.try_variant_get(e, "$.final", "double"))
        return F.struct(
            F.schema_of_variant(e).startswith("OBJECT").alias("is_obj"), it.isNotNull().alias("has_id"), ft.isNotNull().alias("has_final"), it.alias("id_type"), ft.alias("final_type"),
            F.when(it.isin(*WHOLE), F.try_variant_get(e, "$.phase_id", "bigint")).alias("phase_id"), F.when(ft.isin(*WHOLE), F.try_variant_get(e, "$.final", "bigint")).alias("final"), number.alias("number"),
        )

    return F.transform(F.try_variant_get(v, "$", "array<variant>"), one)


def parse_output(content: Column) -> Column:
    """(success, error, think_text, think_length, elems) of an answer. The reasoning stands between its tags, or from the
    text's start to the end tag. error, the first that holds: no_end_tag, no_solution, bad_json, not_list."""
    tagged = rf"(?s)<start_working_out>(.*?){END_TAGS}"
    ended = content.rlike(END_TAGS)
    think = F.when(content.rlike(tagged), F.regexp_extract(content, tagged, 1)).when(ended, F.regexp_extract(content, rf"(?s)^(.*?){END_TAGS}", 1))
    solution = F.when(content.rlike(r"(?s)<SOLUTION>(.*?)</SOLUTION>"), F.regexp_extract(content, r"(?s)<SOLUTION>(.*?)</SOLUTION>", 1))
    e = elements(solution)
    error = F.when(content.isNull() | ~ended, "no_end_tag").when(solution.isNull(), "no_solution").when(e.isNull() & ~whole_json(solution), "bad_json").when(e.isNull(), "not_list")
    return F.struct(error.isNull().alias("success"), error.alias("error"), think.alias("think_text"), F.when(error.isNull(), F.length(think)).alias("think_length"), e.alias("elems"))


def parse_timing(answer: Column, expected: Column, low: Column, high: Column, raw: bool = False) -> Column:
    """(error, plan, total) of an answer's timing. The JSON stands in the SOLUTION tags (any case) or, without them or
    with `raw`, is the whole answer. error is the first that holds, over the elements in order: empty, json, not_list,
    length, not_object, no_phase_id, no_final, phase_id_type, final_type, order (an element may be numbered from 0 or from
    1), range; null for a plan, whose finals are cut to whole seconds and whose total they add up to."""
    inner = r"(?isU)<SOLUTION>\s*(.*?)\s*</SOLUTION>"
    body = answer if raw else F.when(answer.rlike(inner), F.regexp_extract(answer, inner, 1)).otherwise(answer)
    body = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+|\s+$", "")
    e = elements(body)
    sec = lambda p: p["number"].cast("bigint")
    fault = lambda p, i: (
        F.when(~p["is_obj"], "not_object").when(~p["has_id"], "no_phase_id").when(~p["has_final"], "no_final").when(p["phase_id"].isNull(), "phase_id_type").when(p["number"].isNull(), "final_type")
        .when((p["phase_id"] != i) & (p["phase_id"] != i + 1), "order").when((sec(p) < low) | (sec(p) > high), "range")
    )
    first = F.get(F.filter(F.transform(e, fault), lambda c: c.isNotNull()), 0)
    error = F.when(body == "", "empty").when(e.isNull() & ~whole_json(body), "json").when(e.isNull(), "not_list").when(F.size(e) != expected, "length").otherwise(first)
    plan = F.when(error.isNull(), F.transform(e, lambda p: F.struct(p["phase_id"].alias("phase_id"), sec(p).alias("final"))))
    return F.struct(error.alias("error"), plan.alias("plan"), plan_total(plan).alias("total"))


def plan_total(plan: Column) -> Column:
    """Seconds of a plan (array of phase_id, final)."""
    return F.aggregate(plan, F.lit(0).cast("bigint"), lambda a, p: a + p["final"].cast("bigint"))


def default_plan(timing: Column) -> Column:
    """A default timing (array of number, phase_index, duration) as a plan that keeps the simulator's index."""
    return F.transform(timing, lambda p: F.struct(p["number"].cast("bigint").alias("phase_id"), p["phase_index"].alias("sumo_phase_index"), p["duration"].cast("bigint").alias("final")))


def constraint_error(elems: Column, waits: Column) -> Column:
    """The first fault of a plan against its phases, phase by phase: length, then order, whole number, range of each; null
    for none, and for no plan or phases `no plan`."""
    n = F.size(elems)
    pairs = F.zip_with(elems, waits, lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    fault = lambda y: F.when(~y["p"]["phase_id"].eqNullSafe(y["w"]["phase_id"].cast("bigint")), "order").when(y["p"]["final"].isNull(), "whole number").when(~y["p"]["final"].between(y["w"]["min_green"], y["w"]["max_green"]), "range")
    return F.when(elems.isNull() | waits.isNull(), "no plan").when(n != F.size(waits), "length").otherwise(F.get(F.filter(F.transform(pairs, fault), lambda c: c.isNotNull()), 0))


def format_flags(answer: Column) -> Column:
    """(start, end, open, close, json, all_pass): each of the four tags exactly once, and a plan that is JSON."""
    one = lambda tag: F.coalesce(F.regexp_count(answer, F.lit(tag)) == 1, F.lit(False))
    flags = {"start": one(x.START), "end": one(x.END), "open": one(x.OPEN), "close": one(x.CLOSE), "json": F.coalesce(elements(x.solution_text(answer)).isNotNull(), F.lit(False))}
    return F.struct(*[c.alias(k) for k, c in flags.items()], (flags["start"] & flags["end"] & flags["open"] & flags["close"] & flags["json"]).alias("all_pass"))


def constraint_flags(elems: Column, waits: Column) -> Column:
    """(order_ok, whole_ok, range_ok, all_pass): ids of the objects equal the phases' in order; of the elements that have
    a phase at their place, all finals whole and all whole finals within limits. No plan or phases fails all three."""
    n = F.least(F.size(elems), F.size(waits))
    pairs = F.zip_with(F.slice(elems, 1, F.greatest(n, F.lit(0))), F.slice(waits, 1, F.greatest(n, F.lit(0))), lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    ids = F.transform(F.filter(elems, lambda p: p["is_obj"]), lambda p: p["phase_id"])
    order = ids == F.transform(waits, lambda w: w["phase_id"].cast("bigint"))
    whole = F.forall(pairs, lambda y: y["p"]["is_obj"] & y["p"]["final"].isNotNull())
    objects = F.forall(pairs, lambda y: y["p"]["is_obj"])
    inside = objects & F.forall(pairs, lambda y: y["p"]["final"].isNull() | y["p"]["final"].between(y["w"]["min_green"], y["w"]["max_green"]))
    have = elems.isNotNull() & waits.isNotNull()
    ok = [F.coalesce(have & c, F.lit(False)) for c in (order, whole, inside)]
    return F.struct(ok[0].alias("order_ok"), ok[1].alias("whole_ok"), ok[2].alias("range_ok"), (ok[0] & ok[1] & ok[2]).alias("all_pass"))


def saturation_of(wait: Column) -> Column:
    """The predicted saturation of a phase, 0 where it is missing or NaN."""
    return F.coalesce(F.nanvl(wait["pred_saturation"], F.lit(0.0)), F.lit(0.0))


def phase_details(elems: Column, waits: Column) -> Column:
    """Array of details of each phase: target, deviation, match and clip flag (the target lies on a limit). Null where
    plan and phases differ in number or a final is not whole; `final` without a plan is null."""
    def one(p: Column, w: Column) -> Column:
        raw, target = t.half_even(w["max_green"] * F.greatest(F.lit(0.0), saturation_of(w))), t.target_green(saturation_of(w), w["min_green"], w["max_green"])
        d = t.deviation(p["final"], target, w["min_green"], w["max_green"])
        return F.struct(w["phase_id"].alias("phase_id"), saturation_of(w).alias("pred_saturation"), w["min_green"].alias("min_green"), w["max_green"].alias("max_green"), raw.alias("raw_target"), target.alias("target_green"), p["final"].alias("final"), d.alias("deviation"), (d <= 0.1).alias("is_match"), target.isin(w["min_green"], w["max_green"]).alias("is_clip"))

    ok = (F.size(elems) == F.size(waits)) & F.forall(elems, lambda p: p["final"].isNotNull())
    return F.when(F.coalesce(ok, F.lit(False)), F.zip_with(elems, waits, one))


def score_constraints(elems: Column, waits: Column, order_weight: float = 1.0, range_weight: float = 1.0) -> Column:
    """Share of phases in place (0 if the numbers of objects and phases differ) and share of the plan's elements within
    the limits of the first phase of their id; -2 without a plan or phases, 0 for no phases."""
    objects = F.filter(elems, lambda p: p["is_obj"])
    at = F.size(F.filter(F.zip_with(objects, waits, lambda p, w: p["phase_id"] == w["phase_id"]), lambda y: y))
    own = lambda p: F.get(F.filter(waits, lambda w: w["phase_id"] == p["phase_id"]), 0)
    ok = F.size(F.filter(objects, lambda p: F.coalesce(p["final"].between(own(p)["min_green"], own(p)["max_green"]), F.lit(False))))
    order = F.when(F.size(objects) == F.size(waits), F.try_divide(at, F.size(waits)) * order_weight).otherwise(0.0)
    return F.when(elems.isNull() | waits.isNull(), -2.0).when(F.size(waits) == 0, 0.0).otherwise(order + ok / F.greatest(F.size(elems), F.lit(1)) * range_weight)


def score_saturation(elems: Column, waits: Column, most: float = 1.0, invalid: float = -0.25, **bonuses: float) -> Column:
    """Mean of the phases' scores times `most`; `invalid` unless the plan has the phases' number, order and whole finals
    within limits, and for no phases. `bonuses` go to `phase_sat_score`."""
    ok = F.coalesce(constraint_error(elems, waits).isNull() & (F.size(waits) > 0), F.lit(False))
    each = F.zip_with(elems, waits, lambda p, w: t.phase_sat_score(p["final"], t.target_green(saturation_of(w), w["min_green"], w["max_green"]), w["min_green"], w["max_green"], **bonuses))
    return F.when(ok, F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(waits) * most).otherwise(invalid)


def improvement_gate(answer: Column, elems: Column, waits: Column) -> Column:
    """Whether an answer earns the score of its outcome: exact format, ids in order, every element within the limits."""
    inside = F.forall(elems, lambda p: F.exists(waits, lambda w: (w["phase_id"] == p["phase_id"]) & p["final"].between(w["min_green"], w["max_green"])))
    return F.coalesce(answer.rlike(x.FORMAT) & constraint_flags(elems, waits)["order_ok"] & inside, F.lit(False))


def score_improvement(answer: Column, elems: Column, waits: Column, base: Column, now: Column, **weights: float) -> Column:
    """The outcome's improvement behind its gate, 0 otherwise; a missing baseline raises only behind the gate."""
    return F.when(improvement_gate(answer, elems, waits), t.improvement_score(base, now, **weights)).otherwise(0.0)


#: A reward takes the columns of answer, plan elements and phases and gives a score.
Reward = Callable[[Column, Column, Column], Column]
REWARDS: dict[str, Reward] = {
    "format_exact": lambda a, e, w: x.score_format_exact(a),
    "format_approx": lambda a, e, w: x.score_format_approx(a),
    "constraints": lambda a, e, w: score_constraints(e, w),
    "saturation": lambda a, e, w: score_saturation(e, w),
    "think_length": lambda a, e, w: x.score_think_length(a),
}


def register_reward(name: str, f: Reward) -> None:
    """Adds a reward; a name that is taken raises."""
    if name in REWARDS:
        raise ValueError(f"reward {name} exists")
    REWARDS[name] = f


def scored(df, answer: str, waits: str, names: list[str] | None = None):  # noqa: ANN001, ANN201
    """`df` with one column `score_<name>` for each reward; the plan is parsed once. Null answers count as empty."""
    a = F.coalesce(F.col(answer), F.lit(""))
    d = df.withColumn("__e", elements(x.solution_text(a)))
    for n in names or list(REWARDS):
        d = d.withColumn(f"score_{n}", REWARDS[n](a, F.col("__e"), F.col(waits)))
    return d.drop("__e")


def register_plan_udtf(spark) -> None:  # noqa: ANN001
    """SQL function plan_phases(answer): one row (pos, phase_id, final) for each element of the plan in an answer's
    tags, as strict as a JSON library; an answer without a plan gives no rows."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, phase_id bigint, final bigint")
    class PlanPhases:
        def eval(self, answer: str):  # noqa: ANN201
            import re

            m = re.search(r"<SOLUTION>(.*?)</SOLUTION>", answer or "", re.S)
            plan = x._plan(m.group(1)) if m else {"is_list": False}
            for i, e in enumerate(plan["elems"] or [] if plan["is_list"] else []):
                yield i, e["phase_id"], e["final"]

    spark.udtf.register("plan_phases", PlanPhases)
