"""Queries over real answers: teachers' results with the phases of their samples. SQL reads the plans with DuckDB's JSON
functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import plans, text as x, timing as t
from ..operators import augment, filters, joins, metrics, validation
from .registry import checked_by, query, table

WORDING = "Time the signals."

#: Answers with their plan: e is null where the text is no JSON list. DuckDB passes a comma before a closing bracket, which
#: is no JSON.
A = r"""a0 as (select r.result_id, r.source, r.status, coalesce(r.raw_content, '') a, s.prediction.phase_waits w, case when regexp_matches(coalesce(r.raw_content, ''), '(?s)<SOLUTION>.*</SOLUTION>') then regexp_extract(r.raw_content, '(?s)<SOLUTION>(.*?)</SOLUTION>', 1) end sol
  from teacher_results r join train_samples s using (rec_id)),
 a1 as (select *, case when (json_valid(sol) and not regexp_matches(sol, ',\s*[}\]]')) and json_type(sol) = 'ARRAY' then list_transform(json_extract(sol, '$[*]'), lambda j: {'is_obj': json_type(j) = 'OBJECT', 'it': json_type(j, '$.phase_id'), 'ft': json_type(j, '$.final'),
  'phase_id': case when json_type(j, '$.phase_id') in ('UBIGINT', 'BIGINT') then try_cast(j->>'$.phase_id' as bigint) when json_type(j, '$.phase_id') = 'BOOLEAN' then (j->>'$.phase_id' = 'true')::bigint end,
  'final': case when json_type(j, '$.final') in ('UBIGINT', 'BIGINT') then try_cast(j->>'$.final' as bigint) when json_type(j, '$.final') = 'BOOLEAN' then (j->>'$.final' = 'true')::bigint end,
  'number': case when json_type(j, '$.final') in ('UBIGINT', 'BIGINT', 'DOUBLE') then try_cast(j->>'$.final' as double) when json_type(j, '$.final') = 'BOOLEAN' then (j->>'$.final' = 'true')::int::double end}) end e from a0),
 ph as (select result_id, source, len(e) ne, len(w) nw, i, case when i <= len(e) then e[i] end p, case when i <= len(w) then w[i] end q from (select *, unnest(range(1, greatest(len(e), len(w)) + 1)) i from a1 where e is not null)),
 pt as (select *, case when q.pred_saturation is null or isnan(q.pred_saturation) then 0 else q.pred_saturation end sat from ph),
 tg as (select *, round_even(q.max_green * greatest(0, sat), 0)::bigint raw, least(greatest(round_even(q.max_green * greatest(0, sat), 0), q.min_green), q.max_green)::bigint target from pt)"""
ONCE = lambda tag: f"(length(a) - length(replace(a, '{tag}', ''))) = {len(tag)}"
FM = A + f""", fm as (select result_id, {ONCE(x.START)} s, {ONCE(x.END)} n, {ONCE(x.OPEN)} o, {ONCE(x.CLOSE)} c, e is not null j from a1),
 fa as (select *, s and n and o and c and j f from fm)"""
CS = """ck as (select result_id, bool_and(p.is_obj and p.final is not null) whole, bool_and(p.is_obj) and bool_and(p.final is null or p.final between q.min_green and q.max_green) inside from ph where i <= ne and i <= nw group by 1),
 co as (select result_id, e is not null and list_transform(list_filter(e, lambda p: p.is_obj), lambda p: p.phase_id) = list_transform(w, lambda q: q.phase_id::bigint) ord, e is not null has from a1),
 cs as (select result_id, coalesce(ord, false) ord, has and coalesce(whole, true) whole, has and coalesce(inside, true) inside, coalesce(ord, false) and has and coalesce(whole, true) and coalesce(inside, true) c from co left join ck using (result_id)),
 ev as (select result_id from tg group by 1 having max(ne) = max(nw) and bool_and(p.final is not null)),
 de as (select tg.*, abs(p.final - target) / greatest(q.max_green - q.min_green, 1)::double d, target in (q.min_green, q.max_green) clip from tg join ev using (result_id))"""


def answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "teacher_results").select("result_id", "rec_id", "source", "status", "raw_content").join(table(s, d, "train_samples").select("rec_id", "prediction.phase_waits"), "rec_id")


def checked(s: SparkSession, d: str) -> DataFrame:
    return validation.checked(answers(s, d), "raw_content", "phase_waits")


@checked_by(rf"""with {A}, p as (select result_id, sol, e, case when regexp_matches(a, '(?s)<start_working_out>.*?(<end_working_out>|</start_working_out>)') then regexp_extract(a, '(?s)<start_working_out>(.*?)(<end_working_out>|</start_working_out>)', 1)
  when regexp_matches(a, '<end_working_out>|</start_working_out>') then regexp_extract(a, '(?s)^(.*?)(<end_working_out>|</start_working_out>)', 1) end think from a1),
 q as (select *, case when think is null then 'no_end_tag' when sol is null then 'no_solution' when e is null and not (json_valid(sol) and not regexp_matches(sol, ',\s*[}}\]]')) then 'bad_json' when e is null then 'not_list' end error from p)
 select result_id, error is null success, coalesce(error, '') error, coalesce(length(think), -1)::bigint think_chars, coalesce(len(e), -1)::bigint n from q""")
def parse_output(s: SparkSession, d: str) -> DataFrame:
    p = answers(s, d).select("result_id", plans.parse_output(F.coalesce("raw_content", F.lit(""))).alias("p"))
    return p.select("result_id", "p.success", F.coalesce("p.error", F.lit("")).alias("error"), F.coalesce(F.length("p.think_text"), F.lit(-1)).cast("bigint").alias("think_chars"), F.coalesce(F.size("p.elems"), F.lit(-1)).cast("bigint").alias("n"))


@checked_by(rf"""with {A}, b as (select result_id, w, list_min(list_transform(w, lambda q: q.min_green)) lo, list_max(list_transform(w, lambda q: q.max_green)) hi, trim(case when regexp_matches(a, '(?is)<solution>.*?</solution>') then regexp_extract(a, '(?is)<solution>\s*(.*?)\s*</solution>', 1) else a end, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) body from a0),
 l as (select *, case when (json_valid(body) and not regexp_matches(body, ',\s*[}}\]]')) and json_type(body) = 'ARRAY' then json_extract(body, '$[*]') end e from b),
 f as (select result_id, i, case when json_type(j) <> 'OBJECT' then 'not_object' when json_type(j, '$.phase_id') is null then 'no_phase_id' when json_type(j, '$.final') is null then 'no_final' when json_type(j, '$.phase_id') not in ('UBIGINT', 'BIGINT', 'BOOLEAN') then 'phase_id_type'
  when json_type(j, '$.final') not in ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') then 'final_type' when id <> i - 1 and id <> i then 'order' when num < lo or num > hi then 'range' end fault, num
  from (select *, case when json_type(j, '$.phase_id') = 'BOOLEAN' then (j->>'$.phase_id' = 'true')::bigint else try_cast(j->>'$.phase_id' as bigint) end id, case when json_type(j, '$.final') = 'BOOLEAN' then (j->>'$.final' = 'true')::bigint else trunc(try_cast(j->>'$.final' as double))::bigint end num
  from (select result_id, lo, hi, i, e[i] j from (select *, unnest(range(1, len(e) + 1)) i from l where e is not null)))),
 g as (select result_id, arg_min(fault, i) filter (fault is not null) fault, sum(num)::bigint total from f group by 1),
 r as (select l.result_id, case when body = '' then 'empty' when e is null and not (json_valid(body) and not regexp_matches(body, ',\s*[}}\]]')) then 'json' when e is null then 'not_list' when len(e) <> len(w) then 'length' else fault end error, coalesce(total, 0) total from l left join g using (result_id))
 select result_id, coalesce(error, '') error, case when error is null then total else -1 end total from r""")
def parse_timing(s: SparkSession, d: str) -> DataFrame:
    lo, hi = F.array_min(F.transform("phase_waits", lambda w: w["min_green"])), F.array_max(F.transform("phase_waits", lambda w: w["max_green"]))
    p = answers(s, d).select("result_id", plans.parse_timing(F.coalesce("raw_content", F.lit("")), F.size("phase_waits"), lo, hi).alias("p"))
    return p.select("result_id", F.coalesce("p.error", F.lit("")).alias("error"), F.coalesce("p.total", F.lit(-1).cast("bigint")).alias("total"))


@checked_by(f"""with {A}, f as (select result_id, arg_min(k, i) filter (k is not null) k from (select result_id, i, case when p.phase_id is distinct from q.phase_id then 'order' when p.final is null then 'whole number' when p.final not between q.min_green and q.max_green then 'range' end k from ph where ne = nw) group by 1)
 select result_id, coalesce(case when e is null or w is null then 'no plan' when len(e) <> len(w) then 'length' else k end, 'none') error from a1 left join f using (result_id)""")
def plan_constraints(s: SparkSession, d: str) -> DataFrame:
    e = plans.elements(x.solution_text(F.coalesce("raw_content", F.lit(""))))
    return answers(s, d).select("result_id", F.coalesce(plans.constraint_error(e, F.col("phase_waits")), F.lit("none")).alias("error"))


@checked_by(f"with {FM} select result_id, s \"start\", n \"end\", o \"open\", c \"close\", j \"json\", f all_pass from fa")
def format_flags(s: SparkSession, d: str) -> DataFrame:
    return answers(s, d).select("result_id", plans.format_flags(F.coalesce("raw_content", F.lit(""))).alias("f")).select("result_id", "f.*")


@checked_by(f"with {A}, {CS} select result_id, ord order_ok, whole whole_ok, inside range_ok, c all_pass from cs")
def constraint_checks(s: SparkSession, d: str) -> DataFrame:
    return checked(s, d).select("result_id", "cst.*")


@checked_by(f"with {A}, {CS} select result_id, (i - 1)::bigint pos, q.phase_id::bigint phase_id, raw raw_target, target target_green, p.final final, round(d, 6) deviation, d <= 0.1::double is_match, clip is_clip from de")
def saturation_checks(s: SparkSession, d: str) -> DataFrame:
    p = checked(s, d).select("result_id", F.posexplode("details").alias("pos", "p"))
    return p.select("result_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.phase_id").cast("bigint").alias("phase_id"), "p.raw_target", "p.target_green", "p.final", F.round("p.deviation", 6).alias("deviation"), "p.is_match", "p.is_clip")


SCORES = """ob as (select result_id, list_filter(e, lambda p: p.is_obj) o, w, len(e) n from a1 where e is not null),
 at_ as (select result_id, count(*) filter (o[i].phase_id = w[i].phase_id) k from (select *, unnest(range(1, least(len(o), len(w)) + 1)) i from ob) group by 1),
 inr as (select result_id, count(*) filter (f between r.min_green and r.max_green) k from (select result_id, o[i].final f, list_filter(w, lambda q: q.phase_id = o[i].phase_id)[1] r from (select *, unnest(range(1, len(o) + 1)) i from ob)) group by 1),
 sc as (select a1.result_id, case when a1.e is null or a1.w is null then -2.0::double when len(a1.w) = 0 then 0.0::double else case when len(ob.o) = len(a1.w) then coalesce(at_.k, 0) / len(a1.w)::double else 0.0::double end + coalesce(inr.k, 0) / greatest(n, 1)::double end v from a1 left join ob using (result_id) left join at_ using (result_id) left join inr using (result_id)),
 sp as (select result_id, target, p, q, abs(p.final - target) / greatest(q.max_green - q.min_green, 1)::double d from tg where ne = nw),
 ss as (select result_id, bool_and(p.phase_id = q.phase_id and p.final is not null and p.final between q.min_green and q.max_green) ok, avg(greatest(0, case when d <= 0.05::double then 1 when d <= 0.1::double then 0.8::double when d <= 0.2::double then greatest(0, 0.3::double - (d - 0.1::double) * 3) else 0 end
  - case when d > 0.1::double and d <= 0.2::double then 0.35::double * (0.2::double - d) / 0.1::double else 0 end + case abs(p.final - target) when 0 then 0.4::double when 1 then 0.15::double else 0 end)) v from sp group by 1)"""


@checked_by(rf"""with {FM}, {SCORES} select a1.result_id, round(sc.v, 6) score_constraints, round(case when ss.ok then ss.v else -0.25 end, 6) score_saturation,
 case when regexp_matches(a, '(?s)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>[\s\x{{3000}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]*$') then 3.0::double else 0.0::double end score_format_exact from a1 join sc using (result_id) left join ss using (result_id)""")
def reward_scores(s: SparkSession, d: str) -> DataFrame:
    r = plans.scored(answers(s, d), "raw_content", "phase_waits", ["constraints", "saturation", "format_exact"])
    return r.select("result_id", F.round("score_constraints", 6).alias("score_constraints"), F.round("score_saturation", 6).alias("score_saturation"), "score_format_exact")


@checked_by(rf"""with {A}, {CS}, g as (select a1.result_id, regexp_matches(a, '(?s)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>[\s\x{{3000}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]*$') and ord and coalesce(len(list_filter(e, lambda p: not coalesce(len(list_filter(w, lambda q: q.phase_id = p.phase_id and p.final between q.min_green and q.max_green)) > 0, false))) = 0, false) ok, list_sum(list_transform(e, lambda p: p.final)) total from a1 join cs using (result_id)),
 v as (select *, 0.3::double * (result_id % 7 - 3) / 10.0::double + 0.4::double * (total - 60) / total::double x from g) select result_id, round(case when not ok then 0 when x >= 0 then ln(1 + x) / ln(2) * 5 else greatest(x * 5, -2.5) end, 6) score from v""")
def gated_improvement(s: SparkSession, d: str) -> DataFrame:
    """The outcome's score behind its gate; baseline and outcome are made up from ids and plans, delays are 0."""
    c = checked(s, d).withColumn("total", F.aggregate("elems", F.lit(0).cast("bigint"), lambda a, p: a + p["final"]))
    st = lambda p, q: F.struct(p.cast("double").alias("passed"), q.cast("double").alias("queue"), F.lit(0.0).alias("delay"))
    v = plans.score_improvement(F.coalesce("raw_content", F.lit("")), F.col("elems"), F.col("phase_waits"), st(F.lit(10), F.col("total")), st(F.lit(10) + F.col("result_id") % 7 - 3, F.lit(60)))
    return c.select("result_id", F.round(v, 6).alias("score"))


@checked_by(f"""with {FM}, {CS}, g as (select coalesce(source, '(none)') source, count(*) samples, count(*) filter (f) format_pass, count(*) filter (c) constraint_pass, count(*) filter (ord) order_pass, count(*) filter (whole) integer_pass, count(*) filter (inside) range_pass, count(*) filter (c and ev.result_id is not null) evaluable
  from a1 join (select result_id, f from fa) using (result_id) join (select result_id, ord, whole, inside, c from cs) using (result_id) left join ev using (result_id) group by 1),
 m as (select coalesce(source, '(none)') source, avg((d <= 0.1::double)::int) r, avg(d) a, median(d) e, max(d) x from de group by 1)
 select source, samples, format_pass, constraint_pass, order_pass, integer_pass, range_pass, evaluable, round(coalesce(r, 0), 6) match_rate, round(a, 6) mean_dev, round(e, 6) median_dev, round(x, 6) max_dev, format_pass / samples::double >= 0.8::double and constraint_pass / samples::double >= 0.8::double passes from g left join m using (source)""")
def answer_validation(s: SparkSession, d: str) -> DataFrame:
    v = validation.validation_summary(checked(s, d).withColumn("source", F.coalesce("source", F.lit("(none)"))), ["source"])
    return v.select("source", "samples", "format_pass", "constraint_pass", "order_pass", "integer_pass", "range_pass", "evaluable", *[F.round(c, 6).alias(c) for c in ("match_rate", "mean_dev", "median_dev", "max_dev")], "passes")


@checked_by(f"""with {FM}, {CS}, b as (select a1.result_id, w, e, case when not f then 'format_failure' when not c or ev.result_id is null then 'constraint_failure' end bad from a1 join (select result_id, f from fa) using (result_id) join (select result_id, c from cs) using (result_id) left join ev using (result_id))
 select bad failure_bucket, count(*) n from b where bad is not null group by 1 union all select case when d <= 0.1::double then 'saturation_match' else 'saturation_mismatch' end, count(*) from de join b using (result_id) where bad is null group by 1""")
def answer_failures(s: SparkSession, d: str) -> DataFrame:
    return validation.answer_details(checked(s, d), "result_id", "phase_waits").groupBy("failure_bucket").agg(F.count(F.lit(1)).alias("n"))


@checked_by(f"""with {FM}, {CS}, b as (select a1.result_id, case when not f then 'format_failure' when not c or ev.result_id is null then 'constraint_failure' end bad from a1 join (select result_id, f from fa) using (result_id) join (select result_id, c from cs) using (result_id) left join ev using (result_id)),
 x as (select 'format_failure' category, result_id, w[1].phase_id::bigint phase_id from b join a1 using (result_id) where bad = 'format_failure' union all select 'constraint_failure', result_id, w[1].phase_id::bigint from b join a1 using (result_id) where bad = 'constraint_failure'
  union all select unnest(list_filter([case when d > 0.1::double then 'saturation_mismatch' end, case when d > 0.1::double then 'large_deviation' end, case when clip then 'clip_sensitive' end], lambda c: c is not null)), result_id, q.phase_id::bigint from de join b using (result_id) where bad is null)
 select category, result_id, phase_id from (select *, row_number() over (partition by category order by result_id, phase_id) rn from x) where rn <= 10""")
def answer_examples(s: SparkSession, d: str) -> DataFrame:
    e = validation.failure_examples(validation.answer_details(checked(s, d), "result_id", "phase_waits"), [], 10)
    return e.select("category", F.col("sample_id").alias("result_id"), F.col("phase_id").cast("bigint").alias("phase_id"))


@checked_by("""with p as (select result_id, unnest(solution) x from teacher_results where solution is not null) select result_id, sum(x.final)::bigint total from p group by 1""")
def plan_totals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "teacher_results").where(F.size("solution") > 0).select("result_id", plans.plan_total(F.col("solution")).alias("total"))


@query
def plan_phases(s: SparkSession, d: str) -> DataFrame:
    """By the table function, so from SQL; the plans of all answers, element by element."""
    plans.register_plan_udtf(s)
    table(s, d, "teacher_results").select("result_id", "raw_content").createOrReplaceTempView("crosslight_answers")
    return s.sql("select result_id, p.pos, p.phase_id, p.final from crosslight_answers, lateral plan_phases(raw_content) p")


ORACLE_PHASES = rf"""with {A} select result_id, (i - 1)::int pos, p.phase_id phase_id, p.final final from ph where i <= ne"""
checked_by(ORACLE_PHASES)(plan_phases)


@checked_by("""select source, count(*) total, sum(bad)::bigint constraint_violations, count(*) filter (not regexp_matches(coalesce(think_text, ''), '\\S')) empty_thinks, round(avg(length(coalesce(think_text, ''))), 4) mean_think from (
 select coalesce(r.source, '(none)') source, think_text, case when solution is null then 0 else coalesce(list_sum(list_transform(range(1, least(len(solution), len(s.prediction.phase_waits)) + 1), lambda i: (solution[i].phase_id is distinct from s.prediction.phase_waits[i].phase_id)::int + (not coalesce(solution[i].final between s.prediction.phase_waits[i].min_green and s.prediction.phase_waits[i].max_green, false))::int)), 0) end bad
 from teacher_results r join train_samples s using (rec_id)) group by 1""")
def assembly_stats(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "teacher_results").select("rec_id", F.coalesce("source", F.lit("(none)")).alias("source"), "solution", F.col("think_text").alias("think")).join(table(s, d, "train_samples").select("rec_id", "prediction.phase_waits"), "rec_id")
    r = augment.assembly_stats(j, ["source"])
    return r.select("source", "total", "constraint_violations", "empty_thinks", F.round("mean_think", 4).alias("mean_think"))


@checked_by("""select coalesce(source, '(none)') source, count(*) done, count(*) filter (status = 'success') success, round(count(*) filter (status = 'success') * 100 / count(*)::double, 4) success_rate, round(coalesce(sum(coalesce(think_length, 0)) filter (status = 'success') / nullif(count(*) filter (status = 'success'), 0)::double, 0), 4) mean_think from teacher_results group by 1""")
def success_progress(s: SparkSession, d: str) -> DataFrame:
    r = augment.success_progress(table(s, d, "teacher_results").withColumn("source", F.coalesce("source", F.lit("(none)"))), ["source"])
    return r.select("source", "done", "success", F.round("success_rate", 4).alias("success_rate"), F.round("mean_think", 4).alias("mean_think"))


@checked_by("select distinct id from teacher_results where status = 'success' and id is not null")
def completed_ids(s: SparkSession, d: str) -> DataFrame:
    return augment.completed_ids(table(s, d, "teacher_results"), "id", success_only=True)


@checked_by("select rec_id from train_samples s where not exists (select 1 from teacher_results r where r.rec_id = s.rec_id and r.status = 'success')")
def pending_samples(s: SparkSession, d: str) -> DataFrame:
    done = augment.completed_ids(table(s, d, "teacher_results"), "rec_id", success_only=True)
    return filters.lacking(table(s, d, "train_samples").select("rec_id"), done, "rec_id")


@checked_by("""with m as (select r.result_id, s.prompt p, coalesce(think_text, '') k, list_transform(solution, lambda x: '{"phase_id":' || x.phase_id || ',"final":' || x.final || '}') e from teacher_results r join train_samples s using (rec_id) where (status is null or status = 'success') and len(solution) > 0)
 select result_id, 3::bigint n, length(p)::bigint user_chars, length('<start_working_out>' || k || '<end_working_out><SOLUTION>[' || array_to_string(e, ',') || ']</SOLUTION>')::bigint answer_chars from m where p is not null""")
def sft_records(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "teacher_results").select("result_id", "rec_id", "status", "think_text", "solution").join(table(s, d, "train_samples").where("prompt is not null").select("rec_id", "prompt"), "rec_id")
    r = augment.assemble(j, "Time the signals.")
    return r.select("result_id", F.size("messages").cast("bigint").alias("n"), F.length(F.col("messages")[1]["content"]).cast("bigint").alias("user_chars"), F.length(F.col("messages")[2]["content"]).cast("bigint").alias("answer_chars"))


@checked_by("""select rec_id, prompt like '%' || '【cycle_predict_input_json】' || '%' has_json, regexp_extract(prompt, '(?s)【cycle_predict_input_json】(.*?)【/cycle_predict_input_json】', 1) body from train_samples where prompt is not null and not list_contains(list_transform(prediction.phase_waits, lambda w: coalesce(isnan(w.pred_saturation) or w.pred_saturation <> round(w.pred_saturation, 4), false)), true)""")
def rendered_input(s: SparkSession, d: str) -> DataFrame:
    """The input rendered anew from its parts is the one in the prompt, to the letter; saturations of more than four
    digits and NaN aside, which JSON libraries print their own way."""
    odd = F.exists("prediction.phase_waits", lambda w: F.coalesce(F.isnan(w["pred_saturation"]) | (w["pred_saturation"] != F.round(w["pred_saturation"], 4)), F.lit(False)))
    t_ = table(s, d, "train_samples").where(F.col("prompt").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return t_.select("rec_id", F.col("prompt").contains(x.INPUT_OPEN).alias("has_json"), F.when(x.prompt_json(F.col("prompt")) != "", x.prediction_json(F.col("prediction"))).otherwise("").alias("body"))


@checked_by(r"""with p as (select rec_id, regexp_extract(prompt, '(?s)【cycle_predict_input_json】(.*?)【/cycle_predict_input_json】', 1) j from train_samples), w as (select rec_id, unnest(json_extract(j, '$.prediction.phase_waits[*]')) x from p where json_valid(j))
 select rec_id, count(*) n, true near from w where rec_id not in (select rec_id from train_samples where list_contains(list_transform(prediction.phase_waits, lambda w: coalesce(isnan(w.pred_saturation), false)), true)) group by 1""")
def injected_waits(s: SparkSession, d: str) -> DataFrame:
    """Every phase of the rendered prompt has its wait, which is saturation times capacity to two digits."""
    nan = F.coalesce(F.exists("prediction.phase_waits", lambda w: F.isnan(w["pred_saturation"])), F.lit(False))
    t_ = table(s, d, "train_samples").where(~nan).select("rec_id", x.prompt_json(x.inject_pred_wait(F.col("prompt"), WORDING)).alias("j"))
    w = t_.select("rec_id", F.from_json("j", "prediction struct<phase_waits:array<struct<pred_wait:double,pred_saturation:double,capacity:int>>>")["prediction"]["phase_waits"].alias("w")).where("size(w) > 0")
    near = F.forall("w", lambda p: F.abs(p["pred_wait"] - F.coalesce(p["pred_saturation"], F.lit(0.0)) * F.coalesce(p["capacity"], F.lit(30))) <= 0.0051)
    return w.select("rec_id", F.size("w").cast("bigint").alias("n"), F.coalesce(near, F.lit(False)).alias("near"))


@checked_by("select rec_id, 2::bigint n, length(prompt)::bigint chars, case when strpos(state_file, 'outputs/states/') > 0 then substr(state_file, strpos(state_file, 'outputs/states/')) else state_file end state_file, 'simple' \"source\", metadata.tl_id tl_id from train_samples where prompt is not null")
def simple_records(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "train_samples").where("prompt is not null").select("rec_id", x.simple_messages("Time the signals.", F.col("prompt"), F.col("metadata"), F.col("state_file"), "simple", ["tl_id", "sim_time", "date", "cycle_count"]).alias("r"))
    return r.select("rec_id", F.size("r.prompt").cast("bigint").alias("n"), F.length(F.col("r.prompt")[1]["content"]).cast("bigint").alias("chars"), "r.metadata.state_file", "r.metadata.source", "r.metadata.tl_id")


@checked_by("""select rec_id, length('【cycle_predict_input_json】') + length(b) + length('【/cycle_predict_input_json】') + 1 + length('Time the signals.') chars from (select rec_id, regexp_extract(prompt, '(?s)【cycle_predict_input_json】(.*?)【/cycle_predict_input_json】', 1) b from train_samples where prompt is not null and not list_contains(list_transform(prediction.phase_waits, lambda w: coalesce(isnan(w.pred_saturation) or w.pred_saturation <> round(w.pred_saturation, 4), false)), true)) where b <> ''""")
def teacher_prompts(s: SparkSession, d: str) -> DataFrame:
    odd = F.exists("prediction.phase_waits", lambda w: F.coalesce(F.isnan(w["pred_saturation"]) | (w["pred_saturation"] != F.round(w["pred_saturation"], 4)), F.lit(False)))
    t_ = table(s, d, "train_samples").where(F.col("prompt").isNotNull() & ~F.coalesce(odd, F.lit(False)) & (x.prompt_json(F.col("prompt")) != ""))
    return t_.select("rec_id", F.length(x.teacher_prompt(F.col("prediction"), "Time the signals.", WORDING)["user"]).cast("bigint").alias("chars"))


@checked_by("""with p as (select response_id, coalesce(case when json_valid(content) then json_extract_string(content, '$.content') end, content) c from api_responses where content is not null) select response_id, 'parse_failed' status, length(substr(c, 1, 500))::bigint kept from p where not regexp_matches(c, '<end_working_out>|</start_working_out>')""")
def failure_records(s: SparkSession, d: str) -> DataFrame:
    c = x.unwrap_response(F.col("content"))
    r = table(s, d, "api_responses").where("content is not null").where(~c.rlike(plans.END_TAGS)).select("response_id", x.failure_record(F.col("response_id"), F.lit("parse_failed"), F.lit("no_end_tag"), c).alias("r"))
    return r.select("response_id", "r.status", F.length("r.raw_content").cast("bigint").alias("kept"))


@checked_by("""select case when contains(p, 'chengdu') then 'chengdu' when contains(p, 'arterial4x4_10') then 'arterial4x4_10' else 'unknown' end scenario, count(*) n, count(*) filter (starts_with(case when strpos(p, 'outputs/states/') > 0 then substr(p, strpos(p, 'outputs/states/')) else p end, 'outputs/')) converted,
 count(*) filter (not starts_with(case when strpos(p, 'outputs/states/') > 0 then substr(p, strpos(p, 'outputs/states/')) else p end, 'outputs/')) fallback from (select replace(replace(coalesce(state_file, ''), 'gridtown', 'arterial4x4'), 'harborloop', 'chengdu') p from train_samples) group by 1""")
def scenario_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "train_samples").select(F.replace(F.replace(F.coalesce("state_file", F.lit("")), F.lit("gridtown"), F.lit("arterial4x4")), F.lit("harborloop"), F.lit("chengdu")).alias("p"))
    return metrics.scenario_counts(p, "p")


@checked_by("""select rec_id, case when starts_with(g, 'gridtown') then 'sumo_simulation/arterial4x4/arterial4x4' || substr(g, 9) || '/arterial4x4.sumocfg' else 'sumo_simulation/environments/chengdu/chengdu.sumocfg' end cfg from (select rec_id, string_split(state_file, '/')[3] g from train_samples where starts_with(state_file, 'outputs/states/')) where starts_with(g, 'gridtown') or g = 'harborloop'""")
def scenario_configs(s: SparkSession, d: str) -> DataFrame:
    g = F.get(F.split("state_file", "/"), F.lit(2))
    t_ = table(s, d, "train_samples").where(F.col("state_file").startswith("outputs/states/") & (g.startswith("gridtown") | (g == "harborloop")))
    p = F.replace(F.replace(F.col("state_file"), F.lit("gridtown"), F.lit("arterial4x4")), F.lit("harborloop"), F.lit("chengdu"))
    return t_.select("rec_id", x.scenario_cfg_path(p).alias("cfg"))


@checked_by("""select rec_id from (select rec_id, case when len(prediction.phase_waits) = len(list_filter(prediction.phase_waits, lambda w: w.pred_saturation is not null and not isnan(w.pred_saturation))) then coalesce(list_sum(list_transform(prediction.phase_waits, lambda w: w.pred_saturation)), 0) else 0 end t from train_samples) where coalesce(t, 0) < 0.5""")
def low_traffic_samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train_samples").where(filters.low_traffic(F.col("prediction.phase_waits"), 0.5)).select("rec_id")


@checked_by("select result_id, attempts from (select r.result_id, count(a.response_id) attempts from teacher_results r left join api_responses a on a.rec_id = r.rec_id and a.source = r.source group by 1)")
def results_with_calls(s: SparkSession, d: str) -> DataFrame:
    calls = table(s, d, "api_responses").groupBy("rec_id", "source").agg(F.count(F.lit(1)).alias("attempts"))
    r = joins.results_with_cycles(table(s, d, "teacher_results").select("result_id", "rec_id", "source"), calls, ["rec_id", "source"])
    return r.select("result_id", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@checked_by("""select result_id, solution is null and len(d) > 0 used_default, coalesce(len(coalesce(solution, d)), -1)::bigint n from (select r.result_id, r.solution, list_transform(s.prediction.phase_waits, lambda w: {'phase_id': w.phase_id, 'final': w.min_green}) d from teacher_results r left join train_samples s using (rec_id))""")
def fallback_plans(s: SparkSession, d: str) -> DataFrame:
    d_ = table(s, d, "train_samples").select("rec_id", F.transform("prediction.phase_waits", lambda w: F.struct(w["phase_id"].alias("phase_id"), w["min_green"].alias("final"))).alias("default"))
    r = joins.with_fallback(table(s, d, "teacher_results").select("result_id", "rec_id", "solution"), d_, "rec_id", "solution", "default")
    return r.select("result_id", "used_default", F.coalesce(F.size("solution"), F.lit(-1)).cast("bigint").alias("n"))


@checked_by("select r.result_id, coalesce(length(s.prompt), -1)::bigint prompt_chars, coalesce(length(r.raw_content), -1)::bigint answer_chars from teacher_results r join train_samples s using (rec_id)")
def answers_with_prompts(s: SparkSession, d: str) -> DataFrame:
    j = joins.answers_to_prompts(table(s, d, "train_samples").select("rec_id", "prompt"), table(s, d, "teacher_results").select("result_id", "rec_id", "raw_content"), "rec_id")
    return j.select("result_id", F.coalesce(F.length("prompt"), F.lit(-1)).cast("bigint").alias("prompt_chars"), F.coalesce(F.length("raw_content"), F.lit(-1)).cast("bigint").alias("answer_chars"))


@checked_by("select rec_id from train_samples where length(prompt) <= 1600 // 2")
def short_prompts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train_samples").where(filters.fits_half(F.length("prompt"), 1600)).select("rec_id")


@checked_by("""with g as (select coalesce(light, '(none)') || '' k, 'tl_id' dimension, count(*) n from (select metadata.tl_id light from train_samples) where light is not null group by 1 union all
 select bucket, 'bucket', count(*) from (select case when m < 0.3::double then 'low' when m < 0.7::double then 'med' else 'high' end bucket from (select list_avg(list_filter(list_transform(prediction.phase_waits, lambda w: w.pred_saturation), lambda v: v is not null and not isnan(v) and v >= 0)) m from train_samples) where m is not null) group by 1)
 select dimension, k category, n from g""")
def sampling_statistics(s: SparkSession, d: str) -> DataFrame:
    vals = F.filter(F.transform("prediction.phase_waits", lambda w: w["pred_saturation"]), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0))
    mean = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))
    return metrics.sampling_statistics(table(s, d, "train_samples").select(F.col("metadata.tl_id").alias("tl_id"), t.saturation_bucket(mean).alias("bucket")), "tl_id", "bucket")


@checked_by("""select p::bigint phase_id, count(*) n from (select unnest(regexp_extract_all(prompt, '"phase_id": ([0-9]+)', 1)) p from train_samples) group by 1""")
def phase_id_histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.phase_id_histogram(table(s, d, "train_samples"), "prompt")


CALLS = A.replace("r.status", "not coalesce(r.success, false) failed, rec_id").replace("r.raw_content", "r.c").replace("teacher_results r", "(select response_id result_id, rec_id, source, success, coalesce(case when json_valid(content) then json_extract_string(content, '$.content') end, content) c from api_responses) r")


@checked_by(f"""with {CALLS}, k as (select result_id, bool_and(p.phase_id is not distinct from q.phase_id and p.final is not null and p.final between q.min_green and q.max_green) ok from ph where ne = nw group by 1),
 v as (select rec_id id, a1.result_id attempt, failed f, regexp_matches(a, '<end_working_out>|</start_working_out>') and sol is not null and e is not null and len(e) = len(w) and coalesce(ok, len(w) = 0) v from a1 left join k using (result_id)),
 g as (select id, min(case when v then attempt end) ok, min(case when f then attempt end) err, max(attempt) "last" from v group by 1)
 select id, case when ok is not null and (err is null or err > ok) then 'success' when err is not null then 'api_error' else 'constraint_failed' end status, case when ok is not null and (err is null or err > ok) then ok else "last" end attempt from g""")
def first_valid_attempts(s: SparkSession, d: str) -> DataFrame:
    """The first answer of each sample that parses and keeps its constraints; a failed call before it decides."""
    a = table(s, d, "api_responses").select("rec_id", "response_id", "success", F.coalesce(x.unwrap_response(F.col("content")), F.lit("")).alias("content"))
    j = a.join(table(s, d, "train_samples").select("rec_id", "prediction.phase_waits"), "rec_id").withColumn("p", plans.parse_output(F.col("content")))
    valid = F.coalesce(F.col("p.success") & plans.constraint_error(F.col("p.elems"), F.col("phase_waits")).isNull(), F.lit(False))
    c = j.select(F.col("rec_id").alias("id"), F.col("response_id").alias("attempt"), "content", valid.alias("valid"), (~F.coalesce("success", F.lit(False))).alias("failed"))
    return augment.first_valid_attempt(c).select("id", "status", "attempt")
