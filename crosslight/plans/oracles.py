"""The same queries as SQL, written apart from the engine's expressions."""

from __future__ import annotations

from .registry import ORACLES as ORACLES

PV = """pv as (select l_orderkey sample_id, l_linenumber phase_id, l_quantity / 40 pred_saturation, 5 + l_suppkey % 20 min_green,
 15 + l_suppkey % 20 + l_partkey % 60 max_green, 5 + l_suppkey % 20 + (l_orderkey + l_linenumber * 7) % (22 + l_partkey % 60) final from lineitem)"""
DT = PV + """, d0 as (select *, round_even(max_green * greatest(0, pred_saturation), 0)::bigint raw_target from pv),
 d1 as (select *, least(greatest(raw_target, min_green), max_green)::bigint target_green from d0),
 dt as (select *, abs(final - target_green) / greatest(max_green - min_green, 1)::double deviation, target_green in (min_green, max_green) is_clip, final between min_green and max_green in_range from d1),
 dr as (select dt.*, deviation <= 0.1::double is_match, o_orderpriority run, o_orderstatus <> 'P' fmt from dt join orders on o_orderkey = sample_id)"""
#: One detail of a failed sample, all of the others; fb as the reports need it.
SD = DT + """, sf as (select run, sample_id, bool_and(fmt) f, bool_and(in_range) ok, count(*) n from dr group by 1, 2), rk as (select *, row_number() over (partition by run, sample_id order by phase_id, pred_saturation, min_green, max_green, final) rk from dr),
 sd as (select rk.*, case when not f then 'format_failure' when not ok then 'constraint_failure' when is_match then 'saturation_match' else 'saturation_mismatch' end fb, f and ok good from rk join sf using (run, sample_id) where (f and ok) or rk = 1)"""

#: The order-dependent choice as a recursion over a light's phases: `kept` holds the chosen ones with their lanes. Coins of
#: equal phases cannot be drawn alike here, so lights that toss one are left out on both sides.
MUTEX = """with recursive l as (select l_orderkey::varchar tl_id, l_linenumber pos, case when l_suppkey % 5 = l_partkey % 5 then [(l_suppkey % 5)::varchar] else [(l_suppkey % 5)::varchar, (l_partkey % 5)::varchar] end lanes from lineitem), p as (select tl_id, list({'pos': pos, 'lanes': lanes} order by pos, lanes) ps from l group by 1),
 f(tl_id, ps, i, kept, tossed) as (select tl_id, ps, 1, []::struct(pos int, lanes varchar[])[], false from p union all
 select tl_id, ps, i + 1, case when k0 = 0 then list_append(kept, ps[i]) when len(ps[i].lanes) > len(kept[k0].lanes) then list_concat(list_concat(kept[1:k0 - 1], [ps[i]]), kept[k0 + 1:]) else kept end, tossed or (k0 > 0 and len(ps[i].lanes) = len(kept[k0].lanes))
 from (select *, coalesce(list_position(list_transform(kept, lambda k: list_has_any(k.lanes, ps[i].lanes)), true), 0) k0 from f where i <= len(ps)))
 select tl_id, array_to_string(list_transform(kept, lambda k: k.pos::varchar), ',') kept from f where i = len(ps) + 1 and not tossed and len(kept) >= 2"""

ORACLES.update({
    "weighted_metrics": """select l_returnflag, l_linestatus, round(coalesce(sum(case when w > 0 then l_extendedprice * w end) / nullif(sum(case when w > 0 then w end), 0), 0), 4) avg_queue,
 round(coalesce(sum(case when w > 0 then l_discount * w end) / nullif(sum(case when w > 0 then w end), 0), 0), 4) avg_delay, round(coalesce(sum(case when w > 0 then l_quantity end) / nullif(sum(case when w > 0 then w end), 0), 0), 4) throughput,
 count(*) total_cycles, coalesce(sum(case when w > 0 then w end), 0)::bigint total_duration from (select *, l_linenumber - 1 w from lineitem) group by 1, 2""",
    "traffic_metrics": "select l_returnflag, " + ", ".join(f"round(avg({c}), 4) avg_{n}, round(max({c}), 4) max_{n}, round(min({c}), 4) min_{n}, round(coalesce(stddev_samp({c}), 0), 4) std_{n}" for n, c in (("queue", "l_quantity"), ("delay", "l_extendedprice"), ("passed", "l_tax"))) + " from lineitem group by 1",
    "llm_metrics": """select event_type, round(avg((user_id % 3 <> 0)::int), 4) format_rate, round(avg((user_id % 2 = 0)::int), 4) constraint_rate, round(avg((user_id % 3 <> 0)::int), 4) order_rate, round(avg(r), 4) avg_response, round(max(r), 4) max_response, round(min(r), 4) min_response,
 round(coalesce(stddev_samp(r), 0), 4) std_response, count(r) responses from (select *, case when event_id % 5 <> 0 then value end r from events) group by 1""",
    "distribution_stats": """with p as (select l_orderkey, sum(l_quantity) v from lineitem group by 1), q as (select 'all' part, v from p union all select case when v >= 50 then 'kept' else 'rejected' end, v from p)
 select part, count(*) n, round(min(v), 4) min_v, round(max(v), 4) max_v, round(avg(v), 4) mean_v, round(median(v), 4) median_v from q group by 1""",
    "reward_distribution": "select event_type, round(avg(value), 4) mean_v, round(stddev_pop(value), 4) std_v, round(min(value), 4) min_v, round(max(value), 4) max_v, " + ", ".join(f"round(quantile_cont(value, {p}), 4) p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from events group by 1",
    "reward_trend": """with r as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) rn, count(*) over (partition by event_type) n from events)
 select event_type, least((rn - 1) // greatest(n // 10, 1), 9)::bigint segment, round(avg(value), 2) mean_v, count(*) n from r group by 1, 2""",
    "zero_std_ratio": "select event_type, round(avg(case when coalesce(case when event_id % 7 <> 0 then value / 1000 end, 1) < 0.01::double then 1.0::double else 0 end), 6) ratio from events group by 1",
    "distribution_quality": """with g as (select l_suppkey, coalesce(stddev_samp(l_discount), 0) s, count(distinct l_discount) / count(l_discount)::double u, avg(case when l_discount <> 0 then 1.0::double else 0 end) z from lineitem group by 1)
 select l_suppkey, round(s, 6) std_v, round(u, 6) unique_share, round(z, 6) nonzero_share, s >= 0.5 and u >= 0.3::double and z >= 0.5 passes from g""",
    "target_green": f"with {DT} select sample_id, phase_id, target_green target, trunc(min_green + least(pred_saturation, 1) * (max_green - min_green))::bigint baseline from d1",
    "proportional_solution": f"""with {PV}, m as (select *, max(pred_saturation) over (partition by sample_id) top from pv)
 select sample_id, phase_id, least(greatest(case when max_green = min_green or pred_saturation = 0 then min_green else round_even(min_green + pred_saturation / top * (max_green - min_green), 0) end, min_green), max_green)::bigint final from m""",
    "phase_deviation": f"with {DT} select sample_id, phase_id, target_green, round(deviation, 6) deviation, deviation <= 0.1::double is_match, is_clip, in_range from dt",
    "phase_sat_score": f"""with {DT} select sample_id, phase_id, round(greatest(0, case when deviation <= 0.05::double then 1 when deviation <= 0.1::double then 0.8::double when deviation <= 0.2::double then greatest(0, 0.3::double - (deviation - 0.1::double) * 3) else 0 end
 - case when deviation > 0.1::double and deviation <= 0.2::double then 0.35::double * (0.2::double - deviation) / 0.1::double else 0 end + case abs(final - target_green) when 0 then 0.4::double when 1 then 0.15::double else 0 end), 6) score from dt""",
    "constraint_flags": f"with {DT} select sample_id, count(*) phases, sum(in_range::int)::bigint in_range, bool_and(in_range) constraint_ok from dt group by 1",
    "run_comparison": f"""with {DT}, r as (select run, count(distinct sample_id) total_samples, round(avg(is_match::int), 6) match_rate from dr group by 1)
 select *, round(match_rate - first_value(match_rate) over (order by total_samples, run), 2) delta from r""",
    "length_quantile_filter": "select doc_id, length(coalesce(text, ''))::bigint len from documents where length(coalesce(text, '')) <= (select quantile_cont(length(coalesce(text, '')), 0.9) from documents)",
    "stratified_quota": """with g as (select o_orderpriority, o_orderstatus, count(*) size from orders group by 1, 2)
 select *, least(size, greatest(1, round_even(500 * size / (select sum(size) from g)::double, 0)))::bigint quota from g""",
    "uniform_sample": "select least(100, count(*)) n, least(100, count(*)) keys from customer",
    "cycle_boundary": """with p as (select *, lag(event_type) over (partition by user_id order by ts, event_id) prev from events), b as (select *, (prev is not null and prev <> 'click' and event_type = 'click')::int is_boundary from p)
 select user_id, event_id, is_boundary, sum(is_boundary) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint cycle_count from b""",
    "phase_switch": "select user_id, event_id, prev, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) prev from events) where prev <> event_type",
    "ring_buffer": "select event_type, event_id, rn from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events) where rn <= 20",
    "dedupe_first": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn = 1 and value > 10",
    "max_pressure": """with p as (select l_suppkey, l_linenumber, round(coalesce(sum(case when l_returnflag <> 'R' then l_quantity end), 0) - coalesce(avg(case when l_returnflag = 'R' then l_quantity end), 0), 4) pressure from lineitem group by 1, 2)
 select l_suppkey, l_linenumber, pressure from (select *, row_number() over (partition by l_suppkey order by pressure desc, l_linenumber) rn from p) where rn = 1""",
    "start_end_queue": """with q as (select l_suppkey, l_linenumber step, sum(l_quantity) queue from lineitem group by 1, 2)
 select a.l_suppkey, a.step::bigint step, a.queue, greatest(0, coalesce(b.queue, a.queue) - a.queue) delta from q a left join q b on a.l_suppkey = b.l_suppkey and b.step = a.step + 2""",
    "baseline_semi": "select o_orderkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 5000)",
    "resume_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "baseline_improvement": """with g as (select o_custkey, avg(o_totalprice) a, count(*)::double n from orders group by 1), j as (select o_orderkey, 0.3::double * (1 / n) + 0.4::double * case when a > 0 then (a - o_totalprice) / a else 0 end
 + 0.3::double * case when a > 0 then (a / 2 - o_totalprice / 2) / greatest(a / 2, 1) else 0 end x from orders join g using (o_custkey)) select o_orderkey, round(case when x >= 0 then ln(1 + x) / ln(2) * 5 else greatest(x * 5, -2.5) end, 6) score from j""",
    "counterfactual_grid": "select n_nationkey, duration::bigint duration from nation, generate_series(20, 90, 10) g(duration)",
    "conflict_pairs": "select distinct x.l_orderkey, x.l_linenumber a, y.l_linenumber b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey % 5 = y.l_suppkey % 5 and x.l_linenumber < y.l_linenumber",
    "format_scores": r"""with c as (select response_id, coalesce(content, '') t from api_responses), n as (select *, (length(t) - length(replace(t, '<end_working_out>', ''))) / 17 e, (length(t) - length(replace(t, '<SOLUTION>', ''))) / 10 o, (length(t) - length(replace(t, '</SOLUTION>', ''))) / 11 z, strpos(t, '<end_working_out>') "at" from c)
 select response_id, (case when e = 1 then 0.5 else -1 end + case when o = 1 then 0.5 else -1 end + case when z = 1 then 0.5 else -1 end)::double approx,
 round(case when "at" = 0 then -0.5::double when ("at" - 1) / 2 < 50 then -0.5::double * (1 - ("at" - 1) / 2 / 50) when ("at" - 1) / 2 > 300 then -0.5::double * (("at" - 1) / 2 / 300 - 1) else 0.5::double end, 6) think,
 case when regexp_matches(t, '(?s)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>[\s\x{3000}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]*$') then 3.0::double else 0.0::double end exact from n""",
    "unwrap_response": "select response_id, length(coalesce(case when json_valid(content) then json_extract_string(content, '$.content') end, content))::bigint n from api_responses where content is not null",
    "state_paths": "select rec_id, case when strpos(state_file, 'outputs/states/') > 0 then substr(state_file, strpos(state_file, 'outputs/states/')) else state_file end path, concat_ws(':', metadata.tl_id, prediction.as_of) sample_id from train_samples where state_file is not null",
    "saturation_buckets": f"""with {PV}, g as (select sample_id % 10 light, case when avg(pred_saturation) < 0.3::double then 'low' when avg(pred_saturation) < 0.7::double then 'med' else 'high' end bucket from pv group by sample_id)
 select coalesce(light::varchar, bucket) category, count(*) n from g group by grouping sets ((light), (bucket))""",
    "congestion": """with h as (select strftime(ts, '%Y-%m-%d %H') "hour", avg(value) v, count(*)::double n from events group by 1), i as (select "hour", round(0.4::double * least(v / 100, 1) + 0.3::double * least(n / 100, 1) + 0.3::double * least(v / 60, 1), 6) idx from h)
 select "hour", idx, case when idx < 0.3::double then 'free' when idx < 0.5 then 'light' when idx < 0.7::double then 'moderate' when idx < 0.9::double then 'heavy' else 'severe' end "level" from i""",
    "tumbling_windows": """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') w_start, event_type, count(*) n from events group by 1, 2""",
    "failure_buckets": f"with {SD} select run, count(*) filter (fb = 'format_failure') format_failure, count(*) filter (fb = 'constraint_failure') constraint_failure, count(*) filter (fb = 'saturation_mismatch') saturation_mismatch, count(*) filter (fb = 'saturation_match') saturation_match from sd group by 1",
    "run_summary": f"""with {DT}, s as (select run, sample_id, bool_and(in_range) ok from dr group by 1, 2), a as (select run, count(*) samples, avg(ok::int) c from s group by 1),
 p as (select run, avg(is_match::int) m, avg(deviation) e, median(deviation) md, max(deviation) mx from dr group by 1)
 select run, samples, round(c, 6) constraint_rate, round(m, 6) match_rate, round(e, 6) mean_dev, round(md, 6) median_dev, round(mx, 6) max_dev, c >= 0.8::double passes from a join p using (run)""",
    "analysis_summary": f"with {SD} select run, count(*) filter (deviation >= 0.08::double and deviation <= 0.15::double) near_threshold, count(*) filter (is_clip) clip, count(*) filter (is_clip and is_match) clip_match from sd group by 1",
    "deviation_matrix": f"""with {SD}, g as (select * from sd where good) select run, count(*) filter (deviation <= 0.1::double) "match", count(*) filter (deviation > 0.1::double and deviation <= 0.3::double) near_miss, count(*) filter (deviation > 0.3::double) large,
 count(*) filter (pred_saturation <= 0.3::double) low_total, count(*) filter (pred_saturation > 0.3::double and pred_saturation <= 0.7::double) mid_total, count(*) filter (pred_saturation > 0.7::double) high_total,
 count(*) filter (is_match and pred_saturation <= 0.3::double) low_match, count(*) filter (is_match and pred_saturation > 0.3::double and pred_saturation <= 0.7::double) mid_match, count(*) filter (is_match and pred_saturation > 0.7::double) high_match,
 count(*) filter (not is_match and pred_saturation <= 0.3::double) low_mismatch, count(*) filter (not is_match and pred_saturation > 0.3::double and pred_saturation <= 0.7::double) mid_mismatch, count(*) filter (not is_match and pred_saturation > 0.7::double) high_mismatch from g group by 1""",
    "clip_summary": f"with {SD} select run, count(*) filter (is_clip) clip, count(*) filter (is_clip and not is_match) clip_mismatch from sd where good group by 1",
    "threshold_alignment": f"""with {SD}, c as (select *, greatest(0, 1 - deviation) cl from sd where good), x as (select *, cl > 0.8::double and not is_match hf, cl < 0.5 and is_match hp from c),
 e as (select run, string_agg(sample_id || '-' || phase_id, ',' order by rn) filter (hf) a, string_agg(sample_id || '-' || phase_id, ',' order by rn) filter (hp) b from (select *, row_number() over (partition by run, hf, hp order by sample_id, phase_id) rn from x where hf or hp) where rn <= 5 group by 1)
 select x.run, count(*) filter (hf) hard_fail, count(*) filter (hp) hard_pass, round(count(*) filter (deviation >= 0.05::double and deviation <= 0.2::double) / count(*)::double, 6) near_share, round(avg(cl), 6) mean_closeness, coalesce(any_value(a), '') hard_fail_examples, coalesce(any_value(b), '') hard_pass_examples from x left join e using (run) group by 1""",
    "failure_examples": f"""with {SD}, x as (select run, sample_id, phase_id, round(case when good then deviation end, 4) deviation, unnest(list_filter([case when fb <> 'saturation_match' then fb end, case when good and deviation > 0.1::double then 'large_deviation' end, case when good and is_clip then 'clip_sensitive' end], lambda c: c is not null)) category from sd)
 select run, category, sample_id, phase_id, deviation from (select *, row_number() over (partition by run, category order by sample_id, phase_id, deviation nulls first) rn from x) where rn <= 5""",
    "stratified_sample": """with g as (select o_orderpriority, o_orderstatus, count(*) size from orders group by 1, 2)
 select o_orderpriority, o_orderstatus, least(size, greatest(1, round_even(500 * size / (select sum(size) from g)::double, 0)))::bigint quota, true near_quota, true without_repeats from g""",
    "as_of_value": """select l.user_id, strftime(l.ts, '%Y-%m-%d %H:%M:%S') "at", round(r.value, 6) "value" from (select user_id, ts from events where event_type = 'view') l
 asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2) r on l.user_id = r.user_id and l.ts >= r.ts""",
    "synthetic_samples": "select 20000::bigint samples, true inside, 5.0::double lowest, 5.0::double low, 6.0::double high, 4.0::double above",
    "diversified_samples": "select rec_id, len(prediction.phase_waits)::bigint n, true inside from train_samples where prediction.phase_waits is not null",
    "greedy_mutex": MUTEX,
})
