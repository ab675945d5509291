"""The pN_ queries and the SQL that checks those of them that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import leakage, mixing, neardup, pairs, splits, subjects, targets, truncation
from .common import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "train_samples")).select("rec_id", "group_light")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(cut(splits.related_groups(table(spark, d, "train_samples"))))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p1_splits(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(truncation.all_texts(table(spark, d, "api_responses"), table(spark, d, "teacher_results")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select("record_table", "record_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_rates(_judged(spark, d))


def p2_causes(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_causes(_judged(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(neardup.near_duplicate_groups(table(spark, d, "train_samples")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "train_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "teacher_results"), table(spark, d, "train_samples"), table(spark, d, "api_responses"))


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = table(spark, d, "sampling_targets")
    records, filled = targets.filled_reservoirs(table(spark, d, "train_samples"), t)
    return records, filled, targets.quotas(filled, t)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)[2].where("exhausted").select("target_set", "category")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return targets.draw_sample(*_drawn(spark, d)[1:])


def p5_scaled(spark: SparkSession, d: str) -> DataFrame:
    return targets.draw_sample(*_drawn(spark, d)[1:], scaled=True)


def p5_stats(spark: SparkSession, d: str) -> DataFrame:
    _, filled, quota = _drawn(spark, d)
    return targets.draw_stats(targets.draw_sample(filled, quota), quota)


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    records, filled, quota = _drawn(spark, d)
    return targets.run_statistics(targets.draw_sample(filled, quota), records, quota)


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(_leaked(spark, d))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str, mode: str = "shares") -> tuple[DataFrame, DataFrame]:
    return mixing.build(table(spark, d, "documents"), table(spark, d, "mix_targets"), mode=mode)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("falls_short").select("mix_id", "source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.realise(*_mix(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = _mix(spark, d)
    return mixing.mix_report(mixing.realise(counts, plan), plan)


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = _mix(spark, d, "tempered")
    return mixing.mix_report(mixing.realise(counts, plan), plan)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return subjects.document_subjects(docs, subjects.fitted(docs, table(spark, d, "doc_labels"), table(spark, d, "subject_areas")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(cut(_subjects(spark, d)), table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_report, p2_found, p2_rates, p2_causes, p3_found, p3_groups, p4_found, p5_found, p5_sample, p5_scaled, p5_stats, p5_runs, p6_found, p6_items, p6_cleaned, p7_found, p7_mix, p7_report, p7_tempered, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that it can express on whole tables. The splits, sampled rows, alignments, near-duplicates,
    automata, token counts and language models are tested against brute force in tests/llm instead."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''") + "　"
    half = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + " "
    key = lambda c: f"nullif(regexp_replace(regexp_replace(lower(translate({c}, '{wide}', '{half}')), '^[^a-z0-9]*[a-z]+:', ''), '[^a-z0-9]', '', 'g'), '')"
    named = "nullif(regexp_extract(regexp_replace(regexp_replace(lower(state_file), '\\s+$', ''), '(\\.xml)?(\\.gz)?$', ''), 'state_[0-9-]+_t[0-9-]+_(.+)$', 1), '')"
    counted = f"""with r as (select rec_id, coalesce({key("metadata.tl_id")}, {key(named)}) light, prediction.as_of at_, list_avg(list_filter(list_transform(prediction.phase_waits, lambda w: w.pred_saturation), lambda s: s is not null and not isnan(s) and s >= 0)) m from train_samples),
 o as (select light, at_, arg_min(coalesce(m, -1), rec_id) m from r group by 1, 2), n as (select count(*) n from o), b as (select light, case when m < 0 then null when m < 0.3::double then 'low' when m < 0.7::double then 'med' else 'high' end bucket from o),
 h as (select 'tl_id' dimension, light k, count(*) c from b where light is not null group by 2 union all select 'bucket', bucket, count(*) from b where bucket is not null group by 2),
 t as (select target_set, category, target_share, coalesce(c, 0) available, greatest(min_rows, floor(target_share * floor(draw_share * n.n + 1e-9) + 1e-9))::bigint needed, coalesce(min_rows, 0) low, floor(draw_share * n.n + 1e-9)::bigint draw
  from sampling_targets t cross join n left join h on h.dimension = t.dimension and h.k = case when t.dimension = 'tl_id' then {key("category")} else category end)"""
    state = "nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(translate(state_file, '" + wide + "', '" + half + "')), '[\\\\/]+', '/', 'g')), '^.*outputs/states/', ''), '(\\.xml)?(\\.gz)?$', ''), '')"
    related = f"""with recursive k0 as (select rec_id, metadata.tl_id tl, {state} state from train_samples),
 k as (select rec_id, state, case when {key("tl")} is not null then tl end spelled, coalesce({key("tl")}, {key("nullif(regexp_extract(state, 'state_[0-9-]+_t[0-9-]+_(.+)$', 1), '')")}, state, 'rec:' || rec_id) light from k0),
 e as (select distinct a.light u, b.light v from (select distinct state, light from k where state is not null) a join (select distinct state, light from k where state is not null) b using (state) where a.light <> b.light),
 c(u, v) as (select u, u from (select distinct u from e) union select c.u, e.v from c join e on e.u = c.v),
 r as (select u light, min(v) root from c group by 1),
 sh as (select regexp_replace(regexp_replace(regexp_replace(spelled, '[0-9]+', '9', 'g'), '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g') s from k where spelled is not null),
 st as (select coalesce((select s from sh where regexp_matches(s, '^[aA][^aA9]?9$') group by s order by count(*) desc, s limit 1), 'a_9') s),
 nm as (select distinct light, case when regexp_matches(light, '^[a-z]+[0-9]+$') then (case when st.s[1] = 'A' then upper(regexp_extract(light, '^[a-z]+')) else regexp_extract(light, '^[a-z]+') end) || trim(st.s, 'aA9') || regexp_extract(light, '[0-9]+$') else light end shown from k, st),
 g as (select root, min(shown) group_light from r join nm using (light) group by 1),
 f as (select rec_id, coalesce(group_light, shown) group_light from k join nm using (light) left join r using (light) left join g using (root))"""
    return {
        "p1_found": f"{related} select rec_id, group_light from f",
        "p5_found": f"{counted} select target_set, category from t where available < needed",
        "p5_stats": f"""{counted}, q as (select *, least(needed, available) sampled, min(least(draw, case when target_share > 0 then floor(available / target_share + 1e-9) end)) over (partition by target_set) scaled from t)
 select target_set, category, available, needed, sampled, coalesce(sampled / nullif(sum(sampled) over (partition by target_set), 0)::double, 0) share, target_share, available < needed exhausted, least(available, greatest(low, floor(target_share * scaled + 1e-9)))::bigint scaled_quota from q""",
    }
