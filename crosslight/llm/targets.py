"""Problem 5: samples that meet target category proportions.

One pass keeps a reservoir for each category: how many records it has seen and, of those, the ones with the smallest
hashed priorities. Reservoirs of two parts merge by adding the counts and keeping the smallest of both, so each task fills
its own and the merged ones are the whole table's. The final counts then tell the feasible quotas, to which the reservoirs
are trimmed uniformly; exhausted categories are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut, light_key, slices_for, smallest, state_key, state_light, uniform_hash

ALL = "all"  # the dimension of the count of all records


def mean_saturation(waits: F.Column) -> F.Column:
    """Mean of the present saturations; null, NaN and negative ones are missing, none present gives null."""
    vals = F.filter(F.transform(waits, lambda w: w["pred_saturation"]), lambda s: s.isNotNull() & ~F.isnan(s) & (s >= 0))
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))


def distinct_records(samples: DataFrame) -> DataFrame:
    """One row (light, as_of, rec_id, bucket) per light and time; of repeated rows the smallest rec_id counts. A record
    without any saturation has a null bucket; one without light and state file keeps a null light."""
    light = F.coalesce(light_key(F.col("metadata.tl_id")), state_light(state_key(F.col("state_file"))))
    s = samples.select(light.alias("light"), F.col("prediction.as_of").alias("as_of"), F.struct("rec_id", mean_saturation(F.col("prediction.phase_waits")).alias("m")).alias("r"))
    one = s.groupBy("light", "as_of").agg(F.min("r").alias("r"))
    m = F.col("r.m")
    return one.select("light", "as_of", F.col("r.rec_id").alias("rec_id"), F.when(m < 0.3, "low").when(m < 0.7, "med").when(m.isNotNull(), "high").alias("bucket"))


def keyed_targets(targets: DataFrame) -> DataFrame:
    key = F.when(F.col("dimension") == "tl_id", light_key(F.col("category"))).otherwise(F.lower(F.trim("category")))
    return targets.withColumn("category_key", key)


def reservoirs(records: DataFrame, targets: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """(dimension, category_key, seen, rec_id, priority): what each task's reservoirs hold, one row of each record kept
    (seen null) and one of each count (rec_id null). Only categories of the targets have one; dimension `all` counts
    every record. A reservoir holds at most what the largest quota of its category can be in a table of `rows` rows (any
    number that is not below the distinct ones). The priority is a hash of light, time and seed, so the sample does not
    depend on the partitioning. A null category counts in `all` only."""
    t = keyed_targets(targets).collect()  # a fixed table
    names = sorted({(r["dimension"], r["category_key"]) for r in t if r["category_key"]})
    number = {n: i for i, n in enumerate(names)}
    room = np.zeros(len(names), np.int64)
    for r in t:
        if r["category_key"]:
            i = number[r["dimension"], r["category_key"]]
            room[i] = max(room[i], r["min_rows"] or 0, int((r["target_share"] or 0.0) * int((r["draw_share"] or 0.0) * rows + 1e-9) + 1e-9) + 1)
    p = uniform_hash(F.coalesce("light", F.lit("")), F.coalesce("as_of", F.lit("")), F.lit(seed))
    flat = records.select("rec_id", p.alias("priority"), "light", "bucket")
    schema = "dimension string, category_key string, seen bigint, rec_id bigint, priority bigint"

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, every, held, kept = np.zeros(len(names), np.int64), 0, [], 0

        def trimmed() -> np.ndarray:
            a = np.concatenate(held)
            a = a[np.lexsort((a[:, 1], a[:, 2], a[:, 0]))]
            first = np.searchsorted(a[:, 0], np.arange(len(names)))
            return a[np.arange(len(a)) - first[a[:, 0]] < room[a[:, 0]]]

        for pdf in it:
            every += len(pdf)
            rec, pri = pdf["rec_id"].to_numpy(np.int64), pdf["priority"].to_numpy(np.int64)
            for dimension, column in (("bucket", "bucket"), ("tl_id", "light")):
                own = {k: i for (d, k), i in number.items() if d == dimension}
                c = pdf[column].map(own)
                at = np.flatnonzero(c.notna().to_numpy())
                if len(at):
                    code = c.to_numpy()[at].astype(np.int64)
                    seen += np.bincount(code, minlength=len(names))
                    held.append(np.stack([code, rec[at], pri[at]], 1))
                    kept += len(at)
            if kept > 2 * min(int(room.sum()), 1 << 40) + 200_000:
                held = [trimmed()]
                kept = len(held[0])
        if every:
            count = pd.DataFrame({"dimension": [d for d, _ in names] + [ALL], "category_key": [k for _, k in names] + [ALL], "seen": pd.array([*seen.tolist(), every], "Int64"), "rec_id": pd.array([None] * (len(names) + 1), "Int64"), "priority": pd.array([None] * (len(names) + 1), "Int64")})
            yield count
        if held:
            a = trimmed()
            for i in range(0, len(a), 100_000):
                x = a[i : i + 100_000]
                yield pd.DataFrame({"dimension": [names[c][0] for c in x[:, 0]], "category_key": [names[c][1] for c in x[:, 0]], "seen": pd.array([None] * len(x), "Int64"), "rec_id": x[:, 1], "priority": x[:, 2]})

    return flat.mapInPandas(fill, schema)


def quotas(filled: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with the records that exist, those needed, and those that can be drawn, from the reservoirs' counts.

    needed = max(min_rows, floor(target_share * floor(draw_share * n))), n counting all distinct records. A category
    that no record has counts 0; targets are a fixed table, one row each. `quota` takes what there is of an exhausted
    category and all needed of the others; `scaled_quota` belongs to the largest draw in which no category lacks rows for
    its share (min_rows are still taken where they exist), so its shares meet the targets."""
    have = filled.where("rec_id is null").groupBy("dimension", "category_key").agg(F.sum("seen").alias("available"))
    n = have.where(F.col("dimension") == ALL).agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n"))
    j = keyed_targets(targets).join(have, ["dimension", "category_key"], "left").crossJoin(F.broadcast(n)).withColumn("available", F.coalesce("available", F.lit(0)))
    draw = F.floor(F.col("draw_share") * F.col("n") + 1e-9)
    floor_ = F.coalesce("min_rows", F.lit(0)).cast("bigint")
    need = F.greatest(floor_, F.floor(F.col("target_share") * draw + 1e-9))
    j = j.withColumn("draw", draw).withColumn("needed", need).withColumn("quota", F.least(need, "available"))
    most = F.when(F.col("target_share") > 0, F.floor(F.col("available") / F.col("target_share") + 1e-9))
    feasible = j.groupBy("target_set").agg(F.min(F.least("draw", most)).alias("scaled_draw"))
    j = j.join(F.broadcast(feasible), "target_set")
    scaled = F.least("available", F.greatest(floor_, F.floor(F.col("target_share") * F.col("scaled_draw") + 1e-9)))
    return j.select("target_set", "dimension", "category", "category_key", "target_share", "available", "draw", "needed", "quota", (F.col("available") < F.col("needed")).alias("exhausted"), scaled.alias("scaled_quota"), "n")


def draw_sample(filled: DataFrame, quota: DataFrame, scaled: bool = False) -> DataFrame:
    """(target_set, category, rec_id): the merged reservoirs trimmed to the quotas (with `scaled` to those of the scaled
    draw), the smallest priorities first. Ties in priority go to the smaller rec_id; a record whose category repeats in
    several sets is drawn for each."""
    members = filled.where("rec_id is not null").select("dimension", "category_key", "rec_id", "priority", F.col("rec_id").alias("__id"))
    wanted = quota.select("target_set", "category", "dimension", "category_key", F.col("scaled_quota" if scaled else "quota").alias("quota"))
    return smallest(members, ["dimension", "category_key"], "priority", wanted, slices_for(filled.count())).select("target_set", "category", "rec_id")


def draw_stats(sample: DataFrame, quota: DataFrame) -> DataFrame:
    """(target_set, category, available, needed, sampled, share, target_share, exhausted, scaled_quota): counts of a
    draw; a category of which nothing was drawn has 0."""
    got = sample.groupBy("target_set", "category").agg(F.count(F.lit(1)).alias("sampled"))
    j = quota.join(got, ["target_set", "category"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    total = j.groupBy("target_set").agg(F.sum("sampled").alias("t"))
    return j.join(F.broadcast(total), "target_set").select("target_set", "category", "available", "needed", "sampled", F.coalesce(F.try_divide("sampled", "t"), F.lit(0.0)).alias("share"), "target_share", "exhausted", "scaled_quota")


def run_statistics(sample: DataFrame, records: DataFrame, quota: DataFrame) -> DataFrame:
    """(target_set, total_source, total_sampled, tl_id_counts, bucket_counts): a draw in the form of the earlier draws'
    statistics, each set with the counts of its drawn records by light and by bucket, in order of the name as
    `name=count`. Records without light or bucket count in the totals only; a set that drew nothing has empty counts."""
    j = sample.join(records.select("rec_id", "light", "bucket"), "rec_id")
    g = j.select("target_set", F.explode(F.array(F.struct(F.lit("tl_id").alias("d"), F.col("light").alias("k")), F.struct(F.lit("bucket").alias("d"), F.col("bucket").alias("k")), F.struct(F.lit(ALL).alias("d"), F.lit(ALL).alias("k")))).alias("x")).groupBy("target_set", "x").agg(F.count(F.lit(1)).alias("c"))
    pair = F.struct(F.col("x.k").alias("k"), F.col("c").alias("c"))
    of = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("x.d") == d) & F.col("x.k").isNotNull(), pair))), lambda p: F.concat_ws("=", p["k"], p["c"])), ",")
    a = g.groupBy("target_set").agg(F.sum(F.when(F.col("x.d") == ALL, F.col("c"))).alias("total_sampled"), of("tl_id").alias("tl_id_counts"), of("bucket").alias("bucket_counts"))
    sets = quota.groupBy("target_set").agg(F.max("n").alias("total_source"))
    return sets.join(a, "target_set", "left").select("target_set", "total_source", F.coalesce("total_sampled", F.lit(0)).alias("total_sampled"), F.coalesce("tl_id_counts", F.lit("")).alias("tl_id_counts"), F.coalesce("bucket_counts", F.lit("")).alias("bucket_counts"))


def filled_reservoirs(samples: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The distinct records and the written reservoirs. The reservoirs' room is set by the rows of the table, which
    its files' footers tell."""
    records = distinct_records(samples)
    return records, cut(reservoirs(records, targets, samples.count(), seed))
