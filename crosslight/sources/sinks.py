"""Writers. Files of one row or a few are coalesced; everything else keeps its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import metrics, validation


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Line JSON, null fields kept; `append` adds to what is there."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_results(df: DataFrame, path: str, id_: str) -> None:
    """Appends the rows whose id is not there yet, so a batch that runs twice changes nothing."""
    from ..streaming.windows import resume_append

    spark = df.sparkSession
    try:
        done = spark.read.schema(f"{id_} {df.schema[id_].dataType.simpleString()}").json(path)
        done.limit(1).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], f"{id_} {df.schema[id_].dataType.simpleString()}")
    jsonl(resume_append(df, done, id_), path, "append")


def split(df: DataFrame, keep: Column, path: str) -> None:
    """Kept and rejected rows in one pass, as partitions keep=true and keep=false."""
    df.withColumn("keep", F.coalesce(keep, F.lit(False))).write.mode("overwrite").partitionBy("keep").json(path)


def phase_config(phases: DataFrame, path: str, source_file: str, stats: DataFrame | None = None) -> None:
    """(tl_id, pos, phase columns) as one object: metadata and a map of lists in the order of pos, lanes sorted; what
    `readers.phase_config` reads. A network has few lights, so it is one row. `stats` (of `net_stats`) gives the totals;
    without it all lights count as valid."""
    p = F.struct("pos", "phase_index", "state", F.array_sort("green_lanes").alias("green_lanes"), "min_dur", "max_dur")
    g = phases.groupBy("tl_id").agg(F.transform(F.array_sort(F.collect_list(p)), lambda x: x.dropFields("pos")).alias("ps"))
    one = g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tl_id", "ps")))).alias("traffic_lights"), F.count(F.lit(1)).alias("valid_tl"), F.coalesce(F.sum(F.size("ps")), F.lit(0)).alias("total_phases"))
    if stats is not None:
        one = one.drop("valid_tl", "total_phases").crossJoin(F.broadcast(stats))
    else:
        one = one.withColumn("total_tl", F.col("valid_tl")).withColumn("skipped_tl", F.lit(0).cast("bigint"))
    meta = F.struct("total_tl", "valid_tl", "skipped_tl", "total_phases", F.lit(source_file).alias("source_file"))
    one.select(meta.alias("metadata"), "traffic_lights").coalesce(1).write.mode("overwrite").json(path)


def cycles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("scenario", "tl_id", "cycle_index").json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with a header; an empty table gives the header alone. For tables of a few rows."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def summary_extended(cycles_: DataFrame, path: str, by: tuple[str, str] = ("model_name", "scenario")) -> None:
    """The 22-column summary of each model and scenario, a row each."""
    csv(metrics.model_summary(cycles_, list(by)), path)


def comparison(summaries: DataFrame, path: str) -> None:
    """Nine columns of all models, those with the least delay first; the header alone for none."""
    from .readers import SUMMARY_COLUMNS

    have = [F.col(c) if c in summaries.columns else F.lit("").alias(c) for c in SUMMARY_COLUMNS]
    csv(metrics.by_delay(summaries.select(*have), "avg_delay", "model"), path)


def append_kpis(kpis: DataFrame, path: str, by: str = "tl_id") -> None:
    """Adds rows of a time, a light and its indicators to a table of CSV files. Every part has the header, as a folder's
    reader skips it in each; `kpi_schema` reads the table."""
    kpis.select("ts", by, *KPI_COLUMNS).write.mode("append").option("header", True).csv(path)


#: The indicators of a light in a row.
KPI_COLUMNS = ("average_saturation", "total_vehicles", "average_queue_length", "max_saturation", "max_queue_length", "vehicle_throughput", "congestion_index", "congestion_level")


def kpi_schema(by: str = "tl_id") -> str:
    kind = lambda c: "string" if c == "congestion_level" else "double"
    return f"ts timestamp, {by} string, " + ", ".join(f"{c} {kind(c)}" for c in KPI_COLUMNS)


def final_json(cycles_: DataFrame, by: list[str], order: str, path: str, config: dict[str, str] | None = None) -> None:
    """One object for each run: metadata (the run, the time, the settings), its cycles in order, and summaries of answers
    and traffic. A run has few cycles."""
    cols = [c for c in cycles_.columns if c not in by and c != order]
    g = cycles_.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("cycles"))
    s = metrics.model_summary(cycles_, by)
    names = [c for c in s.columns if c not in by]
    llm = [c for c in names if c.endswith("_rate") or c.startswith("response_time")]
    s = s.select(*by, F.struct(F.struct(*llm).alias("llm"), F.struct(*[c for c in names if c not in llm]).alias("traffic")).alias("summary"))
    settings = F.create_map(*[F.lit(v) for kv in (config or {}).items() for v in kv]) if config else F.create_map().cast("map<string,string>")
    meta = F.struct(*by, F.current_timestamp().alias("timestamp"), settings.alias("config"))
    g.join(s, by).select(meta.alias("metadata"), "cycles", "summary").write.mode("overwrite").json(path)


def validation_outputs(details: DataFrame, summary: DataFrame, path: str, seed: int, requested: int, mode: str) -> None:
    """From `status_details` or `answer_details`: details, summary, manifest (seed, requested and actual size, mode, with
    the ids in a table beside it) and the examples of each category, each as its own table."""
    details.write.mode("overwrite").parquet(f"{path}/details")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    written = details.sparkSession.read.parquet(f"{path}/details")
    ids = written.select("sample_id").distinct()
    ids.write.mode("overwrite").json(f"{path}/manifest_ids")
    ids.agg(F.count(F.lit(1)).alias("manifest_size")).select(F.lit(seed).alias("seed"), F.lit(requested).alias("requested_samples"), "manifest_size", F.lit(mode).alias("sample_mode")).write.mode("overwrite").json(f"{path}/manifest")
    validation.failure_examples(written, [], None).write.mode("overwrite").partitionBy("category").json(f"{path}/failure_examples")


MOST_ROWS = 100_000


def report(aggregate: DataFrame, title: str, most: int = MOST_ROWS) -> str:
    """Markdown table of a small aggregate, all of its rows; more than `most` rows raise, as they are no report."""
    rows = aggregate.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows; write them as a table")
    head = "| " + " | ".join(aggregate.columns) + " |\n|" + "-|" * len(aggregate.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"
