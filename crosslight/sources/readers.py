"""Readers with explicit schemas, and the driver's small files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

PHASE = "phase_index int, state string, green_lanes array<string>, min_dur double, max_dur double"
WAIT = "phase_id int, pred_saturation double, min_green int, max_green int, capacity int"
SAMPLE = f"prompt string, prediction struct<as_of:string,phase_waits:array<struct<{WAIT.replace(' ', ':').replace(',:', ',')}>>>, state_file string, metadata struct<tl_id:string,sim_time:double,date:string,cycle_count:int>"
STEP = "loss double, reward double, reward_std double, step int"
SUMMARY_COLUMNS = ("model", "total_cycles", "format_success_rate", "constraint_rate", "avg_response_time", "avg_queue", "avg_delay", "throughput", "total_duration")


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links, phases) of a network's XML: links as (tl_id, link_index, from_lane, to_lane), phases as (tl_id,
    phase_index, duration, state, min_dur, max_dur) in file order; missing limits are 0. A link's `place` is its order in
    the file, by which the last of repeated links is known."""
    c = spark.read.format("xml").option("rowTag", "connection").schema("_tl string, _linkIndex int, _from string, _to string, _fromLane int, _toLane int").load(path)
    links = c.where("_tl is not null").select(F.col("_tl").alias("tl_id"), F.col("_linkIndex").alias("link_index"), F.concat_ws("_", "_from", "_fromLane").alias("from_lane"), F.concat_ws("_", "_to", "_toLane").alias("to_lane"), F.monotonically_increasing_id().alias("place"))
    t = spark.read.format("xml").option("rowTag", "tlLogic").schema("_id string, phase array<struct<_duration:double,_state:string,_minDur:double,_maxDur:double>>").load(path)
    p = t.select(F.col("_id").alias("tl_id"), F.posexplode("phase").alias("phase_index", "p"))
    return links, p.select("tl_id", "phase_index", F.col("p._duration").alias("duration"), F.col("p._state").alias("state"), F.coalesce("p._minDur", F.lit(0.0)).alias("min_dur"), F.coalesce("p._maxDur", F.lit(0.0)).alias("max_dur"))


def by_light():  # noqa: ANN201
    from pyspark.sql import Window as W

    return W.partitionBy("tl_id").orderBy("phase_index")


def default_timing(phases: DataFrame, tl_id: str, least: float = 10) -> DataFrame:
    """A light's phases of at least that duration, numbered from 0, with their own index kept; none where the duration of
    any of them is not a whole number."""
    d = phases.where((F.col("tl_id") == tl_id) & (F.col("duration") >= least))
    odd = d.agg(F.count_if(F.col("duration") != F.floor("duration")).alias("__odd"))
    return d.crossJoin(F.broadcast(odd)).where("__odd = 0").drop("__odd").withColumn("number", F.row_number().over(by_light()) - 1)


def light_ids(phases: DataFrame) -> DataFrame:
    return phases.select("tl_id").distinct().orderBy("tl_id")


def phase_config(spark: SparkSession, path: str) -> DataFrame:
    """(tl_id, pos, phase columns) of a phase configuration; the order of a light's phases is kept in pos."""
    fields = PHASE.replace(", ", ",").replace(" ", ":")
    d = spark.read.schema(f"traffic_lights map<string,array<struct<{fields}>>>").option("multiLine", True).json(path)
    return d.select(F.explode("traffic_lights").alias("tl_id", "ps")).select("tl_id", F.posexplode("ps").alias("pos", "p")).select("tl_id", "pos", "p.*")


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Line JSON; strict fails on a bad line, tolerant keeps it in `_corrupt_record`. Blank lines are skipped."""
    r = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return r.schema(schema if strict else schema + ", _corrupt_record string").json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("_corrupt_record is null").drop("_corrupt_record"), df.where("_corrupt_record is not null")


def train_log(spark: SparkSession, path: str) -> DataFrame:
    """Steps of a training log: lines that begin as a dict and name reward and reward_std, with either kind of quotes;
    what cannot be parsed is dropped."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where(F.col("v").startswith("{") & F.col("v").contains("reward") & F.col("v").contains("reward_std"))
    return t.select(F.coalesce(F.from_json("v", STEP), F.from_json(F.translate("v", "'", '"'), STEP)).alias("s")).where("s.reward is not null").select("s.*")


def result_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs' CSV files in one table of nine columns, empty where a file lacks one; summaries are left out. All files
    are one scan of lines; each line is split by its own file's header, which reaches it by file."""
    t = spark.read.option("pathGlobFilter", "*.csv").text(f"{folder.rstrip('/')}/*").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    t = t.where((F.col("name") != "summary.csv") & F.col("value").rlike(r"\S"))
    head = t.groupBy("file").agg(F.min_by("value", F.struct("at", "n")).alias("head"), F.min(F.struct("at", "n")).alias("first"))
    cells = lambda c: F.transform(F.split(c, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1"), '""', '"'))
    j = t.join(head, "file").where((F.col("at") != F.col("first.at")) | (F.col("n") != F.col("first.n"))).select(cells("head").alias("h"), cells("value").alias("v"))
    return j.select(*[F.coalesce(F.get("v", (F.array_position("h", c) - 1).cast("int")), F.lit("")).alias(c) for c in SUMMARY_COLUMNS])


def history(spark: SparkSession, path: str) -> DataFrame:
    """(ts, phase_queues, phase) from three parallel lists, the queues as a map of numbers by phase; a file that lacks one
    gives no rows."""
    d = spark.read.option("multiLine", True).schema("timestamps array<string>, phase_queues array<map<string,double>>, phases array<int>").json(path)
    ok = d.where("timestamps is not null and phase_queues is not null and phases is not null")
    z = ok.select(F.explode(F.arrays_zip("timestamps", "phase_queues", "phases")).alias("z"))
    return z.select(F.to_timestamp("z.timestamps").alias("ts"), F.transform_keys("z.phase_queues", lambda k, v: k.cast("int")).alias("phase_queues"), F.col("z.phases").alias("phase"))


def named_runs(spark: SparkSession, runs: dict[str, str], schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("run", F.lit(n)) for n, p in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scenarios(folder: str) -> list[dict[str, str]]:
    """Folders with a configuration and a network; those without routes are skipped, one lacking another file raises."""
    out = []
    for d in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        found = {k: next(iter(sorted(d.glob(f"*.{k}"))), None) for k in ("sumocfg", "net.xml", "rou.xml")}
        if found["rou.xml"] is None:
            continue
        if found["sumocfg"] is None or found["net.xml"] is None:
            raise FileNotFoundError(f"{d.name} lacks its configuration or network")
        out.append({"name": d.name} | {k: str(v) for k, v in found.items()})
    return out


def simulation_end(cfg: str, default: int = 3600) -> int:
    m = re.search(r'<end\s+value="([\d.]+)"', Path(cfg).read_text(encoding="utf-8"))
    return int(float(m.group(1))) if m else default


def latest_checkpoint(folder: str, needs: str = "adapter_config.json") -> str | None:
    """The checkpoint folder of the largest step that holds the file it needs."""
    steps = [(int(m.group(1)), str(p)) for p in Path(folder).glob("checkpoint-*") if (m := re.fullmatch(r"checkpoint-(\d+)", p.name)) and (p / needs).exists()]
    return max(steps)[1] if steps else None


LANE_STEP = "tl_id string, step int, lane_id string, halting int, waiting double, vehicle_ids array<string>"
TL_STEP = "tl_id string, step int, phase int"


def sim_trace(spark: SparkSession, path: str, kind: str = "lane_step") -> DataFrame:
    """A simulation's trace in place of its probes: `lane_step` (halting, waiting and vehicles of each lane and step) or
    `tl_step` (each light's phase), parquet or line JSON by the path's ending; line JSON must fit the schema."""
    schema = {"lane_step": LANE_STEP, "tl_step": TL_STEP}[kind]
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return jsonl(spark, path, schema, strict=True)
    return spark.read.schema(schema).parquet(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, bad, skipped): the lines that are JSON, the others as (file, line, text), and how many each file has. Lines
    are numbered within their file where it is read as one piece (its size below a split's); a larger file's bad lines
    have the number in their split, and `offset` 0 tells the first."""
    raw = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), "value")
    raw = raw.withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    first = raw.groupBy("file", "offset").agg(F.min("line").alias("__first"))
    raw = raw.where(F.col("value").rlike(r"\S"))
    good = F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = raw.withColumn("r", good)
    rows = parsed.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")
    bad = parsed.where("r._corrupt_record is not null").join(first, ["file", "offset"]).select("file", "offset", (F.col("line") - F.col("__first") + 1).alias("line"), F.col("value").alias("text"))
    return rows, bad, bad.groupBy("file").agg(F.count(F.lit(1)).alias("skipped"))


def network_path(cfg: str) -> str:
    """The network file a simulation's configuration names, relative to its folder; none raises."""
    m = re.search(r'<net-file\s+value="([^"]+)"', Path(cfg).read_text(encoding="utf-8"))
    if not m:
        raise ValueError(f"{cfg} names no network")
    return str((Path(cfg).parent / m.group(1)).resolve())


def rewritten_config(cfg: str, target: str, routes: str | None = None, end: int | None = None) -> str:
    """A copy of a configuration at `target` with absolute input paths and, if given, other routes and end time."""
    import xml.etree.ElementTree as ET

    tree, base = ET.parse(cfg), Path(cfg).parent
    for tag in ("net-file", "route-files", "additional-files"):
        for e in tree.getroot().iter(tag):
            value = routes if tag == "route-files" and routes else e.get("value", "")
            e.set("value", ",".join(str((base / v.strip()).resolve()) for v in value.split(",") if v.strip()))
    if end is not None:
        for e in tree.getroot().iter("end"):
            e.set("value", str(end))
    tree.write(target, encoding="utf-8", xml_declaration=True)
    return target


@dataclass(frozen=True)
class BenchmarkConfig:
    """Settings of a benchmark run, with their defaults; `load_config` checks them."""

    cycle_duration: int = 60
    warmup_seconds: int = 300
    simulation_seconds: int = 3600
    step_length: float = 1.0
    environments_dir: str = "sumo_simulation/environments"
    output_dir: str = "benchmark/results"
    log_level: str = "info"
    llm_timeout_seconds: int = 300
    llm_api_base_url: str = "http://localhost:1234/v1"
    llm_max_retries: int = 2
    llm_retry_base_delay: float = 1.0

    def check(self) -> BenchmarkConfig:
        wrong = [n for n, ok in {
            "cycle_duration": self.cycle_duration > 0, "warmup_seconds": self.warmup_seconds >= 0, "simulation_seconds": self.simulation_seconds > self.warmup_seconds, "step_length": self.step_length > 0,
            "log_level": self.log_level in ("info", "debug"), "llm_timeout_seconds": self.llm_timeout_seconds > 0, "llm_api_base_url": bool(self.llm_api_base_url), "llm_max_retries": self.llm_max_retries >= 0, "llm_retry_base_delay": self.llm_retry_base_delay > 0,
        }.items() if not ok]
        if wrong:
            raise ValueError(f"bad settings: {', '.join(wrong)}")
        return self


#: Where a configuration file keeps each setting.
CONFIG_KEYS = {
    "cycle_duration": ("simulation", "cycle_duration"), "warmup_seconds": ("simulation", "warmup_seconds"), "simulation_seconds": ("simulation", "simulation_seconds"), "step_length": ("simulation", "step_length"),
    "environments_dir": ("paths", "environments_dir"), "output_dir": ("paths", "output_dir"), "log_level": ("logging", "level"),
    "llm_timeout_seconds": ("llm", "timeout_seconds"), "llm_api_base_url": ("llm", "api_base_url"), "llm_max_retries": ("llm", "max_retries"), "llm_retry_base_delay": ("llm", "retry_base_delay"),
}


def load_config(path: str) -> BenchmarkConfig:
    """The settings of a JSON file over the defaults; without the file the defaults."""
    p = Path(path)
    data = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
    return BenchmarkConfig(**{k: data[a][b] for k, (a, b) in CONFIG_KEYS.items() if b in data.get(a, {})}).check()


def load_models(path: str) -> list[tuple[str, bool]]:
    """(name, structured output) of a batch file's models, given as names (then true) or as objects; no model or one
    without a name raises."""
    out = []
    for m in json.loads(Path(path).read_text(encoding="utf-8")).get("models", []):
        if not isinstance(m, str | dict):
            raise ValueError(f"bad model: {m}")
        out.append((m, True) if isinstance(m, str) else (m.get("name", ""), m.get("structured_output", True)))
    if not out or not all(n for n, _ in out):
        raise ValueError("models without names")
    return out


def latest_file(spark: SparkSession, folder: str, pattern: str = "comparison_*.csv") -> str | None:
    """The newest file of a folder, ties by name; listed with the files' metadata, without reading them."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    r = d.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return r["p"] if r else None


def merged_jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the given files (an explicit list, so stale ones stay out) with their file and its place in the list;
    blank lines are skipped."""
    parts = [jsonl(spark, p, schema, strict=True).withColumn("place", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)
