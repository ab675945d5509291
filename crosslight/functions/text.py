"""Expressions on prompts, answers and paths, and the strict plan parser."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The tags of an answer and of the input in a prompt.
START, END, OPEN, CLOSE = "<start_working_out>", "<end_working_out>", "<SOLUTION>", "</SOLUTION>"
INPUT_OPEN, INPUT_CLOSE = "【cycle_predict_input_json】", "【/cycle_predict_input_json】"
FORMAT = rf"(?sU){END}.*?{OPEN}(.+?){CLOSE}\s*$"

PLAN = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("is_list", T.BooleanType()), T.StructField("elems", T.ArrayType(T.StructType([T.StructField("is_obj", T.BooleanType()), T.StructField("phase_id", T.LongType()), T.StructField("final", T.LongType()), T.StructField("final_type", T.StringType())])))])


def _plan(text: str | None) -> dict:
    try:
        v = json.loads(text or "")
    except ValueError:
        return {"ok": False, "is_list": False, "elems": None}
    if not isinstance(v, list):
        return {"ok": True, "is_list": False, "elems": None}
    whole = lambda x: int(x) if isinstance(x, int) and -(1 << 63) <= x < 1 << 63 else None
    return {"ok": True, "is_list": True, "elems": [{"is_obj": isinstance(e, dict), "phase_id": whole(e.get("phase_id")) if isinstance(e, dict) else None, "final": whole(e.get("final")) if isinstance(e, dict) else None, "final_type": type(e.get("final")).__name__ if isinstance(e, dict) else None} for e in v]}


@F.pandas_udf(PLAN)
def plan_parse(text: pd.Series) -> pd.DataFrame:
    """Parses a plan as strictly as a JSON library: whole numbers and booleans are whole, 30.0 and "30" are not, trailing
    junk and single quotes fail. Null and empty texts fail."""
    return pd.DataFrame([_plan(t) for t in text], columns=["ok", "is_list", "elems"])


def plan_native(text: Column) -> Column:
    """The same verdict (plan or not) without Python: a VARIANT whose schema is an array, and no junk around it."""
    v = F.try_parse_json(text)
    return F.coalesce(text.rlike(r"(?sU)^\s*\[.*\]\s*$") & v.isNotNull() & F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def solution_text(answer: Column) -> Column:
    """What stands between the plan's tags; null without both."""
    x = F.regexp_extract(answer, rf"(?s){OPEN}(.*?){CLOSE}", 1)
    return F.when(answer.contains(OPEN) & answer.rlike(rf"(?s){OPEN}.*{CLOSE}"), x)


def think_text(answer: Column) -> Column:
    """The reasoning: from behind its start tag, or the text's start, to its end tag; null without an end tag."""
    head = F.when(answer.contains(START), F.substring_index(answer, START, -1)).otherwise(answer)
    return F.when(head.contains(END), F.substring_index(head, END, 1)).when(head.contains("</start_working_out>"), F.substring_index(head, "</start_working_out>", 1))


def score_format_exact(answer: Column, most: float = 3.0) -> Column:
    return F.when(answer.rlike(FORMAT), most).otherwise(0.0)


def score_format_approx(answer: Column) -> Column:
    """Half a point for each tag that occurs once, a point off for any other count."""
    one = lambda tag: F.when(F.coalesce(F.regexp_count(answer, F.lit(tag)), F.lit(0)) == 1, 0.5).otherwise(-1.0)
    return one(END) + one(OPEN) + one(CLOSE)


def score_think_length(answer: Column, low: float = 50, high: float = 300, bonus: float = 0.5, penalty: float = -0.5, linear: bool = False) -> Column:
    """Tokens are half the characters before the end tag: the penalty without an end tag, a part of it that grows with
    the distance outside [low, high], the bonus inside (with `linear` a part of it that grows from low to high)."""
    at = F.instr(answer, END)
    n = (at - 1) / 2
    inside = bonus * (n - low) / (high - low) if linear else F.lit(bonus)
    return F.when(at == 0, penalty).when(n < low, penalty * (1 - n / low)).when(n > high, penalty * (n / high - 1)).otherwise(inside)


def rel_state_path(path: Column) -> Column:
    at = F.instr(path, "outputs/states/")
    return F.when(at > 0, path.substr(at, F.length(path))).otherwise(path)


def scenario_label(path: Column) -> Column:
    """The first of two scenario names that a path contains, else unknown."""
    return F.when(path.contains("chengdu"), "chengdu").when(path.contains("arterial4x4_10"), "arterial4x4_10").otherwise("unknown")


def scenario_cfg_path(path: Column) -> Column:
    """The simulation's configuration for a relative state file, by its third folder; another scenario raises."""
    name = F.get(F.split(path, "/"), F.lit(2))
    grid = F.concat(F.lit("sumo_simulation/arterial4x4/"), name, F.lit("/arterial4x4.sumocfg"))
    city = F.lit("sumo_simulation/environments/chengdu/chengdu.sumocfg")
    return F.when(name.startswith("arterial4x4"), grid).when(name == "chengdu", city).otherwise(F.raise_error(F.concat(F.lit("unknown scenario: "), F.coalesce(name, F.lit("(none)")))).cast("string"))


def sample_id(tl: Column, as_of: Column) -> Column:
    return F.concat_ws(":", tl, as_of)


def state_filename(date: Column, time: Column, tl: Column, packed: bool = True) -> Column:
    return F.concat(F.lit("state_"), date, F.lit("_T"), F.translate(time, ":", "-"), F.lit("_"), tl, F.lit(".xml.gz" if packed else ".xml"))


def unwrap_response(text: Column) -> Column:
    """The `content` of a JSON object, else the text."""
    return F.coalesce(F.get_json_object(text, "$.content"), text)


def failure_record(id_: Column, status: Column, error: Column, text: Column, keep: int = 500) -> Column:
    """What is kept of an answer that failed: its id, status, error and first `keep` characters."""
    return F.struct(id_.alias("id"), status.alias("status"), error.alias("error"), F.substring(text, 1, keep).alias("raw_content"))


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\", "__")


def strip_suffix_tokens(text: Column, token: str = r"<\|[a-z_]+\|>") -> Column:
    return F.regexp_replace(text, rf"(?:{token}|\s)+$", "")


def chat_render(messages: Column, eos: str = "</s>", generate: bool = False) -> Column:
    """The messages' contents one after the other, answers closed by `eos`, the start tag behind when generating."""
    parts = F.transform(messages, lambda m: F.when(m["role"] == "assistant", F.concat(m["content"], F.lit(eos))).otherwise(m["content"]))
    return F.concat(F.array_join(parts, ""), F.lit(START if generate else ""))


def _number(c: Column) -> Column:
    """A number of at most 4 decimals as JSON libraries print it: 0.5, 1.0, null."""
    plain = F.regexp_replace(c.cast("decimal(30,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(c.isNull(), "null").when(F.isnan(c), "NaN").otherwise(plain)


def prediction_json(prediction: Column) -> Column:
    """The input's JSON, indented by two: as_of and the phases with their fields in the given order."""
    def one(w: Column, names: list[str]) -> Column:
        parts = [F.concat(F.lit(f'        "{n}": '), _number(w[n]) if n in ("pred_saturation", "pred_wait") else F.coalesce(w[n].cast("string"), F.lit("null"))) for n in names]
        return F.concat(F.lit("      {\n"), F.concat_ws(",\n", *parts), F.lit("\n      }"))

    waits = prediction["phase_waits"]
    fields = ["phase_id", "pred_saturation", "min_green", "max_green", "capacity"]
    body = F.array_join(F.transform(waits, lambda w: one(w, fields)), ",\n")
    list_ = F.when(F.size(waits) > 0, F.concat(F.lit("[\n"), body, F.lit("\n    ]"))).otherwise(F.lit("[]"))
    as_of = F.coalesce(F.concat(F.lit('"'), prediction["as_of"], F.lit('"')), F.lit("null"))
    return F.concat(F.lit('{\n  "prediction": {\n    "as_of": '), as_of, F.lit(',\n    "phase_waits": '), list_, F.lit("\n  }\n}"))


def render_prompt(prediction: Column, wording: str) -> Column:
    """The input's JSON between its tags and the wording behind."""
    return F.concat(F.lit(INPUT_OPEN), prediction_json(prediction), F.lit(INPUT_CLOSE + "\n" + wording))


def teacher_prompt(prediction: Column, system: str, wording: str, low: int = 50, high: int = 300) -> Column:
    """(system, user): the system prompt with a hint of the reasoning's length, and the prompt rendered anew."""
    hint = f"{system}\nKeep the reasoning between {low} and {high} tokens." if high else system
    return F.struct(F.lit(hint).alias("system"), render_prompt(prediction, wording).alias("user"))


def prompt_json(prompt: Column) -> Column:
    return F.regexp_extract(prompt, rf"(?s){INPUT_OPEN}(.*?){INPUT_CLOSE}", 1)


_WAITS = "array<struct<phase_id:int,pred_wait:double,pred_saturation:double,min_green:int,max_green:int,capacity:int>>"


def inject_pred_wait(prompt: Column, wording: str) -> Column:
    """The prompt with pred_wait = saturation (0 if missing) times capacity (30 if missing), to 2 digits, in each phase
    that has none, rendered anew behind the other fields; a prompt without its input's JSON stays as it is."""
    j = F.from_json(prompt_json(prompt), f"prediction struct<as_of:string,phase_waits:{_WAITS}>")["prediction"]
    wait = lambda w: F.coalesce(w["pred_wait"], F.round(F.coalesce(w["pred_saturation"], F.lit(0.0)) * F.coalesce(w["capacity"], F.lit(30)), 2))
    line = lambda n, v: F.when(v.isNotNull(), F.concat(F.lit(f'        "{n}": '), v))
    one = lambda w: F.concat(F.lit("      {\n"), F.concat_ws(",\n", *[line(n, w[n].cast("string")) if n != "pred_saturation" else line(n, F.when(w[n].isNotNull(), _number(w[n]))) for n in ("phase_id", "pred_saturation", "min_green", "max_green", "capacity")], line("pred_wait", _number(wait(w)))), F.lit("\n      }"))
    body = F.concat(F.lit(INPUT_OPEN + '{\n  "prediction": {\n    "as_of": "'), j["as_of"], F.lit('",\n    "phase_waits": [\n'), F.array_join(F.transform(j["phase_waits"], one), ",\n"), F.lit("\n    ]\n  }\n}" + INPUT_CLOSE + "\n" + wording))
    return F.coalesce(body, prompt)


def to_messages(system: str, prompt: Column, drop_first_line: bool = False) -> Column:
    """System and user messages; optionally without the prompt's first line."""
    body = F.regexp_replace(prompt, r"^[^\n]*\n?", "") if drop_first_line else prompt
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def with_source(metadata: Column, state_file: Column, source: str, names: list[str]) -> Column:
    """Metadata of a record: the state file, made relative, and the source, either of which the sample's own metadata
    field of that name overrides; then its other fields."""
    own = {n: metadata[n] for n in names}
    first = {"state_file": rel_state_path(state_file), "source": F.lit(source)}
    return F.struct(*[F.coalesce(own[n], c).alias(n) if n in own else c.alias(n) for n, c in first.items()], *[c.alias(n) for n, c in own.items() if n not in first])


def simple_messages(system: str, prompt: Column, metadata: Column, state_file: Column, source: str, names: list[str]) -> Column:
    """(prompt, metadata): the record of the simple form, its prompt whole."""
    return F.struct(to_messages(system, prompt).alias("prompt"), with_source(metadata, state_file, source, names).alias("metadata"))


def state_text(phases: Column, phase: Column, seconds: Column) -> Column:
    """The description of a junction in words from an array of (phase, lanes, queue, passed): lanes are numbered 0, 1, ...
    in order of their name, and each phase's queue and passed vehicles are given to two digits."""
    lanes = F.array_sort(F.array_distinct(F.flatten(F.transform(phases, lambda p: p["lanes"]))))
    listing = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda i: i.cast("string")), ", "), F.lit("]"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda p: F.array_sort(F.array_distinct(F.transform(p["lanes"], lambda lane: F.array_position(lanes, lane).cast("int") - 1)))
    scene = F.concat(F.lit("路口场景描述：该路口有"), F.size(phases).cast("string"), F.lit("个相位，分别是"), listing(numbers(F.size(phases))), F.lit("，有"), F.size(lanes).cast("string"), F.lit("个车道，分别是"), listing(numbers(F.size(lanes))), F.lit("，其中"), F.array_join(F.transform(phases, lambda p: F.concat(F.lit("相位"), p["phase"].cast("string"), F.lit("控制车道"), listing(own(p)))), "，"))
    now = F.concat(F.lit("交通状态描述：目前该交叉口的当前相位为"), phase.cast("string"), F.lit("，当前相位持续时间为"), seconds.cast("string"), F.lit("。"))
    each = F.transform(phases, lambda p: F.concat(F.lit("相位("), p["phase"].cast("string"), F.lit(")控制的车道的排队车辆为"), F.format_string("%.2f", p["queue"]), F.lit("，通过车辆数为"), F.format_string("%.2f", p["passed"]), F.lit("。")))
    return F.concat_ws("\n", scene, now, F.array_join(each, "\n"))
