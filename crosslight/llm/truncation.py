"""Problem 2: texts cut off before their end.

Near-copies are found by min-hash banding, over the five-word shingles of whole texts and of their beginnings, so that a
copy cut anywhere behind its first LADDER words meets its whole one. Verified pairs are aligned; the copy whose alignment
ends while the other goes on is cut, unless its form is closed (the other then only has more behind its end). Texts
without such a copy are judged by the terminality of their closing words and marks, as counted over all texts, and by the
delimiters and the plan that their form calls for. `cause` tells which of the three decided.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .automata import open_delimiters
from .common import cut, small
from .neardup import CELL_ROWS, _mix
from .refusals import PHASE_WORK, PLACEHOLDER, is_refusal

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 8, 4
LADDER, LADDER_BANDS, LADDER_ROWS = 32, 2, 3  # beginnings of 32, 64, 128, ... shingles have keys of their own
BAND = 12  # words by which an alignment may shift from one anchor to the next
CLOSING_MARK, CLOSING_PRIOR = 0.04, 50.0  # least share of a closing mark's occurrences that end a text; weight of the prior

#: The tags of an answer, and strings that show a text to repeat a prompt.
END_PLAN = "</SOLUTION>"
TAG = re.compile(r"</?(?:start_working_out|end_working_out|SOLUTION)>")
PROMPT_MARKS = ("【cycle_predict_input_json】", '"phase_waits"', "final 介于 min_green 与 max_green", "结果数组只含 phase_id 与 final", "推理写在 <start_working_out>", "【/cycle_predict_input_json】", "The array holds only phase_id", "keep every final between min_green", "in whole seconds.\nRules:")
CUT_MARKS = re.compile(r"(?:\[more\]|\.\.\.|…|�)$")
STRONG_END = "。！？!?”）)】」>]}`"


def _unwrap(text: str) -> tuple[str, bool]:
    """The content of an answer inside a JSON object, and whether the object is broken off."""
    t = text.strip()
    if not re.match(r'\{\s*"content"\s*:', t):
        return text, False
    try:
        inner = json.loads(t)["content"]
        return (inner if isinstance(inner, str) else ""), False
    except ValueError:
        return re.sub(r'^\{\s*"content"\s*:\s*"?', "", t), True


def _mask(s: str) -> str:
    return re.sub(r"\d+(?:\.\d+)?", "9", s)


def inspect(text: str) -> tuple[str, int | None, str | None, str | None]:
    """(kind, verdict, opener, unit) of a text. kind: blank, refusal, copy, answer or note. verdict: 1 cut, 0 whole,
    None open. opener: the masked first sentence where the form is told by it. unit: the closing line or closing words
    whose terminality decides."""
    body, broken = _unwrap(text)
    t = body.strip().strip("﻿​").strip()
    first = re.match(r"[^。.!?！？\n]*[。.!?！？]", re.sub(r"^\s*<start_working_out>\s*", "", t))
    opener = _mask(first.group(0).strip())[:80] if first else None
    if END_PLAN in t:
        return "answer", int(broken and not text.rstrip().endswith("}")), opener, None
    bare = TAG.sub("", t).strip()
    if PLACEHOLDER.fullmatch(bare):
        return "blank", 0, None, None
    if is_refusal(bare):
        return "refusal", 0, None, None
    if any(m in t for m in PROMPT_MARKS):
        return "copy", 0, None, None
    if broken or TAG.search(t) or re.search(r"</?[a-zA-Z_]{0,18}$", t):
        return "answer", 1, opener, None
    if not PHASE_WORK.search(t) and len(t) > len(opener or "") + 25:
        opener = None  # a note that only begins like an answer
    if CUT_MARKS.search(t):
        return "note", 1, None, None
    line = t.rsplit("\n", 1)[-1].strip()
    if "\n" in t and len(line) <= 40 and line[-1:] not in STRONG_END:
        return "note", None, opener, "line " + _mask(line)
    if open_delimiters(line) and line[-1:] not in "。！？!?.":
        return "note", 1, opener, None
    if line[-1:] == "." and (m := re.search(r"([A-Za-z]+|[^\W\d_]{1,2}) ?\d+\.$", line)):
        return "note", None, opener, "number " + m.group(1).lower()
    return "note", None, opener, "mark " + line[-1:]


_NUMBER = re.compile(r"([A-Za-z]+|[^\W\d_]{1,2}) ?\d+\.(\d|\s)")


def closings(text: str) -> list[tuple[str, int, int]]:
    """(unit, ended, went on) that a text without a closed plan tells about closing words: words before a number with a
    full stop, and short lines with every beginning of them."""
    out = [("number " + w.lower(), int(not c.isdigit()), int(c.isdigit())) for w, c in _NUMBER.findall(text)]
    t = text.strip()
    if "\n" in t and "<" not in t:
        for line in t.split("\n")[1:]:
            m = _mask(line.strip())
            if 0 < len(m) <= 40:
                out.append(("line " + m, 1, 0))
                out += [("line " + m[:k].strip(), 0, 1) for k in range(1, len(m)) if m[:k].strip() != m]
    return out


def closing_marks(notes: list[str]) -> list[dict]:
    """What notes tell about the marks and characters they end with: how often each ends a note, and how often it
    stands elsewhere (a full stop only where a blank follows, as others stand in numbers)."""
    notes = [t.strip() for t in notes if t.strip()]
    if not notes:
        return []
    ends = Counter(t[-1] for t in notes)
    codes = np.frombuffer("".join(notes).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = {chr(c): int(n) for c, n in zip(*np.unique(codes, return_counts=True))}
    seen["."] = ends["."] + sum(t.count(". ") + t.count(".\n") for t in notes)
    return [{"unit": "mark " + c, "e": ends[c], "c": n - ends[c]} for c, n in seen.items() if not 0xD800 <= ord(c) < 0xE000]


def _shingles(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of each five-word shingle; a Chinese character is a word, a run of other letters and
    digits too."""
    size = texts.str.len().to_numpy(np.int64)
    codes = np.frombuffer("".join(texts.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(size)), size)
    han = (codes >= 0x3400) & (codes < 0xA000)
    run = ((codes >= 48) & (codes < 58)) | ((codes >= 65) & (codes < 91)) | ((codes >= 97) & (codes < 123)) | ((codes >= 0xC0) & (codes < 0x2000))
    word = han | run
    if not word.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    prev = np.concatenate([[False], run[:-1]]) & np.concatenate([[False], doc[1:] == doc[:-1]])
    start = np.flatnonzero(word & (han | ~(run & prev)))
    at = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))])
    value = np.where(word, _mix(codes.astype(np.uint64) * np.uint64(0x100000001B3) + at.astype(np.uint64)), np.uint64(0))
    w = np.add.reduceat(value, start)
    d = doc[start]
    if len(w) < WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(len(w) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        h = h * np.uint64(1_000_003) + w[k : len(w) - WORDS + 1 + k]
    same = d[WORDS - 1 :] == d[: len(d) - WORDS + 1]
    return d[: len(h)][same], _mix(h)[same]


def band_keys(texts: DataFrame) -> DataFrame:
    """(sig, cid, target): keys of every text of at least five words. BANDS keys of ROWS minima each over the whole
    text; LADDER_BANDS keys of LADDER_ROWS minima over each of its beginnings of 32, 64, 128, ... shingles. All keys
    are targets but those of notes, by their whole and their longest beginning: alignment may show only these to end
    early. A text that closes its plan is whole, one that has come to its tags without is cut, whatever copy it has; a
    copy of a note may be of any kind."""
    def emit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf.drop_duplicates("cid")
            d, h = _shingles(pdf["text"])
            if not len(d):
                continue
            start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            size = np.diff(np.append(start, len(d)))
            cid, out = pdf["cid"].to_numpy()[d[start]], []
            kind = np.array(["closed" if c & 1 else inspect(x)[0] for c, x in zip(pdf["cid"], pdf["text"])], object)[d[start]]
            settled = kind != "note"
            levels = [LADDER << k for k in range(40) if LADDER << k <= size.max()]
            having = [np.flatnonzero(size >= n) for n in levels]
            near = [[np.full(len(w), (b + 1) * 7919 + n, np.uint64) for b in range(LADDER_BANDS)] for n, w in zip(levels, having)]
            for b in range(BANDS):
                key = np.full(len(start), b + 1, np.uint64)
                for r in range(ROWS):
                    k = b * ROWS + r
                    x = _mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    key = _mix(key * np.uint64(31) + np.minimum.reduceat(x, start))
                    if k < LADDER_BANDS * LADDER_ROWS:
                        x = np.append(x, np.uint64(2**64 - 1))
                        for n, w, keys in zip(levels, having, near):
                            least = np.minimum.reduceat(x, np.stack([start[w], start[w] + n], 1).ravel())[::2]
                            keys[k // LADDER_ROWS] = _mix(keys[k // LADDER_ROWS] * np.uint64(31) + least)
                out.append(pd.DataFrame({"sig": key.view(np.int64), "cid": cid, "target": settled}))
            for n, w, keys in zip(levels, having, near):
                out += [pd.DataFrame({"sig": key.view(np.int64), "cid": cid[w], "target": settled[w] | (size[w] >= 2 * n)}) for key in keys]
            yield pd.concat(out)

    return texts.select("cid", "text").mapInPandas(emit, "sig bigint, cid bigint, target boolean")


_W = re.compile(r"[^\W_㐀-鿿]+|[㐀-鿿]")


def _words(s: str) -> list[str]:
    return _W.findall(s)


def ends_early(a: str, b: str) -> bool:
    """Whether `b` goes on where `a` ends: a's five-word shingles are aligned with b's in order, each within BAND words
    of where the last one left off; a and the aligned beginning of b must share SIMILARITY of their shingles, the
    alignment must reach a's last words, and b must have more words behind than a. A last word that may be broken off is
    no part of the alignment."""
    a, b = a.strip().rstrip("�"), b.strip()
    x, y = _words(a), _words(b)
    broken = ""
    if x and len(x[-1]) > 1 and a[-1:] == x[-1][-1]:
        *x, broken = x
    if len(x) < WORDS or len(y) <= len(x) - BAND:
        return False
    where: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(y) - WORDS + 1):
        where.setdefault(tuple(y[j : j + WORDS]), []).append(j)
    own = [tuple(x[i : i + WORDS]) for i in range(len(x) - WORDS + 1)]
    shift, last, i_end, j_end, hits = 0, -1, -1, -1, 0
    for i, g in enumerate(own):
        best = None
        for j in where.get(g, ()):
            if j > last and abs(j - i - shift) <= BAND and (best is None or abs(j - i - shift) < abs(best - i - shift)):
                best = j
        if best is not None:
            shift, last, i_end, j_end, hits = best - i, best, i, best, hits + 1
    if not hits:
        return False
    tail = len(own) - 1 - i_end  # a's words behind the last anchor
    rest = len(y) - WORDS - j_end
    upto = tail + bool(broken)  # as many words of b would end with a
    longer = broken and not tail and rest == 1 and len(y[-1]) > len(broken) and y[-1].startswith(broken)
    if tail > WORDS + 1 or not (longer or rest > upto + bool(tail)):
        return False
    s, t = set(own), {g for g, js in where.items() if js[0] <= j_end + tail}
    return len(s & t) >= SIMILARITY * len(s | t)


def text_key(text: F.Column) -> F.Column:
    """A hash of the text whose lowest bit tells whether it closes a plan: two such texts need no alignment."""
    return F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.contains(text, F.lit(END_PLAN)).cast("bigint"))


def open_pairs(sigs: DataFrame) -> DataFrame:
    """(u, v) with u < v: all pairs of texts with an equal key, but for those that are both targets. The texts of a key
    that more than CELL_ROWS have are dealt into parts, and each two parts meet by themselves."""
    def pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
            sig, cid, salt, crossed = p["sig"].to_numpy(), p["cid"].to_numpy(), p["salt"].to_numpy(), p["crossed"].to_numpy(bool)
            us, vs, held = [], [], 0
            i = np.flatnonzero(~p["target"].to_numpy(bool))  # these come first under a key
            for d in range(1, len(p)):
                i = i[i + d < len(p)]
                i = i[sig[i] == sig[i + d]]
                if not len(i):
                    break
                at = i[~(crossed[i] & (salt[i] == salt[i + d]))]
                us.append(cid[at])
                vs.append(cid[at + d])
                held += len(at)
                if held > 500_000:
                    yield out(us, vs)
                    us, vs, held = [], [], 0
            if us:
                yield out(us, vs)

        def out(us: list[np.ndarray], vs: list[np.ndarray]) -> pd.DataFrame:
            u, v = np.concatenate(us), np.concatenate(vs)
            return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

        kept: list[pd.DataFrame] = []  # what came of the last key so far
        for pdf in it:
            if not len(pdf):
                continue
            key = pdf["sig"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and (not kept or kept[0]["sig"].iat[0] == key[0]):
                kept.append(pdf)
                continue
            done = pd.concat([*kept, pdf[:last]])
            kept = [pdf[last:]]
            yield from run(done)
        if kept:
            yield from run(pd.concat(kept))

    sigs = cut(sigs.distinct())
    full = sigs.groupBy("sig").count().where(F.col("count") > CELL_ROWS).select("sig", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts"))
    parts = sigs.join(F.broadcast(full), "sig", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = parts.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.when(F.col("parts") == 1, F.col("sig")).otherwise(F.xxhash64("sig", F.least("salt", "other"), F.greatest("salt", "other")))
    met = met.select(own.alias("sig"), "salt", (F.col("salt") != F.col("other")).alias("crossed"), "cid", "target")
    return met.repartition("sig").sortWithinPartitions("sig", "target", "cid").mapInPandas(pairs, "u bigint, v bigint").distinct()


def aligned_cuts(texts: DataFrame) -> DataFrame:
    """(cid) of texts with a near-copy that goes on where they end. `texts` is (cid, text), repeats included; pairs of
    closed plans leave before texts are joined."""
    pairs = cut(open_pairs(band_keys(texts)))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    t = texts.join(small(ends), "cid", "left_semi").groupBy("cid").agg(F.first("text").alias("text"))
    a, b = (t.select(F.col("cid").alias(k), F.col("text").alias(f"t{k}")) for k in "uv")

    def align(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [u if ends_early(x, y) else v if ends_early(y, x) else None for u, v, x, y in zip(pdf["u"], pdf["v"], pdf["tu"], pdf["tv"])]
            yield pd.DataFrame({"cid": pd.Series([g for g in got if g is not None], dtype="int64")})

    return pairs.join(a, "u").join(b, "v").mapInPandas(align, "cid bigint").distinct()


def all_texts(responses: DataFrame, results: DataFrame) -> DataFrame:
    """(record_table, record_id, source, text) of both tables; null texts count as empty."""
    a = responses.select(F.lit("api_responses").alias("record_table"), F.col("response_id").alias("record_id"), "source", F.coalesce("content", F.lit("")).alias("text"))
    b = results.select(F.lit("teacher_results").alias("record_table"), F.col("result_id").alias("record_id"), "source", F.coalesce("raw_content", F.lit("")).alias("text"))
    return a.union(b)


def judged(texts: DataFrame) -> DataFrame:
    """(record_table, record_id, source, kind, cut, cause) of every text. Repeats are judged once and reported each;
    blank texts, refusals and copies of prompts are whole; an empty table gives no rows. `cause` is alignment,
    terminality or form for a cut text, and null for others."""
    t = texts.withColumn("cid", text_key(F.col("text")))

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: Counter = Counter()
        columns = ["cid", "part", "kind", "verdict", "opener", "unit", "told"]
        for pdf in it:
            rows, notes, one = [], [], {}
            for c, x in zip(pdf["cid"], pdf["text"]):
                if c not in one:
                    one[c] = inspect(x)
                    rows.append((c, -1, *one[c], [{"unit": u, "e": e, "c": n} for u, e, n in closings(x)] if not c & 1 else []))
                if one[c][0] == "note":
                    notes.append(x)
            for m in closing_marks(notes):
                marks[m["unit"], 0] += m["e"]
                marks[m["unit"], 1] += m["c"]
            yield pd.DataFrame(rows, columns=columns).astype({"verdict": "Int32"})
        if marks:
            told = [{"unit": u, "e": marks[u, 0], "c": marks[u, 1]} for u in sorted({u for u, _ in marks})]
            yield pd.DataFrame([(0, TaskContext.get().partitionId(), "marks", None, None, None, told)], columns=columns).astype({"verdict": "Int32"})

    seen = cut(t.select("cid", "text").mapInPandas(look, "cid bigint, part int, kind string, verdict int, opener string, unit string, told array<struct<unit:string,e:bigint,c:bigint>>").dropDuplicates(["cid", "part"]))
    told = seen.select(F.explode("told").alias("x")).groupBy("x.unit").agg(F.sum("x.e").alias("e"), F.sum("x.c").alias("c"))
    asked = seen.where("unit is not null").select("unit").distinct()
    mark = F.substring("unit", 6, 1)
    prior = F.when(F.lit(STRONG_END + ".").contains(mark), 5 * CLOSING_MARK * CLOSING_PRIOR).otherwise(0.0)
    of_mark = (F.coalesce("e", F.lit(0)) + prior) / (F.coalesce("e", F.lit(0)) + F.coalesce("c", F.lit(0)) + CLOSING_PRIOR) >= CLOSING_MARK
    ends = F.when(F.col("unit").startswith("mark "), of_mark).otherwise(F.coalesce(2 * F.col("e") >= F.col("e") + F.col("c"), F.lit(True)))
    terminal = asked.join(told, "unit", "left").select("unit", ends.alias("terminal"))
    seen = seen.where("kind <> 'marks'").drop("told", "part")
    forms = seen.where("opener is not null").groupBy("opener").agg(F.avg((F.col("kind") == "answer").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).where("n >= 3 and p >= 0.5").select("opener", F.lit(True).alias("plan_form"))
    late = aligned_cuts(t.select("cid", "text")).select("cid", F.lit(True).alias("late"))
    j = seen.join(terminal, "unit", "left").join(forms, "opener", "left").join(late, "cid", "left")
    whole_form = F.col("kind").isin("blank", "refusal", "copy") | ((F.col("kind") == "answer") & (F.col("verdict") == 0))
    open_form = (F.col("kind") == "note") & F.coalesce("plan_form", F.lit(False))
    cause = F.when(whole_form, None).when(F.coalesce("late", F.lit(False)), "alignment").when(~F.coalesce("terminal", F.lit(True)), "terminality").when(open_form | F.coalesce(F.col("verdict") == 1, F.lit(False)), "form")
    j = j.select("cid", "kind", cause.alias("cause"))
    return t.select("record_table", "record_id", "source", "cid").join(j, "cid").select("record_table", "record_id", "source", "kind", F.col("cause").isNotNull().alias("cut"), "cause")


def source_rates(j: DataFrame) -> DataFrame:
    """(record_table, source, texts, cut, cut_rate): how often each source truncates; a null source is `(none)`."""
    g = j.groupBy("record_table", F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("bigint")).alias("cut"))
    return g.withColumn("cut_rate", F.col("cut") / F.col("texts"))


def cut_causes(j: DataFrame) -> DataFrame:
    """(cause, texts): how many cut texts the alignment with a copy, the terminality of the closing words and the form
    decided; a cause without texts does not appear."""
    return j.where("cut").groupBy("cause").agg(F.count(F.lit(1)).alias("texts"))
