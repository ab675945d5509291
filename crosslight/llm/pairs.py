"""Problem 4: broken prompt and response pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .automata import SuffixAutomaton
from .common import small
from .refusals import PLACEHOLDER, is_refusal
from .truncation import TAG, _unwrap, all_texts, judged

COPIED_SHARE = 0.5
PLAN = re.compile(r"<SOLUTION>.*?(?:</SOLUTION>|$)", re.S)
EMPTY_PLAN = re.compile(r"<SOLUTION>\s*(?:\[\s*\]|\{\s*\}|null)?\s*</SOLUTION>")

#: Frequent words that vote for a language written in Latin letters.
STOPWORDS = {
    "en": "the and is of to in that for at so on with are it each was by this has not first".split(),
    "de": "die der und ist das den von mit für nicht ein eine auf im zu bei wir sich auch ergibt".split(),
    "es": "el la los las de que y en por para es un una se con del son cada esta eso".split(),
    "fr": "le la les des et est que pour dans une un sur par du au avec chaque cette donc nous".split(),
    "pt": "o os as de que e em para um uma com por não do da no na cada são isso".split(),
    "it": "il lo gli di che e per un una con non del della nel ogni sono questa quindi alla dei".split(),
}


def language(text: str) -> str | None:
    """The language most of a text is in: by script first, words in Latin letters by stopword votes; none if there is
    too little to tell."""
    kana, han, cyr = len(re.findall("[぀-ヿ]", text)), len(re.findall("[㐀-鿿]", text)), len(re.findall("[Ѐ-ӿ]", text))
    hangul = len(re.findall("[가-힣]", text))
    words = [w for w in re.findall(r"[^\W\d_㐀-鿿぀-ヿЀ-ӿ가-힣]+", text.lower()) if w not in ("pred", "saturation", "final", "s")]
    size = {"ja": (kana + han) if kana * 5 > han else 0, "zh": 0 if kana * 5 > han else han, "ru": cyr / 3, "ko": hangul, "latin": 1.6 * len(words)}
    top = max(size, key=lambda k: size[k])
    if size[top] < 3:
        return None
    if top != "latin":
        return top
    votes = {k: sum(w in v for w in words) for k, v in STOPWORDS.items()}
    best = max(votes, key=lambda k: votes[k])
    return best if votes[best] > 0 else None


def _letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def copied_share(prompt: str, answer: str) -> float:
    """The share of an answer's letters and digits that lies in stretches of the prompt, of at least 6 characters in
    Chinese and 14 otherwise, by a walk through the prompt's suffix automaton. Where so few blocks of half a stretch occur
    in the prompt that the share must be below COPIED_SHARE, no automaton is built and 0 is returned: a stretch with h
    whole blocks of k characters has at most h * k + 2 * (k - 1), so at most 3 * k - 2 for each block."""
    p, a = _letters(prompt), _letters(answer)
    least = 6 if 3 * len(re.findall("[㐀-鿿]", a)) > len(a) else 14
    if len(a) < least:
        return 0.0
    half = least // 2
    blocks = range(0, len(a) - half + 1, half)  # a stretch of `least` holds at least one whole block, a longer one more
    hits = sum(a[i : i + half] in p for i in blocks)
    if hits * (3 * half - 2) < COPIED_SHARE * len(a):
        return 0.0
    return SuffixAutomaton([p]).coverage(a, least) / len(a)


def defect(prompt: str | None, raw: str | None, think: str | None, cut: bool, plan: str | None = None) -> str | None:
    """The defect of a pair, the first that holds of: empty, truncated, refusal, copied, language. `raw` is judged; only
    where nothing raw was kept, the parsed reasoning `think` with the parsed `plan` (JSON, if any) takes its place.
    Without a prompt, only the first three can be told."""
    text = raw if raw is not None and raw.strip() else (think or "") + (f"<SOLUTION>{plan}</SOLUTION>" if plan is not None else "")
    body = _unwrap(text)[0].strip()
    reasoning = TAG.sub("", PLAN.sub("", body)).strip()
    if PLACEHOLDER.fullmatch(reasoning):
        return "empty" if not cut else "truncated"
    refuses = is_refusal(reasoning)
    if not refuses and EMPTY_PLAN.search(body):
        return "empty"
    if cut:
        return "truncated"
    if refuses:
        return "refusal"
    if prompt is None:
        return None
    whole = body if "【" in body or '"phase_waits"' in body or "phase_waits" in reasoning else reasoning
    if copied_share(prompt, whole) >= COPIED_SHARE:
        return "copied"
    asked = language(re.sub(r"\{.*\}", " ", prompt, flags=re.S))
    given = language(re.sub(r"“[^”]*”|\"[^\"]*\"|「[^」]*」|«[^»]*»|„[^“]*“", " ", reasoning))
    return "language" if asked and given and asked != given else None


def defective_pairs(results: DataFrame, samples: DataFrame, responses: DataFrame) -> DataFrame:
    """(result_id, defect): one row per defective pair. Rows of status api_error or exception are no pairs; repeated
    rows are reported each. Prompts reach their answers by one join on rec_id; white space in them is shrunk first,
    and prompts nobody answered leave before it (their ids are broadcast only when they are few)."""
    cuts = judged(all_texts(responses, results)).where("record_table = 'teacher_results' and cut").select(F.col("record_id").alias("result_id"), F.lit(True).alias("cut"))
    r = results.where("status is null or status not in ('api_error', 'exception')").select("result_id", "rec_id", "raw_content", *[F.when(~F.coalesce(F.col("raw_content").rlike(r"\S"), F.lit(False)), c).alias(n) for c, n in ((F.col("think_text"), "think_text"), (F.to_json("solution"), "plan"))]).join(cuts, "result_id", "left")
    ids = results.select("rec_id").where("rec_id is not null").distinct()
    p = samples.select("rec_id", F.regexp_replace("prompt", r"\s+", " ").alias("prompt")).join(small(ids), "rec_id", "left_semi")

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [defect(a if isinstance(a, str) else None, b if isinstance(b, str) else None, c if isinstance(c, str) else None, bool(k), p if isinstance(p, str) else None) for a, b, c, k, p in zip(pdf["prompt"], pdf["raw_content"], pdf["think_text"], pdf["cut"], pdf["plan"])]
            out = pdf[["result_id"]].assign(defect=got)
            yield out[out["defect"].notna()]

    j = r.join(p, "rec_id", "left").select("result_id", "prompt", "raw_content", "think_text", "plan", F.coalesce("cut", F.lit(False)).alias("cut"))
    return j.mapInPandas(check, "result_id bigint, defect string")
