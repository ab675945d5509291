"""Problem 7: mixes of sources at target weights.

The weights lie on a temperature path: a source's target share times (its token share / target share) to the power of the
exponent, normalised. Exponent 0 gives the target shares, 1 the sources' own shares (for equal targets these are the usual
temperature weights). The exponent is bisected to the smallest at which no source is repeated more often than it may be,
or to a target entropy. A source falls short when its weight at exponent 0 cannot be met. Budgets of the weights are
realised by permutations of the sources, one for each pass, cut into blocks of tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut, dense_in_groups, slices_for, uniform_hash

TOKENIZER_SETTING, TOKENIZER = "spark.crosslight.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1_000_000
#: Fixed value: the public vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document with a source, the whole text counted; null and empty texts have 0.
    The vocabulary file is the given one, or that of the session's setting TOKENIZER_SETTING."""
    tokenizer = tokenizer or documents.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(tokenizer)
        for pdf in it:
            n = [len(x) for x in e.encode_ordinary_batch(pdf["text"].tolist(), num_threads=1)]
            yield pdf[["doc_id", "source"]].assign(tokens=pd.Series(n, index=pdf.index, dtype="int64"))

    d = documents.where("source is not null").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def temperature_weights(tokens: dict[str, float], exponent: float, base: dict[str, float] | None = None) -> dict[str, float]:
    """The sources' token shares raised to `exponent`, made to add up to 1; with `base` shares, base * (token share /
    base) ** exponent. Sources without tokens keep their base at exponent 0 and weigh 0 beyond; a base of 0 weighs 0."""
    base = base or {k: 1.0 for k in tokens}
    total, every = sum(tokens.values()) or 1.0, sum(base.values()) or 1.0
    x = {}
    for k, t in tokens.items():
        b = base.get(k, 0.0) / every
        x[k] = 0.0 if b <= 0 else b if exponent == 0 else math.exp(math.log(b) + exponent * (math.log(t / total) - math.log(b))) if t > 0 else 0.0
    all_ = sum(x.values())
    return {k: v / all_ if all_ > 0 else 0.0 for k, v in x.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def over_limit(weights: dict[str, float], tokens: dict[str, float], max_repeats: dict[str, float], size: float) -> list[str]:
    """The sources whose weight of `size` tokens takes more than their tokens times their limit."""
    return [k for k, w in weights.items() if w * size > tokens[k] * max_repeats.get(k, 1.0) * (1 + 1e-12)]


def bisect_exponent(tokens: dict[str, float], target_entropy: float | None = None, max_repeats: dict[str, float] | None = None, size: float | None = None, base: dict[str, float] | None = None) -> float:
    """The exponent in [0, 8] whose weights reach `target_entropy` (which falls as it grows), or, for a repetition
    limit, the smallest in [0, 1] at which no source needs more than its tokens times its limit; 1 where none does."""
    size = size or sum(tokens.values())

    def short(e: float) -> bool:
        w = temperature_weights(tokens, e, base)
        return bool(over_limit(w, tokens, max_repeats, size)) if max_repeats is not None else entropy(w) > (target_entropy or 0.0)

    lo, hi = 0.0, 8.0 if max_repeats is None else 1.0
    if not short(lo):
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if short(mid) else (lo, mid)
    return hi


def budgets(counts: DataFrame, targets: DataFrame, mode: str = "shares") -> DataFrame:
    """One row per (mix_id, source) of the targets: tokens there are, weight, budget, whole passes, the rest of the last
    pass, and whether the source falls short at its target share.

    The mix is as large as all documents with a source. `mode` shares: the weights at exponent 0, the given shares; what
    a limit takes from a budget is not given to others. `mode` tempered: the weights at `exponent`, the smallest at which
    every source of the mix meets its limit (what rounding puts above it is cut); where even exponent 1 does not, budgets
    are cut too. `like_entropy` is the exponent of plain temperature weights that have the targets' entropy. Null limits
    and shares count 0. Sources are few (a fixed table)."""
    spark = counts.sparkSession
    have = {r["source"]: int(r["t"]) for r in counts.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    size = sum(have.values())
    rows = [r.asDict() for r in targets.collect()]
    out = []
    for mix in sorted({r["mix_id"] for r in rows}):
        own = [r for r in rows if r["mix_id"] == mix]
        tokens = {r["source"]: float(have.get(r["source"], 0)) for r in own}
        limit = {r["source"]: float(r["max_repeats"] or 0) for r in own}
        shares = {r["source"]: float(r["target_share"] or 0.0) for r in own}
        short = set(over_limit(shares, tokens, limit, float(size)))
        e = bisect_exponent(tokens, None, limit, float(size), shares)
        like = bisect_exponent(tokens, entropy(shares))
        weights = shares if mode == "shares" else temperature_weights(tokens, e, shares)
        for r in own:
            t, s = have.get(r["source"], 0), r["source"]
            budget = min(int(round(weights[s] * size)), t * int(limit[s]))
            passes = budget // t if t else 0
            out.append((mix, s, shares[s], int(limit[s]), t, weights[s], budget, passes, budget - passes * t, s in short, e, like))
    return spark.createDataFrame(out, "mix_id string, source string, target_share double, max_repeats int, tokens bigint, weight double, budget bigint, passes bigint, rest bigint, falls_short boolean, exponent double, like_entropy double")


def realise(counts: DataFrame, plan: DataFrame, seed: int = 29, block: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, source, pass, position, block, block_order, doc_id, tokens): the documents of each mix, one row for each
    use. Every pass over a source is a permutation of its own, ordered by a hash; the last one stops where the budget
    ends, a document on the border being taken when at least half of its tokens lie before it. `position` counts the
    source's tokens before the document over all passes, `block` is the stretch of `block` tokens it begins in, and
    `block_order` a hash that permutes the blocks of all sources: the mix in order of (block_order, position) has every
    source's share throughout. Permutations are ranked in slices, so no task holds a source. Documents without tokens
    are used in whole passes; a source with budget 0 gives no rows."""
    uses = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("passes", F.col("max_repeats") - F.lit(1).cast("bigint")))).alias("pass")
    p = plan.where("budget > 0 and max_repeats > 0").select("mix_id", F.col("source").alias("s"), "passes", "rest", F.col("tokens").alias("all"), uses)
    j = counts.join(F.broadcast(p), F.col("source") == F.col("s")).drop("s")
    j = j.withColumn("h", uniform_hash(F.col("mix_id"), F.col("doc_id"), F.col("pass"), F.lit(seed))).withColumn("__id", F.col("doc_id"))
    run = dense_in_groups(j, ["mix_id", "source", "pass"], "h", "at", slices_for(counts.count()), "tokens")
    taken = run.where((F.col("pass") < F.col("passes")) | ((F.col("at") < F.col("rest")) & (F.col("at") + F.col("tokens") / 2 <= F.col("rest"))))
    position = F.col("pass") * F.col("all") + F.col("at")
    number = F.floor(position / block)
    return taken.select("mix_id", "source", "pass", position.alias("position"), number.alias("block"), uniform_hash(F.col("mix_id"), F.col("source"), number, F.lit(seed)).alias("block_order"), "doc_id", "tokens")


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual tokens and share of each source of each mix beside its target, and how often a document was used at most."""
    use = mix.groupBy("mix_id", "source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    got = use.groupBy("mix_id", "source").agg(F.sum("t").alias("mixed"), F.max("c").alias("most_copies"))
    j = plan.join(got, ["mix_id", "source"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    total = j.groupBy("mix_id").agg(F.sum("mixed").alias("all"))
    return j.join(F.broadcast(total), "mix_id").select("mix_id", "source", "target_share", "weight", F.coalesce(F.try_divide("mixed", "all"), F.lit(0.0)).alias("actual_share"), "tokens", "budget", "mixed", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "falls_short", "exponent", "like_entropy")


def build(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, mode: str = "shares") -> tuple[DataFrame, DataFrame]:
    """The counts (computed once, written) and the plan."""
    counts = cut(token_counts(documents, tokenizer))
    return counts, budgets(counts, targets, mode)
