"""Problem 6: evaluation passages inside training text.

The items' normalised tokens form generalised suffix automata, one over words and one over characters. Documents stream
through them; nothing of the corpus is shuffled. Items beyond SHARD_TOKENS are dealt into several automata, each of which
is one pass over the corpus, so what a task holds is bounded however many items there are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .automata import SuffixAutomaton

LEAST_WORDS, LEAST_CHARS, LEAST_SHARE = 8, 12, 0.5
SHARD_TOKENS = 250_000  # tokens of the items in one automaton: some 150 MB in a worker

_HAN_CLASS = "㐀-鿿豈-﫿"
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]*>|&[a-zA-Z]{1,10};|&#\d{1,7};")
_HAN = re.compile(f"[{_HAN_CLASS}]")
_DROP = re.compile("['’‘­​-‍﻿`]|(?<=[a-z])-[ \t]*\r?\n[ \t]*(?=[a-z])")
_WORD = re.compile(rf"[{_HAN_CLASS}]|[^\W_{_HAN_CLASS}]+")
_CHAR = re.compile(r"[^\W_]")


def plain(text: str) -> str:
    return _DROP.sub("", unicodedata.normalize("NFKC", _MARKUP.sub(" ", text)).casefold())


def placed(text: str) -> tuple[str, list[int]]:
    """`plain` of a text with the place in the text that each character comes from. A character is normalised with the
    combining marks behind it, tags and references become one blank."""
    out: list[str] = []
    at: list[int] = []

    def add(a: int, b: int) -> None:
        while a < b:
            e = a + 1
            while e < b and unicodedata.combining(text[e]):
                e += 1
            for c in unicodedata.normalize("NFKC", text[a:e]).casefold():
                out.append(c)
                at.append(a)
            a = e

    last = 0
    for m in _MARKUP.finditer(text):
        add(last, m.start())
        out.append(" ")
        at.append(m.start())
        last = m.end()
    add(last, len(text))
    low, keep, last = "".join(out), [], 0
    for m in _DROP.finditer(low):
        keep.append((last, m.start()))
        last = m.end()
    keep.append((last, len(low)))
    return "".join(low[a:b] for a, b in keep), [p for a, b in keep for p in at[a:b]]


def by_chars(text: str) -> bool:
    """Chinese passages are compared by characters, others by words."""
    return len(_HAN.findall(text)) > len(_WORD.findall(_HAN.sub(" ", text)))


class Items:
    """The automata of items (id, passage), and the walk of a text through them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.kinds = []
        low = [(i, plain(t or "")) for i, t in items]
        for chars, least in ((False, LEAST_WORDS), (True, LEAST_CHARS)):
            own = [(i, (_CHAR if chars else _WORD).findall(t)) for i, t in low if by_chars(t) == chars]
            own = [(i, t) for i, t in own if t]
            sam = SuffixAutomaton(t for _, t in own)
            sam.occurrences(0)
            self.kinds.append((chars, least, [i for i, _ in own], [len(t) for _, t in own], sam))

    def _walk(self, low: str, tokens_of_text: bool = False) -> Iterator[tuple[bool, int, int, int, set[int]]]:
        """(by characters, item, covered tokens, size, tokens of the text that cover it) of each item of which the text
        has a stretch of the least length. A stretch is marked whole where it reaches the least length, and token by
        token as it goes on."""
        for chars, least, ids, sizes, sam in self.kinds:
            if not ids or (chars and not _HAN.search(low)):
                continue
            found: dict[int, tuple[bytearray, set[int]]] = {}
            for end, k, e, n in sam.shared((_CHAR if chars else _WORD).findall(low), least):
                if k not in found:
                    found[k] = (bytearray(sizes[k]), set())
                cover, own = found[k]
                if n == least:
                    cover[e - n + 1 : e + 1] = b"\x01" * n
                    if tokens_of_text:
                        own.update(range(end - n + 1, end + 1))
                else:
                    cover[e] = 1
                    if tokens_of_text:
                        own.add(end)
            for k, (cover, own) in found.items():
                yield chars, ids[k], sum(cover), sizes[k], own

    def carried(self, text: str) -> list[tuple[int, int, int]]:
        """(item, covered tokens, the item's tokens) for each item of which a text has any stretch."""
        return [(i, n, size) for _, i, n, size, _ in self._walk(plain(text))]

    def spans(self, text: str, share: float = LEAST_SHARE) -> list[tuple[int, int]]:
        """Where in a text the stretches of items stand of which it has at least `share`; separate, in order."""
        low, at = placed(text)
        gone = set()
        for chars in (False, True):
            own = set().union(*(tokens for c, _, n, size, tokens in self._walk(low, True) if c == chars and n >= share * size))
            if own:
                gone |= {p for k, m in enumerate((_CHAR if chars else _WORD).finditer(low)) if k in own for p in range(m.start(), m.end())}
                ends = [(m.start(), m.end()) for m in (_CHAR if chars else _WORD).finditer(low)]
                for k in own:  # what stands between two tokens of a stretch goes with them
                    if k + 1 in own:
                        gone.update(range(ends[k][1], ends[k + 1][0]))
        out: list[tuple[int, int]] = []
        for p in sorted(gone):
            a, b = at[p], at[p + 1] if p + 1 < len(at) else len(text)
            if p + 1 not in gone:
                b = min(b, a + 1 + sum(1 for _ in _marks(text, a + 1)))
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def _marks(text: str, at: int) -> Iterator[str]:
    while at < len(text) and unicodedata.combining(text[at]):
        yield text[at]
        at += 1


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans; all else stays as it is, letter case and punctuation included."""
    out, last = [], 0
    for a, b in sorted(spans):
        out.append(text[last : max(a, last)])
        last = max(last, b)
    return "".join(out) + text[last:]


def shards(items: DataFrame, most: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most `most` (SHARD_TOKENS) tokens, or one longer item; read as a stream."""
    held, size = [], 0
    for r in items.where("passage is not null").select("item_id", "passage").toLocalIterator():
        n = len(_CHAR.findall(r["passage"]))
        if held and size + n > (most or SHARD_TOKENS):
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["passage"]))
        size += n
    if held:
        yield held


def _each_shard(documents: DataFrame, items: DataFrame, work: Callable[[Items, pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, int]:
    """The union of `work(automata, batch)` over the shards, and how many there are. Automata are built once here and broadcast; a worker
    unpacks them once, whatever its tasks."""
    d = documents.where("text is not null").select("doc_id", "text")
    sc = documents.sparkSession.sparkContext
    parts = []
    for held in shards(items):
        sent = sc.broadcast(Items(held))

        def run(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield work(sent.value, pdf)

        parts.append(d.mapInPandas(run, schema))
    return (reduce(DataFrame.union, parts) if parts else documents.sparkSession.createDataFrame([], schema)), len(parts)


def leaked(documents: DataFrame, items: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, covered, size): documents whose text contains stretches of a passage, each at least 8 words (12
    characters of Chinese) long, that together make up at least `share` of it.

    Repeated documents are all reported. Null and empty texts carry nothing; empty passages never leak; no items or no
    documents give no rows.
    """
    def work(automata: Items, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, i, n, size) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, n, size in automata.carried(t) if n >= share * size]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "size"])

    return _each_shard(documents, items, work, "doc_id bigint, item_id bigint, covered bigint, size bigint")[0]


def cleaned(documents: DataFrame, items: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, removed, text): every document that carries items, without their stretches, `removed` characters
    shorter and otherwise unchanged. Where there are several shards, their spans are united by document and text before
    the cut: repeated ids with other texts stay apart, rows that repeat both then come out once."""
    def work(automata: Items, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [(d, automata.spans(t, share), t) for d, t in zip(pdf["doc_id"], pdf["text"])]
        rows = [(d, [{"a": a, "b": b} for a, b in sp], t) for d, sp, t in got if sp]
        return pd.DataFrame(rows, columns=["doc_id", "spans", "text"])

    found, n = _each_shard(documents, items, work, "doc_id bigint, spans array<struct<a:int,b:int>>, text string")
    one = found if n == 1 else found.groupBy("doc_id", "text").agg(F.flatten(F.collect_list("spans")).alias("spans")).select("doc_id", "spans", "text")

    def cut_(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rest = [without(t, sorted((s["a"], s["b"]) for s in sp)) for t, sp in zip(pdf["text"], pdf["spans"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "removed": [len(t) - len(r) for t, r in zip(pdf["text"], rest)], "text": rest})

    return one.mapInPandas(cut_, "doc_id bigint, removed bigint, text string")


def item_report(found: DataFrame) -> DataFrame:
    """(item_id, documents, whole): leaked items with the documents that carry them, and those that carry them whole."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("covered") == F.col("size")).cast("bigint")).alias("whole"))
