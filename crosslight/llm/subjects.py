"""Problem 8: the subjects of each document, by n-gram language models of subjects and background."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut, small

ROUNDS = 4
BACKGROUND, FALL_BACK = 200.0, 3.0  # how many counts the lower order is worth: of single tokens, of bigrams and trigrams
LEAST_SAVING = 0.35  # part of the usual saving, in the first round
SAME = 0.85  # a line recurring in documents of which fewer share a label is about no subject
FAR = 3.0  # bits
LEAST_TOKENS = 4
LEAST_HELD = 40  # held-out documents of a subject from which it gets a threshold of its own
CHUNK = 40_000  # tokens scored at once
SLOTS = 1 << 20  # hashed n-grams; bounds the models that every task gets
BLOCKS = 16  # ranges of slots, in which the tasks' counts are added up
UNIT = 720_720  # counts are added as whole numbers, so their order is of no matter; shares of up to 16 labels are exact
PIECE = 500_000  # tokens counted at once

_BREAK = re.compile(r"<br\s*/?>|</?p>", re.I)
_NAME = re.compile(r"(?<=[a-z,] )[A-Z][a-z]+")
_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?|[0-9]+|[㐀-鿿]")


def paragraphs(text: str) -> list[str]:
    """The lines of a text, markup breaks counting as line ends, without blank ones and headings."""
    lines = _BREAK.sub("\n", unicodedata.normalize("NFKC", text)).replace("\r", "\n").split("\n")
    return [x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]


def words(paragraph: str) -> list[str]:
    """Lower-case words, numbers and single Chinese characters; capitalised words within a sentence (names of places)
    are all alike."""
    return _TOKEN.findall(_NAME.sub("Xx", paragraph).lower())


def tokens(paragraph: str) -> list[str]:
    """The words, numbers being all alike."""
    return ["0" if t[0].isdigit() else t for t in words(paragraph)]


class Hashes(dict[str, int]):
    """A hash of each word, the same for all numbers."""

    def __missing__(self, t: str) -> int:
        h = self[t] = zlib.crc32(b"0" if t[0].isdigit() else t.encode())
        return h

    def of(self, words_: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words_), "<u4")


def slots(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigram, bigram and single token that end at each token of paragraphs, given as hashes of all their
    tokens and how many each has, and of the two histories, one row each; and a hash that tells the trigrams apart.
    Paragraphs must not be empty."""
    at = np.arange(len(flat)) + 2 * (np.repeat(np.arange(len(size)), size) + 1)
    pad = np.full(len(flat) + 2 * len(size), 7, np.uint64)
    pad[at] = flat
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    one, two, three = pad[at] * k1, (pad[at - 1] + np.uint64(11)) * k2, (pad[at - 2] + np.uint64(13)) * k3
    rows = np.stack([three + two + one, two + one, one, (three + two) * k1 + np.uint64(3), two * k1 + np.uint64(5)])
    return ((rows ^ (rows >> np.uint64(29))) * k1 >> np.uint64(40)).astype(np.int64) & (SLOTS - 1), rows[0]


class Models:
    """Interpolated n-gram models over hashed slots: one of each subject, one of paragraphs without a subject, and one
    of the background (all paragraphs). Every order falls back on the next lower one, single tokens on the background,
    so what a subject has never seen (names) neither helps nor harms it."""

    def __init__(self, subjects: list[str], counts: np.ndarray, thresholds: list[float]) -> None:
        self.subjects, self.counts, self.thresholds = subjects, counts, thresholds
        self.total = counts.sum(axis=0, dtype=np.float64) / 5

    def best(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each paragraph of `slots`, the model that saves most bits a token against the background (the number of
        subjects for none), and how many: the difference of the cross-entropies, in which one token counts at most FAR
        bits against a model, so that a lone foreign sentence does not outweigh the others."""
        ends = np.cumsum(size)
        start = ends - size
        which, saved = np.zeros(len(size), np.int64), np.zeros(len(size))
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, start[i] + CHUNK)))
            g, trigram = slots(flat[start[i] : ends[j - 1]], size[i:j])
            _, one, again = np.unique(trigram, return_index=True, return_inverse=True)
            c = self.counts[g[:, one]]  # 5 x different trigrams x models
            base = (c[2, :, -1:] + 0.1) / (self.total[-1] + 0.1 * SLOTS)
            p = (c[2] + BACKGROUND * base) / (self.total + BACKGROUND)
            p = (c[1] + FALL_BACK * p) / (c[4] + FALL_BACK)
            p = (c[0] + FALL_BACK * p) / (np.maximum(c[3], c[0]) + FALL_BACK)
            bits = np.log2(np.minimum(p, 1.0))
            gain = np.add.reduceat(np.maximum(bits[:, :-1] - bits[:, -1:], -FAR)[again], start[i:j] - start[i], axis=0) / size[i:j, None]
            which[i:j] = gain.argmax(axis=1)
            saved[i:j] = gain.max(axis=1)
            i = j
        return which, saved

    def subjects_of(self, texts: list[list[str]]) -> list[str | None]:
        """The subject of each tokenised paragraph, or none when no subject's model saves enough."""
        long = [k for k, ts in enumerate(texts) if len(ts) >= LEAST_TOKENS]
        out: list[str | None] = [None] * len(texts)
        if long:
            flat = Hashes().of(chain.from_iterable(texts[k] for k in long))
            for k, s, x in zip(long, *self.best(flat, np.array([len(texts[k]) for k in long]))):
                if s < len(self.subjects) and x >= self.thresholds[s]:
                    out[k] = self.subjects[s]
        return out


def _lines(documents: Iterable[tuple[int, str, Iterable[int]]]) -> pd.DataFrame:
    """The paragraphs of (id, text, labels): `fifth` tells the documents to hold out, `key` equal paragraphs, `first`
    the first of a document with that key; tokens are four bytes each."""
    rows, known = [], Hashes()
    for i, text, ls in documents:
        fifth, seen = zlib.crc32(str(i).encode()) % 5 == 0, set()
        for ws in map(words, paragraphs(text)):
            if len(ws) >= LEAST_TOKENS:
                toks = known.of(ws).tobytes()
                key = hashlib.blake2b(toks, digest_size=16).digest()
                rows.append((i, fifth, list(ls), key, key not in seen, toks))
                seen.add(key)
    return pd.DataFrame(rows, columns=["doc_id", "fifth", "ls", "key", "first", "toks"]).astype({"doc_id": "int64", "fifth": bool, "first": bool})


def _flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows["toks"]), "<u4"), rows["toks"].map(len).to_numpy(np.int64) // 4


def _units(rows: pd.DataFrame, none: int) -> np.ndarray:
    """What each paragraph counts for every subject, for no subject and for the background before any model is known:
    a note for no subject, any other is shared among its document's labels."""
    out = np.zeros((len(rows), none + 2), np.int64)
    for i, (ls, note) in enumerate(zip(rows["ls"], rows["note"])):
        out[i, none if note else ls] = UNIT if note else round(UNIT / len(ls))
    out[:, -1] = UNIT
    return out


def _given(rows: pd.DataFrame, none: int) -> np.ndarray:
    return UNIT * (rows["which"].to_numpy()[:, None] == np.arange(none))


def _add(counts: np.ndarray, rows: pd.DataFrame, units: Callable[[pd.DataFrame, int], np.ndarray], none: int) -> None:
    """Adds the slots of the paragraphs to the counts (models x slots)."""
    flat, size = _flat(rows)
    ends, all_units = np.cumsum(size), units(rows, none)
    piece = (ends - size) // PIECE
    for k in np.unique(piece):
        i, j = np.searchsorted(piece, [k, k + 1])
        u, n = all_units[i:j], size[i:j]
        g, _ = slots(flat[ends[i] - n[0] : ends[j - 1]], n)
        for s in np.flatnonzero(u.any(axis=0)):
            at = np.repeat(u[:, s] > 0, n)
            counts[s] += np.bincount(g[:, at].ravel(), np.tile(np.repeat(u[:, s], n)[at], 5), SLOTS).astype(np.int64)


def _score(model: Models, rows: pd.DataFrame) -> pd.DataFrame:
    """The rows with the model that saves most and what it saves, in thousandths of a bit, so that medians and best
    paragraphs are found among few values."""
    which, saved = model.best(*_flat(rows))
    return rows.assign(which=which.astype(np.int32), saved=saved.round(3))


def _fits(rows: pd.DataFrame) -> np.ndarray:
    return np.fromiter((w in ls for w, ls in zip(rows["which"], rows["ls"])), bool, len(rows))


class _Here:
    """Labelled documents in memory, for `_learn`."""

    def __init__(self, labelled: list[tuple[str, list[str]]], subjects: list[str]) -> None:
        index, self.none = {s: i for i, s in enumerate(subjects)}, len(subjects)
        known = ((i, t, sorted({index[x] for x in ls if x in index})) for i, (t, ls) in enumerate(labelled))
        rows = _lines(x for x in known if x[2])
        of: dict[bytes, list[list[int]]] = defaultdict(list)
        for r in rows[rows["first"]].itertuples():
            of[r.key].append(r.ls)
        notes = {k for k, x in of.items() if len(x) >= 3 and max(sum(s in ls for ls in x) for s in range(self.none)) < SAME * len(x)}
        rows["note"] = rows["key"].isin(notes)
        held = rows["fifth"] & (rows["doc_id"].nunique() >= 50)
        self.rows, self.held = rows[~held], rows[held] if held.any() else rows

    def shared(self) -> np.ndarray:
        counts = np.zeros((self.none + 2, SLOTS), np.int64)
        _add(counts, self.rows, _units, self.none)
        return counts

    def scored(self, model: Models) -> pd.DataFrame:
        rows = _score(model, self.rows)
        return rows[_fits(rows)]

    def usual(self, scored: pd.DataFrame) -> float:
        return float(scored["saved"].median()) if len(scored) else 0.0

    def given(self, scored: pd.DataFrame, least: float) -> np.ndarray:
        counts = np.zeros((self.none, SLOTS), np.int64)
        _add(counts, scored[~scored["note"] & (scored["saved"] >= least)], _given, self.none)
        return counts

    def tried(self, model: Models) -> tuple[list[tuple[int, bool, float, int]], list[int]]:
        rows = _score(model, self.held)
        best = rows[rows["which"] < self.none].sort_values("saved").drop_duplicates(["doc_id", "which"], keep="last")
        labels = rows.drop_duplicates("doc_id")["ls"]
        return [(w, r, x, 1) for w, r, x in zip(best["which"], _fits(best), best["saved"])], [sum(s in ls for ls in labels) for s in range(self.none)]


class _Spread:
    """Labelled documents (doc_id, text, ls) of any number as a DataFrame, for `_learn`. What comes to the driver is
    bounded by the slots of the models, not by the documents."""

    def __init__(self, labelled: DataFrame, none: int) -> None:
        self.none = none

        def lines(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield _lines(zip(pdf["doc_id"], pdf["text"], pdf["ls"]))

        rows = cut(labelled.select("doc_id", "text", "ls").mapInPandas(lines, "doc_id bigint, fifth boolean, ls array<int>, key binary, first boolean, toks binary"))
        most = F.array_max(F.array(*[F.count_if(F.array_contains("ls", s)) for s in range(none)]))
        notes = rows.where("first").groupBy("key").agg(F.count(F.lit(1)).alias("n"), most.alias("most")).where((F.col("n") >= 3) & (F.col("most") < SAME * F.col("n")))
        notes = small(cut(notes.select("key", F.lit(True).alias("note"))))
        rows = cut(rows.join(notes, "key", "left").select("doc_id", "fifth", "ls", F.coalesce("note", F.lit(False)).alias("note"), "toks"))
        most_tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // 50_000)  # each sends counts
        rows = rows.coalesce(most_tasks)
        held = rows.where("fifth") if rows.select("doc_id").distinct().limit(50).count() >= 50 else rows.limit(0)
        any_held = not held.isEmpty()
        self.rows, self.held = rows.where("not fifth") if any_held else rows, held if any_held else rows

    def _sum(self, rows: DataFrame, units: Callable[[pd.DataFrame, int], np.ndarray], columns: int) -> np.ndarray:
        """The counts of all rows: every task adds its own up, then those of each block of slots are added."""
        none, step, schema = self.none, SLOTS // BLOCKS, "block int, at binary, units binary"

        def sent(block: int, counts: np.ndarray) -> pd.DataFrame:
            at = np.flatnonzero(counts.any(axis=0))
            return pd.DataFrame({"block": [block], "at": [at.astype("<i4").tobytes()], "units": [counts[:, at].tobytes()]})

        def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros((columns, SLOTS), np.int64)
            for pdf in it:
                _add(counts, pdf, units, none)
            for b in range(BLOCKS):
                if (c := counts[:, b * step : (b + 1) * step]).any():
                    yield sent(b, c)

        def total(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((columns, step), np.int64))
            for pdf in it:
                for b, at, u in pdf.itertuples(index=False):
                    counts[b][:, np.frombuffer(at, "<i4")] += np.frombuffer(u, np.int64).reshape(columns, -1)
            for b, c in counts.items():
                yield sent(b, c)

        out = np.zeros((columns, SLOTS), np.int64)
        for r in rows.mapInPandas(part, schema).repartition("block").mapInPandas(total, schema).collect():
            out[:, r["block"] * step + np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["units"], np.int64).reshape(columns, -1)
        return out

    def _scored(self, rows: DataFrame, model: Models, columns: list[str], fitting: bool) -> DataFrame:
        sent = _send(model, rows)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = _received(sent.value)
            for pdf in it:
                got = _score(m, pdf)
                yield (got[_fits(got)] if fitting else got)[[*columns, "which", "saved"]]

        kinds = dict(rows.dtypes)
        out = cut(rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", which int, saved double"))
        sent.unpersist()
        return out

    def shared(self) -> np.ndarray:
        return self._sum(self.rows.select("ls", "note", "toks"), _units, self.none + 2)

    def scored(self, model: Models) -> DataFrame:
        return self._scored(self.rows.select("ls", "note", "toks"), model, ["note", "toks"], True)

    def usual(self, scored: DataFrame) -> float:
        return scored.agg(F.percentile("saved", F.lit(0.5)).alias("x")).first()["x"] or 0.0

    def given(self, scored: DataFrame, least: float) -> np.ndarray:
        return self._sum(scored.where(~F.col("note") & (F.col("saved") >= least)).select("toks", "which"), _given, self.none)

    def tried(self, model: Models) -> tuple[list[tuple[int, bool, float, int]], list[int]]:
        rows = self._scored(self.held.select("doc_id", "ls", "toks"), model, ["doc_id", "ls"], False)
        best = rows.where(F.col("which") < self.none).groupBy("doc_id", "which").agg(F.max("saved").alias("x"), F.first("ls").alias("ls"))
        best = best.groupBy("which", F.expr("array_contains(ls, which)").alias("right"), F.least("x", F.lit(FAR)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        labels = rows.groupBy("doc_id").agg(F.first("ls").alias("ls")).select(F.explode("ls").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        true = {r["s"]: r["n"] for r in labels.collect()}
        return [tuple(r) for r in best.collect()], [true.get(s, 0) for s in range(self.none)]


def _counts(units: np.ndarray) -> np.ndarray:
    """Slots x models, as `Models` has them."""
    out = np.zeros(units.shape[::-1], np.float32)
    for s, u in enumerate(units):
        out[:, s] = u / UNIT
    return out


def _learn(data: _Here | _Spread, subjects: list[str]) -> Models:
    """Models from labelled documents, whose labels may be wrong or incomplete.

    Lines that recur alike in documents of different labels (filing notes) train the model of no subject. Any other
    paragraph starts shared among its document's labels; each round fits the models and gives it to the subject that
    saves most over the background if that is one of the labels, and leaves it out if it is another or if next to
    nothing is saved. A fifth of the documents is held out. The acceptance of each subject is calibrated there: its
    threshold has the best F1 of the documents it is given to and lies in the middle of the best ones; a subject of fewer
    than LEAST_HELD held-out documents takes that of all subjects together.
    """
    none = len(subjects)
    units = data.shared()
    model = Models(subjects, _counts(units), [float("inf")] * none)
    if not units.any():
        return model
    for r in range(ROUNDS - 1):
        scored = data.scored(model)
        usual = data.usual(scored)
        units[:none] = data.given(scored, LEAST_SAVING * usual if r == 0 else usual - 0.8 * FAR)
        model = Models(subjects, _counts(units), [0.0] * none)
    grid = np.arange(-FAR, FAR, 0.05)
    hit, said = np.zeros((none, len(grid))), np.zeros((none, len(grid)))
    best, labels = data.tried(model)  # the documents' best paragraphs of each subject, and how many documents have it
    true = np.array(labels, float)[:, None]
    for k, right, x, n in best:
        said[k] += n * (x >= grid)
        hit[k] += n * (x >= grid) * right

    def middle(h: np.ndarray, s: np.ndarray, t: np.ndarray) -> float:
        f = 2 * h / np.maximum(1, s + t)
        near = grid[f >= f.max() - 0.003]
        return float((near[0] + near[-1]) / 2)

    usual = middle(hit.sum(0), said.sum(0), true.sum(0))
    model.thresholds = [middle(hit[k], said[k], true[k]) if true[k, 0] >= LEAST_HELD else usual for k in range(none)]
    return model


def fit(labelled: list[tuple[str, list[str]]], subjects: list[str]) -> Models:
    """Models from (text, labels) of documents in memory."""
    return _learn(_Here(labelled, subjects), subjects)


def fitted(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Models:
    """Models fitted on all labelled documents. Several annotators' labels of a document are united."""
    subjects = sorted(r["subject"] for r in areas.select("subject").collect())
    if not subjects:
        return fit([], subjects)
    place = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject"))
    by_doc = labels.select("doc_id", (place - 1).cast("int").alias("s")).where("s >= 0").groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("ls"))
    return _learn(_Spread(documents.where("text is not null").join(small(by_doc), "doc_id"), len(subjects)), subjects)


def _send(models: Models, df: DataFrame):  # noqa: ANN202
    live = np.flatnonzero(models.counts[:, -1])  # only slots that occur are sent
    return df.sparkSession.sparkContext.broadcast((models.subjects, live, models.counts[live], models.thresholds))


def _received(sent: tuple) -> Models:
    subjects, at, part, thresholds = sent
    counts = np.zeros((SLOTS, part.shape[1]), np.float32)
    counts[at] = part
    return Models(subjects, counts, thresholds)


def document_subjects(documents: DataFrame, models: Models) -> DataFrame:
    """(doc_id, subject, paragraphs): one row per document and subject of at least one whole paragraph. Null, empty and
    unrecognised texts give no row; the text is read whole."""
    sent = _send(models, documents)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _received(sent.value)
        for pdf in it:
            texts = [(d, words(p)) for d, t in zip(pdf["doc_id"], pdf["text"]) for p in paragraphs(t)]
            got = pd.DataFrame({"doc_id": [d for d, _ in texts], "subject": m.subjects_of([ts for _, ts in texts])})
            yield got.dropna().groupby(["doc_id", "subject"]).size().reset_index(name="paragraphs").astype({"doc_id": "int64"})

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, subject string, paragraphs int")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how much of the corpus is about each subject; documents without one are `(none)`."""
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    c = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    none = documents.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("documents")).select(F.lit("(none)").alias("subject"), "documents")
    return c.unionByName(none).crossJoin(F.broadcast(n)).select("subject", "documents", F.coalesce(F.try_divide("documents", "n"), F.lit(0.0)).alias("share"))
