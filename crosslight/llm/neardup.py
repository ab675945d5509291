"""Problem 3: groups of near-duplicate records with small edits.

Two records are linked when their remarks share at least half of all distinct character 5-grams of either and at
least half of the rows of the shorter phase list occur in the other. Candidates come from token combinations, the tokens
being phase rows (min_green, max_green, capacity, near saturation): of two lists of three rows or more, a link shares two
rows, of shorter ones at least one. A row that few records have is indexed alone; rows that many have are indexed in
combinations of two, and alone only for the lists too short to have a second common one. No prefix shortens a list, as a
partner may be so short that any one row links. All records of an index entry are compared with one another, by bits of
their 5-grams that can rule a pair out but never a link. What is left is verified exactly; where a record has many such
partners, first some of them, and then all that are not of one group yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, cut, small

#: How the wordings of the task begin, and the labels of the remark.
TASK_LINES = r"(?m)^(任务：|要求：|请先说明理由|[0-9]\) |你负责本路口的配时|Task: |Rules: |Explain first|You time this junction).*$"
REMARK_LABEL = r"(?m)^(现场备注|巡查记录|备注|Patrol notes|Site remark|Remark)\s*[：:]"

GRAM = 5
BITS = 2048
ALL_PAIRS = 32
CELL_ROWS = 8192
RARE, MOST_FREQUENT = 256, 500_000  # a row that more records have is a frequent token; how many of these a task is sent
WINDOW, BLOCK = 21, 168  # how far the saturations of like rows may be apart, and those of a cell, in thousandths


def remark(prompt: Column) -> Column:
    """What a prompt says besides its input and task; a prompt without the input's closing tag is taken whole."""
    tail = F.substring_index(prompt, "【/cycle_predict_input_json】", -1)
    return F.regexp_replace(F.regexp_replace(tail, TASK_LINES, ""), REMARK_LABEL, "")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def content(samples: DataFrame) -> DataFrame:
    """(rec_id, cid, norm, rows): cid is a hash of the normalised remark and phase rows, so repeats share it.
    A row is (min_green, max_green, capacity, saturation), null for a missing saturation. Null prompts and lists count
    as empty; an empty remark or list links with nothing but its exact repeats."""
    norm = letters(remark(F.coalesce("prompt", F.lit(""))))
    waits = F.filter(F.coalesce("prediction.phase_waits", F.array().cast("array<struct<phase_id:int,pred_saturation:double,min_green:int,max_green:int,capacity:int>>")), lambda w: w.isNotNull())
    rows = F.array_sort(F.transform(waits, lambda w: F.struct(w["min_green"].alias("a"), w["max_green"].alias("b"), w["capacity"].alias("c"), F.when(w["pred_saturation"] >= 0, F.nanvl(w["pred_saturation"], F.lit(None).cast("double"))).alias("s"))))
    return samples.select("rec_id", norm.alias("norm"), rows.alias("rows")).withColumn("cid", F.xxhash64("norm", "rows"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sketches(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 5-grams, bits) of each text: each distinct 5-gram flips one of BITS bits. Two texts' bits differ in no
    more places than 5-grams are in one text only, so what `_may_link` rejects is no link."""
    count, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), BITS // 8), np.uint8)
    for at in range(0, len(texts), 1000):
        part = texts.iloc[at : at + 1000]
        size = part.str.len().to_numpy(dtype=np.int64)
        codes = np.frombuffer("".join(part.tolist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if len(codes) < GRAM:
            continue
        h = np.zeros(len(codes) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(1_000_003) + codes[k : len(codes) - GRAM + 1 + k]
        doc = np.repeat(np.arange(len(size)), size)[: len(h)]
        keep = np.repeat(np.cumsum(size), size)[: len(h)] - np.arange(len(h)) >= GRAM
        one = np.sort((doc[keep].astype(np.uint64) << np.uint64(54)) | (_mix(h[keep]) >> np.uint64(10)))
        one = one[np.append(True, one[1:] != one[:-1])[: len(one)]]
        doc = (one >> np.uint64(54)).astype(np.int64)
        count[at : at + 1000] = np.bincount(doc, minlength=len(size))
        flips = np.bincount(doc * BITS + (one & np.uint64(BITS - 1)).astype(np.int64), minlength=len(size) * BITS) & 1
        bits[at : at + 1000] = np.packbits(flips.astype(bool).reshape(len(size), BITS), axis=1)
    return count, bits


def _may_link(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the remarks of records i and j may share half of all 5-grams of either: the smaller then has half of the
    larger's, and at most a third of both counts together lies in one only (2 more, should hashes collide)."""
    x, y = n[i], n[j]
    ok = np.flatnonzero(2 * np.minimum(x, y) + 2 >= np.maximum(x, y))
    ok = ok[3 * np.bitwise_count(bits[i[ok]] ^ bits[j[ok]]).sum(1, dtype=np.int64) <= x[ok] + y[ok] + 6]
    got = np.zeros(len(i), bool)
    got[ok] = True
    return got


def row_cells(texts: DataFrame) -> DataFrame:
    """(cell, s, home, salt, crossed, needs_short, short, cid, n, bits): the index entries of each record.

    The token of a phase row is its min_green, max_green, capacity and BLOCK of saturations; a row in the block's first
    WINDOW also has the token of the block before, where it is not at home. Each record is entered under each of its
    tokens. Under a token of more than RARE records, pairs count only if one of the two has a list of at most two rows
    (`needs_short`); the longer lists are also entered under each combination of two such tokens of different rows. A
    token of more than CELL_ROWS records is dealt into parts, and each two parts meet in a cell of their own, crossed.
    Records without 5-grams have no entry, as they link with nothing but repeats."""
    level = lambda s: F.when(s.isNull(), 0).otherwise(100 + F.floor(F.least(s, F.lit(65.0)) * 1000)).cast("int")
    token = lambda r, i, back: F.struct(F.xxhash64(r["a"], r["b"], r["c"], F.floor(level(r["s"]) / BLOCK) - back).alias("cell"), level(r["s"]).alias("s"), F.lit(back == 0).alias("home"), i.alias("row"))
    tokens = F.flatten(F.transform("rows", lambda r, i: F.when(level(r["s"]) % BLOCK <= WINDOW, F.array(token(r, i, 0), token(r, i, 1))).otherwise(F.array(token(r, i, 0)))))
    listed = texts.select("cid", "norm", (F.size("rows") <= 2).alias("short"), tokens.alias("t")).select("cid", "norm", "short", "t.cell", "t.s", "t.home", "t.row")
    sizes = cut(listed.select(F.explode(F.array_distinct("cell")).alias("cell")).groupBy("cell").count())
    rare = max(RARE, (sizes.agg(F.sum("count")).first()[0] or 0) // MOST_FREQUENT)  # so at most MOST_FREQUENT are above
    often = np.sort(np.array([r["cell"] for r in sizes.where(F.col("count") > rare).select("cell").toLocalIterator()], np.int64))
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def enter(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value
        for pdf in it:
            n, bits = _sketches(pdf["norm"])
            size = pdf["cell"].map(len).to_numpy(np.int64)
            size[n == 0] = 0
            if not size.any():
                continue
            rec = np.repeat(np.arange(len(pdf)), size)
            flat = {k: np.concatenate([x for x, m in zip(pdf[k], size) if m]) for k in ("cell", "s", "home", "row")}
            short = pdf["short"].to_numpy(bool)
            frequent = often[np.minimum(np.searchsorted(often, flat["cell"]), len(often) - 1)] == flat["cell"] if len(often) else np.zeros(len(rec), bool)
            twos, of = [], []
            at = np.flatnonzero(frequent & ~short[rec])
            for own in np.split(at, np.flatnonzero(np.diff(rec[at])) + 1):
                c, r = flat["cell"][own], flat["row"][own]
                a, b = np.nonzero((r[:, None] != r[None, :]) & ((c[:, None] < c[None, :]) | ((c[:, None] == c[None, :]) & (r[:, None] < r[None, :]))))
                if len(a):
                    pair = np.unique(_mix(_mix(c[a].view(np.uint64)) + c[b].view(np.uint64)))
                    twos.append(pair.view(np.int64))
                    of.append(np.full(len(pair), rec[own[0]]))
            k = sum(map(len, of))
            rec = np.concatenate([rec, *of])
            cid, keep = pdf["cid"].to_numpy(), [x.tobytes() for x in bits]
            yield pd.DataFrame({"cell": np.concatenate([flat["cell"], *twos]), "s": np.append(flat["s"], np.zeros(k, np.int64)), "home": np.append(flat["home"].astype(bool), np.ones(k, bool)), "needs_short": np.append(frequent, np.zeros(k, bool)), "short": short[rec], "cid": cid[rec], "n": n[rec], "bits": [keep[i] for i in rec]})

    entries = listed.mapInPandas(enter, "cell bigint, s int, home boolean, needs_short boolean, short boolean, cid bigint, n int, bits binary")
    full = sizes.where(F.col("count") > CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts"))
    parts = entries.join(small(full), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = parts.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("salt", "other"), F.greatest("salt", "other")))
    return met.select(own.alias("cell"), "s", "home", "salt", (F.col("salt") != F.col("other")).alias("crossed"), "needs_short", "short", "cid", "n", "bits")


def cell_pairs(cells: DataFrame, labelled: bool = False) -> DataFrame:
    """(u, v, over): pairs u < v of one cell that may link, all of them compared. The first ALL_PAIRS followers of a
    record are given at once; where there are more, `over` names the cell (u and v null). With `labelled`, all pairs
    of different labels are given, however many."""
    def pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cell, s, cid = p["cell"].to_numpy(), p["s"].to_numpy(np.int64), p["cid"].to_numpy()
            new = np.ones(len(p), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (s[1:] != s[:-1]) | (cid[1:] != cid[:-1])
            p, cell, s, cid = p[new], cell[new], s[new], cid[new]
            n, bits = p["n"].to_numpy(np.int64), np.frombuffer(b"".join(p["bits"]), np.uint64).reshape(len(p), BITS // 64)
            salt, crossed, home = p["salt"].to_numpy(), p["crossed"].to_numpy(bool), p["home"].to_numpy(bool)
            needs, short = p["needs_short"].to_numpy(bool), p["short"].to_numpy(bool)
            label = p["label"].to_numpy() if labelled else cid
            given, us, vs, held = np.zeros(len(p), np.int64), [], [], 0
            i = np.flatnonzero(home)
            for d in range(1, len(p)):
                i = i[i + d < len(p)]
                i = i[(cell[i] == cell[i + d]) & (s[i + d] - s[i] <= WINDOW)]
                if not labelled:
                    i = i[given[i] <= ALL_PAIRS]
                if not len(i):
                    break
                at = i[(label[i] != label[i + d]) & ~(crossed[i] & (salt[i] == salt[i + d])) & (~needs[i] | short[i] | short[i + d])]
                at = at[_may_link(n, bits, at, at + d)]
                given[at] += 1
                if not labelled:
                    at = at[given[at] <= ALL_PAIRS]
                us.append(cid[at])
                vs.append(cid[at + d])
                held += len(at)
                if held > 500_000:
                    yield out(us, vs)
                    us, vs, held = [], [], 0
            if us:
                yield out(us, vs)
            if not labelled and (given > ALL_PAIRS).any():
                over = np.unique(cell[given > ALL_PAIRS])
                none = pd.array([None] * len(over), "Int64")
                yield pd.DataFrame({"u": none, "v": none, "over": over})

        def out(us: list[np.ndarray], vs: list[np.ndarray]) -> pd.DataFrame:
            u, v = np.concatenate(us), np.concatenate(vs)
            got = pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()
            return got.assign(over=pd.array([None] * len(got), "Int64"))

        kept: list[pd.DataFrame] = []  # what came of the last cell so far
        for pdf in it:
            if not len(pdf):
                continue
            c = pdf["cell"].to_numpy()
            last = int(np.searchsorted(c, c[-1]))
            if last == 0 and (not kept or kept[0]["cell"].iat[0] == c[0]):
                kept.append(pdf)
                continue
            done = pd.concat([*kept, pdf[:last]])
            kept = [pdf[last:]]
            yield from run(done)
        if kept:
            yield from run(pd.concat(kept))

    return cells.repartition("cell").sortWithinPartitions("cell", "s", "cid").mapInPandas(pairs, "u bigint, v bigint, over bigint")


def shared_rows(a: Column, b: Column) -> Column:
    """Whether half of the shorter list's rows occur in the other, each row of the other used once: rows are first
    counted by who has a partner at all, which settles lists without like rows; then one by one, in order of
    saturation, each with the first free partner, which is best for intervals of one length."""
    fits = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]) & F.coalesce(F.abs(x["s"] - y["s"]) <= 0.02 + 1e-9, x["s"].isNull() & y["s"].isNull())
    least = F.least(F.size(a), F.size(b))
    some = F.size(F.filter(a, lambda x: F.exists(b, lambda y: fits(x, y))))
    free = F.transform(b, lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b"), y["c"].alias("c"), y["s"].alias("s"), F.lit(0).alias("used")))
    start = F.struct(free.alias("free"), F.lit(0).alias("n"))

    def take(acc: Column, x: Column) -> Column:
        open_ = F.transform(acc["free"], lambda y: (y["used"] == 0) & F.coalesce(fits(x, y), F.lit(False)))
        at = F.array_position(open_, True)
        left = F.transform(acc["free"], lambda y, i: F.struct(y["a"].alias("a"), y["b"].alias("b"), y["c"].alias("c"), y["s"].alias("s"), F.when(i + 1 == at, 1).otherwise(y["used"]).alias("used")))
        return F.struct(left.alias("free"), (acc["n"] + (at > 0).cast("int")).alias("n"))

    exact = F.aggregate(a, start, take, lambda acc: acc["n"])
    return (least > 0) & (2 * some >= least) & (2 * exact >= least)


def _grams(t: str) -> set[str]:
    return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}


def similar(a: str, b: str, grams_b: set[str] | None = None) -> bool:
    """Whether two normalised remarks share half of all distinct 5-grams of either."""
    y = _grams(b) if grams_b is None else grams_b
    x = _grams(a)
    both = len(x & y)
    return both > 0 and 2 * both >= len(x) + len(y) - both


def verified_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (u, v) that meet both conditions: first the phase rows, then the whole remarks."""
    one = texts.groupBy("cid").agg(F.first("rows").alias("rows"))
    a, b = (one.select(F.col("cid").alias(k), F.col("rows").alias(f"r{k}")) for k in "uv")
    pairs = cut(pairs.join(a, "u").join(b, "v").where(shared_rows(F.col("ru"), F.col("rv"))).select("u", "v"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    t = texts.join(small(ends), "cid", "left_semi").groupBy("cid").agg(F.first("norm").alias("norm"))
    a, b = (t.select(F.col("cid").alias(k), F.col("norm").alias(f"n{k}")) for k in "uv")

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, grams = None, set()
        for pdf in it:
            ok = []
            for v, x, y in zip(pdf["v"].tolist(), pdf["nu"].tolist(), pdf["nv"].tolist()):
                if v != last:
                    last, grams = v, _grams(y)
                ok.append(similar(x, y, grams))
            yield pdf.loc[np.asarray(ok, bool), ["u", "v"]]

    return pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv").mapInPandas(check, "u bigint, v bigint")


def near_duplicate_groups(samples: DataFrame) -> DataFrame:
    """(rec_id, class_id): one row per record; records of one class are linked over others or repeat each other.
    Classes of one record are their own. Repeated rows are cases; null fields see `content`."""
    texts = content(samples)
    cells = row_cells(texts)
    got = cut(cell_pairs(cells))
    links = cut(verified_links(got.where("over is null").select("u", "v").distinct(), texts))
    roots = connected_components(links).select(F.col("node").alias("cid"), "root")
    over = cut(got.where("over is not null").select(F.col("over").alias("cell")).distinct())
    if over.count():
        rest = cells.join(over, "cell", "left_semi").join(roots, "cid", "left").withColumn("label", F.coalesce("root", "cid"))
        more = verified_links(cell_pairs(rest, labelled=True).select("u", "v").distinct(), texts)
        roots = connected_components(links.union(more)).select(F.col("node").alias("cid"), "root")
    return texts.select("rec_id", "cid").join(roots, "cid", "left").select("rec_id", F.coalesce("root", "cid").alias("class_id"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(rec_id_a, rec_id_b): all pairs of records of one class, smaller id first; single classes leave before the join."""
    g = cut(groups)
    many = g.groupBy("class_id").count().where("count > 1").select("class_id")
    g = g.join(many, "class_id")
    a, b = g.select("class_id", F.col("rec_id").alias("rec_id_a")), g.select("class_id", F.col("rec_id").alias("rec_id_b"))
    return a.join(b, "class_id").where("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b")
