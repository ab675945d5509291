import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslight.llm import leakage, mixing, neardup, pairs, refusals, splits, subjects, targets, truncation
from crosslight.llm.automata import SuffixAutomaton, open_delimiters
from crosslight.llm.common import connected_components, dense_in_groups

SAMPLE = "rec_id bigint, prompt string, prediction struct<as_of:string,phase_waits:array<struct<phase_id:int,pred_saturation:double,min_green:int,max_green:int,capacity:int>>>, state_file string, metadata struct<tl_id:string,sim_time:double,date:string,cycle_count:int>, node string"


def sample(spark, rows):
    """(rec_id, light, state file, as_of, waits, remark); with an extra column named like an inner one."""
    tag = "【cycle_predict_input_json】{}【/cycle_predict_input_json】\n"
    return spark.createDataFrame([(i, None if m is None else tag + "备注：" + m, (a, w), s, (l, None, None, None), "x") for i, l, s, a, w, m in rows], SAMPLE)


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    par = {}
    find = lambda x: x if par.setdefault(x, x) == x else find(par[x])
    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            par[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in par if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_ranks_are_dense(spark):
    d = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.shiftrightunsigned(F.xxhash64("id"), 2).alias("h"), F.col("id").alias("__id"))
    r = dense_in_groups(d, ["g"], "h", "r", 16).groupBy("g").agg(F.count_distinct("r").alias("n"), F.max("r").alias("m"), F.count("*").alias("c")).collect()
    assert all(x["n"] == x["c"] == x["m"] + 1 for x in r)


def test_groups_and_splits(spark):
    f = "outputs/states/a/state_2026-01-01_T00-00-00_%s.xml.gz"
    d = sample(spark, [(1, "kx_1", f % "kx_1", "a", [], ""), (2, " KX-1 ", None, "b", [], ""), (3, "tl:kx_2", "D:\\w\\outputs\\states\\A\\state_2026-01-01_T00-00-00_kx_1.xml", "c", [], ""), (4, None, f % "kx_3", "d", [], ""), (5, "ｋｘ＿３", None, "e", [], None), (6, None, None, None, None, None), (7, "kx_9", None, "a", [], "")])
    got = {r["rec_id"]: r["group_light"] for r in splits.related_groups(d).collect()}
    assert got == {1: "kx_1", 2: "kx_1", 3: "kx_1", 4: "kx_3", 5: "kx_3", 6: "rec:6", 7: "kx_9"}
    a = splits.assign_splits(splits.related_groups(d), bins=4).collect()
    assert len(a) == 7 and all(len({r["split"] for r in a if r["group_light"] == g}) == 1 for g in got.values())
    assert splits.assign_splits(splits.related_groups(d.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_balance(seed):
    rnd = random.Random(seed)
    h = [(w, rnd.randrange(1, 40)) for w in range(1, 40)]
    plan, sums = splits.balance(h, 10)
    back = np.zeros(10)
    for w, n in h:
        base, rest = plan[w]
        assert base * 10 + len(rest) == n and len(set(rest)) == len(rest)
        back += base * w
        for b in rest:
            back[b] += w
    assert np.array_equal(np.sort(back), np.sort(sums)) and np.array_equal(back, sums) and sums.max() - sums.min() <= 3


def test_targets(spark):
    w = lambda *s: [(i, x, 5, 50, 15) for i, x in enumerate(s)]
    d = sample(spark, [(1, "kx_1", None, "a", w(0.1, None), ""), (2, "KX-1", None, "a", w(0.9), ""), (3, "kx_1", None, "b", w(float("nan"), -1.0), ""), (4, "kx_2", None, "a", w(0.3), ""), (5, "kx_2", None, "b", w(0.8), "")])
    t = spark.createDataFrame([("s", "bucket", "low", 0.5, 1, 1.0), ("s", "bucket", "high", 0.5, 2, 1.0), ("l", "tl_id", "kx_2", 1.0, 1, 0.5), ("l", "tl_id", "kx_7", 0.0, 0, 0.5)], "target_set string, dimension string, category string, target_share double, min_rows int, draw_share double")
    r = targets.distinct_records(d)
    assert {(x["light"], x["as_of"], x["bucket"]) for x in r.collect()} == {("kx1", "a", "low"), ("kx1", "b", None), ("kx2", "a", "med"), ("kx2", "b", "high")}
    r, f = targets.filled_reservoirs(d, t)
    q = targets.quotas(f, t)
    assert {(x["category"], x["needed"], x["available"], x["exhausted"]) for x in q.collect()} == {("low", 2, 1, True), ("high", 2, 1, True), ("kx_2", 2, 2, False), ("kx_7", 0, 0, False)}
    s = targets.draw_sample(f, q)
    assert s.count() == 4 and {(x["category"], x["sampled"]) for x in targets.draw_stats(s, q).collect()} == {("low", 1), ("high", 1), ("kx_2", 2), ("kx_7", 0)}
    assert {x["target_set"]: (x["total_source"], x["total_sampled"], x["bucket_counts"]) for x in targets.run_statistics(s, r, q).collect()} == {"s": (4, 2, "high=1,low=1"), "l": (4, 2, "high=1,med=1")}
    assert targets.quotas(targets.filled_reservoirs(d.limit(0), t)[1], t).where("available > 0").count() == 0


def test_reservoirs_merge_and_trim_as_one(spark):
    """The sample is that of the smallest priorities of the whole table, however rows are dealt to tasks, and the scaled
    draw meets the targets' shares."""
    rec = spark.range(6000).select(F.col("id").alias("rec_id"), F.concat(F.lit("kx"), F.col("id") % 7).alias("light"), F.col("id").cast("string").alias("as_of"), F.when(F.col("id") % 10 < 6, "low").when(F.col("id") % 10 < 9, "med").when(F.col("id") % 100 < 95, "high").alias("bucket"))
    t = spark.createDataFrame([("s", "bucket", "low", 0.2, 1, 0.5), ("s", "bucket", "med", 0.5, 1, 0.5), ("s", "bucket", "high", 0.3, 1, 0.5), ("l", "tl_id", "kx_3", 1.0, 5, 0.01)], "target_set string, dimension string, category string, target_share double, min_rows int, draw_share double")
    got = []
    for n in (1, 7):
        f = targets.reservoirs(rec.repartition(n), t, 9000)
        q = targets.quotas(f, t)
        got.append({(r["target_set"], r["category"], r["rec_id"]) for r in targets.draw_sample(f, q).collect()})
    assert got[0] == got[1] and len(got[0]) == 600 + 1500 + 540 + 60
    pri = rec.where("light = 'kx3'").select("rec_id", targets.uniform_hash(F.col("light"), F.col("as_of"), F.lit(17)).alias("p")).orderBy("p").limit(60)
    assert {r["rec_id"] for r in pri.collect()} == {i for s, _, i in got[0] if s == "l"}
    n = {r["category"]: r["count"] for r in targets.draw_sample(f, q, scaled=True).where("target_set = 's'").groupBy("category").count().collect()}
    assert n == {"low": 360, "med": 900, "high": 540}


def similar(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) > 0 and 2 * len(x & y) >= len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]
    base = [[rnd.choice(words) for _ in range(40)] for _ in range(60)]
    rows, waits = [], {}
    for i in range(240):
        b = i % 60
        text = list(base[b])
        for _ in range(rnd.randrange(0, 9)):
            text[rnd.randrange(40)] = rnd.choice(words)
        w = [(k, round(0.1 * k + 0.005 * rnd.randrange(3), 4) if k else None, 5 + b % 7, 50, 15) for k in range(1 + b % 4)]
        if rnd.random() < 0.2:
            w = w[1:] + [(9, 0.5, 6, 60, 30)]
        rows.append((i, "kx_1", None, "a", w, " ".join(text)))
        waits[i] = w
    rows += [(900, "kx_1", None, "a", None, None), (901, "kx_1", None, "a", [], ""), (902, "kx_2", None, "b", [], "")]
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in neardup.group_pairs(neardup.near_duplicate_groups(sample(spark, rows))).collect()}
    par = list(range(240))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    def rows_ok(a, b):
        free, n = list(b), 0
        for _, s, *k in a:
            fit = [y for y in free if list(y[2:]) == k and ((s is None and y[1] is None) or (s is not None and y[1] is not None and abs(s - y[1]) <= 0.02 + 1e-9))]
            if fit:
                free.remove(fit[0])
                n += 1
        return 2 * n >= min(len(a), len(b)) > 0

    norm = {r[0]: "备注".replace("备注", "") + "".join(c for c in r[5].lower() if c.isalnum()) for r in rows[:240]}
    for a, b in itertools.combinations(range(240), 2):
        if similar(norm[a], norm[b]) and rows_ok(waits[a], waits[b]):
            par[find(b)] = find(a)
    want = {(a, b) for a, b in itertools.combinations(range(240), 2) if find(a) == find(b)}
    assert len(want) > 100 and {p for p in got if p[1] < 900} == want
    assert {p for p in got if p[1] >= 900} == {(900, 901), (900, 902), (901, 902)}


def test_truncation(spark):
    full = "<start_working_out>主要矛盾集中在少数相位。相位1饱和度0.2，给12秒。<end_working_out><SOLUTION>[{\"phase_id\":1,\"final\":12}]</SOLUTION>"
    whole = ["", " \n", "（空）", full, full + "\n版本 3", '{"content": "' + full.replace('"', '\\"') + '"}', "抱歉，恕难从命，配时关系到行车安全。", "路口一切正常。", "All quiet at the bay.", full + " " * 300, "<start_working_out> <end_working_out>"]
    cutted = [full[:30], full[:-4], full[:-20], '{"content": "' + full.replace('"', '\\"'), "路口一切正", "All quiet at the b", "路口车流正常，", "一切正常。路�", "很久以后 [more]"]
    r = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(whole + cutted + [None])], "response_id bigint, content string, source string")
    e = spark.createDataFrame([], "result_id bigint, raw_content string, source string")
    j = truncation.judged(truncation.all_texts(r, e))
    assert sorted(x["record_id"] for x in j.where("cut").collect()) == list(range(len(whole), len(whole) + len(cutted)))
    assert sum(x["cut"] for x in truncation.source_rates(j).collect()) == len(cutted)
    assert truncation.judged(truncation.all_texts(r.limit(0), e)).count() == 0


def test_alignment(spark):
    words = " ".join(f"word{i}" for i in range(60))
    assert truncation.ends_early(words[:-20], words) and not truncation.ends_early(words, words[:-20]) and not truncation.ends_early(words, words + "  ")
    assert open_delimiters("a (b [c) d") == [] and open_delimiters("（a") == ["（"]
    rnd = random.Random(8)
    text = [rnd.choice("abcdefghijklmnop") * 2 + rnd.choice("qrstuvwxyz") + str(rnd.randrange(99)) for _ in range(200)]
    for share in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        own = list(text[: int(200 * share)])
        own[7] = "changed"
        own.insert(40, "more")
        own[-1] = "other"
        assert truncation.ends_early(" ".join(own), " ".join(text)) and not truncation.ends_early(" ".join(text), " ".join(own))
    assert not truncation.ends_early(" ".join(text[::-1][:100]), " ".join(text)) and not truncation.ends_early("", words) and not truncation.ends_early(words, "")


def test_copies_cut_anywhere_are_found_by_alignment(spark):
    """Notes cut behind a full stop, so that nothing but their whole copy tells."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 8)))
    sentence = lambda: " ".join(word() for _ in range(6)).capitalize() + "."
    whole = [[sentence() for _ in range(20)] for _ in range(24)]
    cuts = [" ".join(t[: 9 + i % 10]) for i, t in enumerate(whole)]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(whole)] + [(100 + i, t, "s") for i, t in enumerate(cuts)]
    j = truncation.judged(truncation.all_texts(spark.createDataFrame(rows, "response_id bigint, content string, source string"), spark.createDataFrame([], "result_id bigint, raw_content string, source string")))
    assert {(r["record_id"], r["cause"]) for r in j.where("cut").collect()} == {(100 + i, "alignment") for i in range(24)}
    assert {r["cause"]: r["texts"] for r in truncation.cut_causes(j).collect()} == {"alignment": 24}


def test_defects(spark):
    remark = "天刚亮时，云岗巷东进口按钮卡死，队尾距停车线204米，班组希望加长绿灯。供电测试期间，柳湾大道北进口新车道没人走。"
    prompt = '【cycle_predict_input_json】{"prediction": {}}【/cycle_predict_input_json】\n备注：' + remark + "\n任务：给出绿灯。"
    good = "相位1饱和度0.2，压力很小，给12秒。合计12秒，次序未变。"
    wrap = lambda s, p='[{"phase_id":1,"final":12}]': f"<start_working_out>{s}<end_working_out><SOLUTION>{p}</SOLUTION>"
    d = pairs.defect
    assert d(prompt, wrap(good), None, False) is None
    assert d(prompt, wrap(good + "备注中提到“" + remark[:20] + "”，已一并考虑。"), None, False) is None
    assert d(prompt, wrap(remark), None, False) == "copied" == d(prompt, prompt, None, False)
    assert d(prompt, wrap(""), None, False) == d(prompt, None, None, False) == d(prompt, wrap(good, "[]"), None, False) == "empty"
    assert d(prompt, wrap("恕难从命。"), None, False) == d(prompt, wrap("恕难从命。", "[]"), None, False) == "refusal"
    assert d(prompt, wrap("The phases are all hardly loaded and the green adds up to 12 seconds."), None, False) == "language"
    assert d(prompt, wrap(good)[:40], None, True) == "truncated" and d(None, wrap(good), None, False) is None
    assert pairs.language("Veamos cada fase por separado. Para la fase 2 el valor es 0.16.") == "es" and pairs.language("x") is None
    assert refusals.PLACEHOLDER.fullmatch("N/A") and refusals.PLACEHOLDER.fullmatch("\u200b") and not refusals.PLACEHOLDER.fullmatch("no idea")


def test_automaton_against_brute_force():
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ab") for _ in range(30)) for _ in range(4)]
    sam = SuffixAutomaton(seqs)
    text = "".join(rnd.choice("abc") for _ in range(400))
    for end, n, s in sam.matches(text, 3):
        piece = text[end - n + 1 : end + 1]
        want = {(k, i + n - 1) for k, q in enumerate(seqs) for i in range(len(q)) if q.startswith(piece, i)}
        assert want and want <= set(sam.occurrences(s)) and not any(text[end - n + 1 : end + 2] in q and end + 1 < len(text) for q in seqs)


def shared_brute(items, text, least, tok):
    """Covered tokens of each item by stretches of at least `least`, all places tried."""
    out = {}
    t = tok(text)
    for i, p in items:
        q = tok(p)
        cover = [False] * len(q)
        for a in range(len(q)):
            for b in range(len(t)):
                n = 0
                while a + n < len(q) and b + n < len(t) and q[a + n] == t[b + n]:
                    n += 1
                if n >= least:
                    cover[a : a + n] = [True] * n
        if any(cover):
            out[i] = sum(cover)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leakage_against_brute_force(seed):
    """Items that overlap, hold one another and recur within themselves."""
    rnd = random.Random(seed)
    base = [rnd.choice(("ox", "elk", "gnu", "cat")) + str(rnd.randrange(4)) for _ in range(60)]
    items = []
    for i in range(12):
        a = rnd.randrange(40)
        items.append((i, " ".join(base[a : a + rnd.randrange(9, 20)] + [f"own{i}w{k}" for k in range(rnd.randrange(6))])))
    auto = leakage.Items(items)
    for _ in range(25):
        a = rnd.randrange(50)
        text = " ".join(["intro"] * rnd.randrange(3) + base[a : a + rnd.randrange(25)] + rnd.choice(items)[1].split()[rnd.randrange(4) :] + ["end"])
        assert {i: n for i, n, _ in auto.carried(text)} == shared_brute(items, text, 8, lambda s: s.lower().split())


def test_leakage_inside_longer_match():
    b = " ".join(f"w{i}" for i in range(40))
    a = " ".join(f"w{i}" for i in range(10, 22)) + " own1 own2 own3 own4"
    assert {i for i, n, size in leakage.Items([(1, a), (2, b)]).carried(b) if 2 * n >= size} == {1, 2}


def test_leakage(spark):
    en = "The quick brown fox jumps over the lazy dog near the old keeper's house by the river at noon"
    zh = "靠近岭林东路处德比观众丢掉了八十步与队长一道于枫园东路南进口"
    items = spark.createDataFrame([(1, en, "x"), (2, zh, "x"), (3, None, "x"), (4, "", "x")], "item_id bigint, passage string, text string")
    docs = spark.createDataFrame([(1, "Intro. " + en.upper().replace(" FOX", "<b> FOX</b>") + " end", 0), (2, "前言。" + zh[:18] + "，" + "中间" + zh[18:], 0), (3, " ".join(en.split()[:9]), 0), (4, None, 0), (5, "", 0), (6, " ".join(en.split()[:7]), 0), (7, en, 0), (7, en, 0), (8, "王先生 says: " + en + "! And 李女士 agrees.", 0)], "doc_id bigint, text string, item_id int")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, items).collect())
    assert got == [(1, 1), (2, 2), (7, 1), (7, 1), (8, 1)]
    assert leakage.leaked(docs.limit(0), items).count() == 0 == leakage.leaked(docs, items.limit(0)).count()
    left = {r["doc_id"]: r["text"] for r in leakage.cleaned(docs, items).collect()}
    assert left == {1: "Intro.  end", 2: "前言。，中间", 7: "", 8: "王先生 says: ! And 李女士 agrees."}


def test_leakage_in_shards(spark, monkeypatch):
    """One automaton for each item gives the same as one for all, and the spans of all are cut."""
    items = spark.createDataFrame([(i, " ".join(f"v{i}x{k}" for k in range(12))) for i in range(5)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(i, f"Start, {p[1]} Middle. {q[1]} é́nd") for i, (p, q) in enumerate(itertools.combinations(items.collect(), 2))], "doc_id bigint, text string")
    want = sorted(map(tuple, leakage.leaked(docs, items).collect()))
    monkeypatch.setattr(leakage, "SHARD_TOKENS", 40)
    assert len(list(leakage.shards(items))) == 5 and sorted(map(tuple, leakage.leaked(docs, items).collect())) == want and len(want) == 20
    assert {r["text"] for r in leakage.cleaned(docs, items).collect()} == {"Start,  Middle.  é́nd"}


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 7), "a" if i % 4 else "b", i) for i in range(200)] + [(900, None, "a", 0), (901, "x y", None, 0)], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.7, 2), ("n", "b", 1.0, 6), ("n", "none", 0.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    counts, plan = mixing.build(docs, t)
    total = counts.agg(F.sum("tokens")).first()[0]
    assert {(r["mix_id"], r["source"]) for r in plan.where("falls_short").collect()} == {("m", "b")}
    mix = mixing.realise(counts, plan, block=500)
    for r in mixing.mix_report(mix, plan).collect():
        assert r["most_copies"] <= r["max_repeats"] and abs(r["mixed"] - r["budget"]) <= 30 and r["budget"] <= round(r["target_share"] * total)
    at = {}  # positions of a pass are a permutation laid end to end
    for r in mix.orderBy("position").collect():
        assert r["block"] == r["position"] // 500 and r["position"] == at.get((r["mix_id"], r["source"]), 0)
        at[r["mix_id"], r["source"]] = r["position"] + r["tokens"]
    assert mixing.build(docs.limit(0), t)[1].where("budget > 0").count() == 0
    _, tempered = mixing.build(docs, t, mode="tempered")
    for r in tempered.where("mix_id = 'm'").collect():
        assert 0 < r["exponent"] < 1 and r["budget"] <= r["tokens"] * r["max_repeats"] and abs(r["budget"] - r["weight"] * total) <= 1


def test_temperature():
    t = {"a": 9.0, "b": 1.0}
    w = mixing.temperature_weights(t, mixing.bisect_exponent(t, 0.5))
    assert mixing.entropy(w) == pytest.approx(0.5, abs=1e-6)
    assert mixing.temperature_weights(t, 1.0) == pytest.approx({"a": 0.9, "b": 0.1}) and mixing.temperature_weights(t, 0.0, {"a": 0.3, "b": 0.7}) == pytest.approx({"a": 0.3, "b": 0.7})
    e = mixing.bisect_exponent(t, None, {"a": 1.0, "b": 3.0}, 10.0, {"a": 0.3, "b": 0.7})
    assert mixing.temperature_weights(t, e, {"a": 0.3, "b": 0.7})["b"] == pytest.approx(0.3, abs=1e-6)
    assert mixing.temperature_weights({"a": 1.0, "b": 0.0}, 0.5) == {"a": 1.0, "b": 0.0}


def test_subjects_held_out():
    rnd = random.Random(6)
    vocab = {s: [f"{s}term{i}" for i in range(30)] for s in ("law", "sport", "health")}
    common = [f"common{i}" for i in range(40)]
    alpha = lambda w: "".join(chr(97 + int(c)) if c.isdigit() else c for c in w)
    sent = lambda s: " ".join(alpha(rnd.choice(vocab[s] if rnd.random() < 0.6 else common)) for _ in range(9)) + "."
    para = lambda s: " ".join(sent(s) for _ in range(4))
    docs = []
    for _ in range(300):
        ss = rnd.sample(list(vocab), rnd.choice((1, 1, 2)))
        text = "\n\n".join([para(s) for s in ss] + ["Filed under sheet %d by the desk." % rnd.randrange(900)])
        docs.append((text, [rnd.choice(list(vocab))] if rnd.random() < 0.08 else ss, ss))
    m = subjects.fit([(t, ls) for t, ls, _ in docs[:200]], sorted(vocab))
    right = sum({x for x in m.subjects_of([subjects.tokens(p) for p in subjects.paragraphs(t)]) if x} == set(ss) for t, _, ss in docs[200:])
    assert right >= 95
    mixed = " ".join([sent("law"), sent("law"), sent("sport"), sent("law"), sent("law")])
    assert m.subjects_of([subjects.tokens(mixed), []]) == ["law", None]
    assert subjects.fit([], sorted(vocab)).subjects_of([["a"] * 5]) == [None]
