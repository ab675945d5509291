"""Near copies that share only frequent text, in crowded cells of phase rows."""
import random
from collections import Counter, defaultdict
from itertools import combinations

from crosslight.llm import neardup
from tests.llm.test_llm import sample


def word(rnd, k):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))


def groups(spark, rows):
    got = defaultdict(set)
    for r in neardup.near_duplicate_groups(sample(spark, rows)).collect():
        got[r["class_id"]].add(r["rec_id"])
    return {frozenset(x) for x in got.values() if len(x) > 1}


def test_p3_large_group_of_long_edits(spark):
    rnd = random.Random(5)
    text = word(rnd, 319)
    rows = [(i, "kx_1", None, "a", [(1, 0.5, 5, 50, 15)], text[:k] + word(rnd, 70) + text[k:]) for i, k in ((i, rnd.randrange(320)) for i in range(150))]
    rows += [(1000 + i, "kx_1", None, "a", [(1, 0.5, 5, 50, 15)], word(rnd, 300)) for i in range(50)]
    assert groups(spark, rows) == {frozenset(range(150))}


def test_p3_crowded_cell_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_ROWS", 700)
    rnd = random.Random(6)
    common, rows = word(rnd, 60), []
    for i in range(2500):
        rows.append((i, "kx_1", None, "a", [(1, 0.5 + 0.001 * (i % 9), 5, 50, 15)], common + word(rnd, 70)))
    for i in range(2500, 2700):  # copies of a part of them, few of which are links
        old = rows[rnd.randrange(300)][5]
        rows.append((i, "kx_1", None, "a", [(1, 0.5, 5, 50, 15)], old[: rnd.randrange(95, 125)] + word(rnd, 25)))
    grams = [{r[5][k : k + 5] for k in range(len(r[5]) - 4)} for r in rows]
    every, where, both = set.intersection(*grams), defaultdict(list), Counter()
    for i, x in enumerate(grams):
        for g in x - every:
            where[g].append(i)
    for x in where.values():
        both.update(combinations(x, 2))
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for (i, j), n in both.items():
        n += len(every)
        if 2 * n >= len(grams[i]) + len(grams[j]) - n:
            par[find(j)] = find(i)
    want = defaultdict(set)
    for i in range(len(rows)):
        want[find(i)].add(i)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    assert len(want) > 20 and groups(spark, rows) == want


def test_p3_long_repeated_runs(spark):
    """A remark with a long run of few distinct 5-grams, and very long repetitive ones."""
    rnd = random.Random(7)
    text, w = word(rnd, 60), [(1, 0.5, 5, 50, 15)]
    assert neardup.similar(text + "ab" * 500, text) and not neardup.similar(text + "ab" * 500, "ab" * 500)
    long = [(3, text[:20] * 2000), (4, text[:20] * 2500 + "x")]
    rows = [(i, "kx_1", None, "a", w, t) for i, t in [(1, text + "ab" * 500), (2, text), *long]]
    assert groups(spark, rows) == {frozenset({1, 2}), frozenset({3, 4})}
