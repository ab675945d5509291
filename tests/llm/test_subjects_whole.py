import random
import zlib

import numpy as np

from crosslight.llm import common, subjects


def corpus(n):
    rnd = random.Random(11)
    word = lambda s, i: s + "".join(chr(97 + int(c)) for c in str(i))
    names = ["health", "law", "sport"]
    para = lambda s: " ".join(word(s if rnd.random() < 0.6 else "common", rnd.randrange(40)) for _ in range(12)) + "."
    docs = []
    for i in range(n):
        ss = rnd.sample(names, rnd.choice((1, 1, 2)))
        docs.append((i, "\n".join([para(s) for s in ss] + ["filed under sheet %d by the desk." % i]), [rnd.choice(names)] if rnd.random() < 0.08 else sorted(ss)))
    return docs, names


def test_models_come_from_all_labelled_documents(spark):
    docs, names = corpus(4600)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(9000, None), (9001, "no label here at all.")], "doc_id bigint, text string").repartition(3)
    rows = [(i, a, s) for i, _, ls in docs for s in ls for a in ("x", "y")] + [(0, "x", None), (1, "x", "unknown"), (9000, "x", "law"), (None, "x", "law")]
    got = subjects.fitted(d, spark.createDataFrame(rows, "doc_id bigint, annotator string, subject string"), spark.createDataFrame([(s,) for s in names], "subject string"))
    trained = [t for i, t, _ in docs if zlib.crc32(str(i).encode()) % 5]
    assert round(got.total[-1]) == sum(len(subjects.tokens(p)) for t in trained for p in subjects.paragraphs(t))
    assert round(got.total[-2]) == sum(len(subjects.tokens("filed under sheet 1 by the desk.")) for _ in trained)
    want = subjects.fit([(t, ls) for _, t, ls in docs], names)
    assert np.array_equal(got.counts, want.counts) and np.allclose(got.thresholds, want.thresholds)
    asked = [subjects.tokens(p) for _, t, _ in docs[:200] for p in subjects.paragraphs(t)]
    assert got.subjects_of(asked) == want.subjects_of(asked)


def test_models_of_few_and_of_no_documents(spark):
    docs, names = corpus(30)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s) for i, _, ls in docs for s in ls], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s,) for s in names], "subject string")
    got, want = subjects.fitted(d, labels, areas), subjects.fit([(t, ls) for _, t, ls in docs], names)
    assert np.array_equal(got.counts, want.counts) and np.allclose(got.thresholds, want.thresholds)
    assert subjects.fitted(d, labels.limit(0), areas).subjects_of([["a"] * 5]) == [None]
    assert subjects.fitted(d, labels, areas.limit(0)).subjects_of([["a"] * 5]) == [None]


def test_models_are_the_same_without_broadcasts(spark, monkeypatch):
    docs, names = corpus(80)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, s) for i, _, ls in docs for s in ls], "doc_id bigint, subject string")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = subjects.fitted(d, labels, spark.createDataFrame([(s,) for s in names], "subject string"))
    want = subjects.fit([(t, ls) for _, t, ls in docs], names)
    assert np.array_equal(got.counts, want.counts) and np.allclose(got.thresholds, want.thresholds)
