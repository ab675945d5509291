from crosslight.llm import truncation


def test_p2_crowded_key_gives_all_open_pairs(spark, monkeypatch):
    """3000 texts under one key, few of them without a closed plan (even cid): all pairs of these, parted or not."""
    cids = [2 * i + (i % 300 != 7) for i in range(3000)]
    sigs = spark.createDataFrame([(5, c, c % 2 == 1) for c in cids] + [(6, 1, True), (6, 3, True), (7, 2, False), (7, 9, True)], "sig bigint, cid bigint, target boolean")
    even = {c for c in cids if c % 2 == 0}
    want = {(min(a, b), max(a, b)) for a in even for b in cids if a != b} | {(2, 9)}
    for rows in (8192, 700):
        monkeypatch.setattr(truncation, "CELL_ROWS", rows)
        assert {(r["u"], r["v"]) for r in truncation.open_pairs(sigs).collect()} == want
