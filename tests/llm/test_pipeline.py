"""The corpus pipeline, stage by stage, on the smallest documents."""

import corpus_pipeline
from celestrum.llm import shared
from tests.llm.test_text_operators import brute_groups, brute_hits, brute_repeats, planned

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.written(stage(spark, docs, SF), f"test{k}")
        after.append({r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert all(r["n_chars"] == len(r["text"]) for r in after[k].values())
    quality, unique, cut, clean, packed = after
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k in before if known.get(k) == 1]
    assert sum(k in quality for k in good) >= 0.97 * len(good) and all(quality[k] == before[k] for k in quality)
    ids = sorted(quality)
    groups = brute_groups([quality[k]["text"] for k in ids], 5, 80)
    assert sorted(unique) == [k for n, k in enumerate(ids) if groups[n][1] == n]
    ids = sorted(unique)
    data, gone = brute_repeats([unique[k]["text"] for k in ids], 200, True)
    want = {k: bytes(b for b, g in zip(t, m, strict=True) if not g).decode(errors="ignore") if m.any() else unique[k]["text"] for k, t, m in zip(ids, data, gone, strict=True)}
    assert {k: r["text"] for k, r in cut.items()} == {k: t for k, t in want.items() if t.strip(" ")}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(cut)
    hits = brute_hits([cut[k]["text"] for k in ids], items)
    assert sorted(clean) == [k for k, (n, h, _) in zip(ids, hits, strict=True) if not (h > 0 and 20 * h >= n)]
    assert all(h == 0 for _, h, _ in brute_hits([r["text"] for r in clean.values()], items))
    assert {r["doc_id"] for r in packed} == set(clean)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_dropping_near_duplicates_broadcasts_nothing(spark, monkeypatch):
    plans = planned(monkeypatch)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared.written(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "result")
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8
    assert not any("Broadcast" in p for p in plans)


def test_cutting_drops_only_what_was_cut(spark):
    long = "".join(f"{k} " for k in range(200))
    rows = [(1, "", 0), (2, "", None), (3, "   ", 3), (4, None, None), (5, long, len(long)), (6, long, len(long)), (7, "x", None)]
    docs = spark.createDataFrame([(k, t, "en", "s", n) for k, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert got == {1: "", 2: "", 3: "   ", 4: None, 5: long, 7: "x"}


def test_stages_of_an_empty_table_and_of_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs.limit(0), docs.limit(12).unionByName(docs.limit(12))):
        ids = {r["doc_id"] for r in table.collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = shared.written(stage(spark, table, SF), f"odd{k}")
            kept = [r["doc_id"] for r in table.collect()]
            assert set(kept) <= ids and (k in (0, 4) or len(kept) == len(set(kept)))
        assert bool(ids) == bool(kept)
