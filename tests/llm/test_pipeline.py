"""The pipeline on a small planted corpus."""

from __future__ import annotations

import random

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stem):
    return [f"{stem}{rng.randrange(4000)}" for _ in range(n)]


def test_planted_cases_are_caught_and_clean_documents_kept(spark, tmp_path):
    rng = random.Random(1)
    items = [prose(rng, 30, "item") for _ in range(5)]
    shared = prose(rng, 60, "shared")
    texts = {i: prose(rng, rng.randint(80, 160), "w") for i in range(60)}
    clean = set(range(5, 40))
    texts[40] = texts[5].copy()
    texts[41] = texts[6][:100] + ["edit"] + texts[6][101:] if len(texts[6]) > 101 else texts[6].copy()
    texts[42] += items[0]
    texts[43] = texts[43][:20] + items[1][:10] + ["other"] + items[1][11:] + texts[43][20:]
    for i in (44, 45, 46):
        texts[i][30:30] = shared
    texts[47] = texts[47][:20]
    texts[48] = (texts[48][:6] * 30)[:150]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in texts.items()] + [(None, " ".join(prose(rng, 90, "n")), None, None, None), (99, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.schema.names == docs.schema.names, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in kept]
    assert ids[0] == (set(range(60)) | {None}) - {47, 48}
    assert 40 not in ids[1] and 5 in ids[1] and ids[0] - ids[1] <= {40, 41}
    by_id = {r.doc_id: r for r in kept[2]}
    for i in (44, 45, 46):
        assert not set(shared) & set(by_id[i].text.split()) and by_id[i].n_chars == len(by_id[i].text)
    assert all(by_id[i].text == " ".join(texts[i]) for i in clean)
    assert ids[2] - ids[3] == {42, 43}
    assert {r.doc_id for r in kept[4]} == ids[3]
    assert clean <= ids[4]
    assert cp.run(spark, str(tmp_path)).count() == len(kept[4])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(3)
    plain, long_text = " ".join(prose(rng, 90, "w")), " ".join(f"v{i}x{rng.randrange(99)}" for i in range(150_000))
    rows = [(1, plain, "a", 1, 2), (1, plain, "a", 1, 2), (2, long_text, "b", 3, 4), (None, " ".join(prose(rng, 70, "n")), "c", 5, 6), (3, None, "d", 7, 8), (4, "", "e", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, row int, spans int").repartition(2)
    spark.createDataFrame([(1, "an item of words that none holds at all"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"out{k}"))
            sizes.append(sorted(((r.doc_id, r.node, r.row, r.spans) for r in docs.collect()), key=str))
    assert sizes[0] == sorted([(1, "a", 1, 2), (1, "a", 1, 2), (2, "b", 3, 4), (None, "c", 5, 6)], key=str)
    assert sizes[1] == sizes[2] == sizes[3] == sorted([(1, "a", 1, 2), (2, "b", 3, 4), (None, "c", 5, 6)], key=str)
