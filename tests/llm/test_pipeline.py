import brute

import corpus_pipeline
from weftline.llm import queries


def test_stages(spark, documents, tmp_path):
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents.select(*keep)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.collect()}
    junk = [(d, 0 if any(j in (x or "") for j in ("Foo", "BAR", "x***")) else 1, 0) for d, x in texts.items() if d is not None]
    spark.createDataFrame(junk, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(next(x for x in texts.values() if x and len(x.split()) > 100).split()[:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {d for d in texts if d is not None}
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        names.append(name)
        rows = sorted({(r[0], r[1]) for r in docs.select("doc_id", "text").collect() if r[0] is not None}) if name != "quality" else None
        left = {r[0] for r in out.select("doc_id").collect()} - {None}
        assert left <= before
        if name == "line_dedup":
            want = brute.line_dedup([(d, x) for d, x in rows if x is not None])
            assert {r[0]: r[1] for r in out.select("doc_id", "text").collect() if r[0] is not None and r[1] is not None} == {d: v[2] for d, v in want.items()}
        elif name == "near_dup":
            assert left == {d for d, v in brute.near_duplicates(rows).items() if v[2]}
        elif name == "decontaminate":
            assert left == before - {d for d, _ in brute.leaks(rows, [(1, item)])}
        if name != "bpe":
            assert out.columns == keep
        docs, before = out, left
    assert names == ["quality", "line_dedup", "near_dup", "decontaminate", "bpe"]
    assert {r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} - {None} == before


def test_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
