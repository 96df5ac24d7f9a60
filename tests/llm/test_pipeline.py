"""The pipeline's stages on a small table."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    junk = [" ".join(w + "!!" for w in rng.choices(words, k=80)) for _ in range(6)]
    texts = [*good, *junk, good[0], good[1] + "\n", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 30), 0) for i in range(36)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        if at + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
    assert not left["quality"] & set(range(30, 36))
    assert len(left["quality"] & set(range(30))) >= 28
    assert not {0, 36} <= left["exact_dedup"] and not {1, 37} <= left["exact_dedup"]
    assert left["simhash_dedup"] >= left["exact_dedup"] & set(range(2, 30))
    assert left["byte_bpe"] == left["mixing"] <= left["simhash_dedup"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == left["byte_bpe"]
