"""The pipeline on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(4000)]
    text = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=20)) + "." for _ in range(n))
    clean = {i: text(rng.randint(3, 9)) for i in range(60)}
    clean[3] = text(9).replace("\n", " ")  # one line, so that only near-dedup sees its near copy
    words = clean[3].split(" ")
    words[10] = "changed"
    docs = dict(clean)
    docs |= {100: clean[1], 101: " ".join(words), 102: text(4) + "\n" + clean[5] + "\n" + text(3), 103: "### $$$ " * 60, 104: None, 105: "short", 106: text(2) + " " + clean[7].replace("\n", " ")[:400] + " " + text(2)}
    junk = {200 + i: " ".join(rng.choices("### $$$ %%% &&& *** free click".split(), k=60)) for i in range(40)}
    docs |= junk
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in clean] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = at.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.columns == columns
            assert at.where(F.length("text") != F.col("n_chars")).count() == 0
            seen.append({r.doc_id: r.text for r in at.collect()})
    good, lines, near, cut = seen
    assert set(good) == set(docs) - set(junk) - {103, 104, 105}
    assert 100 not in lines and lines[102] == "\n".join(docs[102].split("\n")[:4] + docs[102].split("\n")[-3:])
    assert 101 not in near and set(lines) - set(near) == {101}
    assert len(cut[106]) < len(near[106]) - 300 and {i: cut[i] for i in clean} == clean
    pieces = at.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()
    assert {r.doc_id for r in pieces} == set(cut) and all(r.n == r.total for r in pieces)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == at.columns and run.count() == at.count()


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_order(k):
    assert [n for n, _ in corpus_pipeline.STAGES][k] == ["quality rules", "line dedup", "MinHash near-dedup", "suffix-array dedup", "packing"][k]
