"""Shared storage and skewed joins."""

import os
import types

import pytest
from pyspark.sql import functions as F

from proseflow.llm import bpe, common, embeddings, minhash, token_file, words


def test_tables_of_a_run_are_deleted(spark):
    df, drop = common.stored(spark.range(5).toDF("x"))
    folder = common.run_dir(spark)
    assert df.count() == 5 and len(os.listdir(folder.removeprefix("file:"))) >= 1
    drop()
    common.stored(spark.range(5).toDF("x"))
    common.release()
    assert not os.path.exists(folder.removeprefix("file:"))


def test_no_local_folder_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *a: None)
    sc = types.SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(types.SimpleNamespace(sparkContext=sc, conf=conf))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [0, 1, 1000])
def test_join_skewed(spark, monkeypatch, how, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 1, 2, 2, 3, None])], "k int, i int")
    few = spark.createDataFrame([(1, "a", 3), (2, "b", 2)], "k int, v string, size int")
    got = sorted((r.i, r.v) for r in common.join_skewed(rows, few, ["k"], "size", how).collect())
    want = [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b")]
    assert got == want + [(5, None), (6, None)] * (how == "left")


def test_long_chunks_are_not_cached():
    import public_tokenizers

    encode = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "漢" * 3000 + " " + "x" * 3000
    encode(text)
    assert max(map(len, [*encode.words, *encode.chunks, *encode.spaced]), default=0) <= bpe.LONGEST
    words.word_hashes(b"y" * 1000)
    assert b"y" * 1000 not in words._HASHES


def test_large_end_id(documents):
    import numpy as np
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_file.round_trip(documents([(1, "some text"), (2, None), (None, "x"), (2, None)]), path, end_id=70_001).collect()
    assert len(rows) == 4 and all(np.frombuffer(r.ids, "<u4")[-1] == 70_001 for r in rows)
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.start)] == [2, 3, 1, 1]


def test_sets_written_with_other_parameters_are_read(spark, tmp_path):
    import numpy as np

    ids = np.random.default_rng(1).zipf(1.5, 3000) % 500
    lengths = token_file.code_lengths(np.bincount(ids, minlength=500), 12)
    checkpoints, bits = token_file.pack_bits(ids, lengths, token_file.canonical(lengths), 100)
    schema = "start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, bits binary"
    spark.createDataFrame([(0, [7], [3000], bytearray(checkpoints), bytearray(bits))], schema).write.parquet(f"{tmp_path}/shards")
    spark.createDataFrame([(12, 100, bytearray(lengths.tobytes()))], "max_bits int, block int, lengths binary").write.parquet(f"{tmp_path}/codebook")
    (row,) = token_file.read_token_files(spark, str(tmp_path)).collect()
    assert (np.frombuffer(row.ids, "<u4") == ids).all()


def test_sketch_drops_no_linked_pair():
    """Pairs at the bound, as the signatures see them."""
    import numpy as np

    rng = np.random.default_rng(2)
    for threshold in (80, 85, 95):
        bands, rows = minhash.banding(threshold)
        allowed = minhash.bits_allowed(threshold, min(bands * rows, minhash.SKETCHED))
        far = 0
        for _ in range(150):
            n = int(rng.integers(40, 400))
            own = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            other = round(n * (100 - threshold) / (100 + threshold))  # elements that each has alone
            a, b = np.sort(own[:n]), np.sort(own[other : n + other])
            x, y = (np.array(minhash.signature(s, bands, rows)[1]).view(np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= allowed
            z = np.array(minhash.signature(np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)), bands, rows)[1]).view(np.uint64)
            far += int(np.bitwise_count(x ^ z).sum() > allowed)
        assert far >= 148  # unlike sets are dropped


def test_recall_of_layouts(spark):
    """Planted pairs around the bound, in a table of many tiles; against brute force, two lengths."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows, at = [], 0
    for d, n in ((16, 1500), (48, 1500)):
        own = rng.normal(size=(n, d))
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        step = rng.normal(size=own.shape)
        step -= (step * own).sum(1, keepdims=True) * own
        step /= np.linalg.norm(step, axis=1, keepdims=True)
        c = rng.uniform(0.945, 1, (n, 1))
        both = np.concatenate([own, c * own + np.sqrt(1 - c * c) * step]).astype(np.float32)
        rows += [(at + i, v.tolist()) for i, v in enumerate(both)]
        at += len(both)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, tile=100).collect()}
    want = {}
    for d in (16, 48):
        own = [(i, v) for i, v in rows if len(v) == d]
        x = np.array([v for _, v in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= dict(zip((i for i, _ in own), ((x @ x.T >= 0.95).sum(1) - 1).tolist(), strict=True))
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_very_long_vectors(spark):
    rows = [(1, [1.0] * 20_000), (2, [1.0] * 19_999 + [1.1]), (3, [-1.0] * 20_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # d * d sums would be 3 GB: such vectors are ordered by variance only.
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    shuffled = lambda: {f for f in files() if f.rsplit("/", 1)[-1].startswith("shuffle_")}
    before = shuffled()
    table, drop = common.stored(spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n")))
    assert table.count() == 1000
    assert not {f for f in shuffled() - before if f.endswith(".data") and os.path.getsize(f) > 2000}  # the count's own are smaller
    drop()
