"""Operators 3 and 9 and the whole pipeline against plain versions in Python."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import test_minhash
import test_models
import test_substrings
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from proseflow.llm import langid, linedup, quality, substrings
from proseflow.llm.words import PLACES

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def gram_bucket(chars, bits):
    x = ord(chars[0]) * 2654435761 & M32
    for c in chars[1:]:
        x ^= x >> 15
        x = (x + ord(c)) * 2246822519 & M32
    x = (x ^ x >> 13) * 3266489917 & M32
    return x >> (32 - bits)


def mixed(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 32


def plain_grams(text):
    """(length of the n-gram, bucket) as operator 3 defines them."""
    kept = "".join(c if c.isalpha() or ord(c) >= 128 and c not in "\x85\xa0  　" else " " for c in f" {text.lower()} ")
    kept = re.sub(" +", " ", kept)
    return [(n, gram_bucket(kept[k : k + n], langid.BITS)) for n in langid.LENGTHS for k in range(len(kept) - n + 1)]


def plain_bayes(train, texts):
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in train:
        docs[lang] += 1
        counts[lang].update(plain_grams(text))
    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in docs:
            total = {n: sum(v for (m, _), v in counts[lang].items() if m == n) for n in langid.LENGTHS}
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                math.log((counts[lang][g] + langid.SMOOTHING) / (total[g[0]] + langid.SMOOTHING * (1 << langid.BITS))) for g in plain_grams(text)
            )
        best = min(logs, key=lambda x: (-logs[x], x))
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_naive_bayes_against_plain_counts(spark):
    rng = random.Random(6)
    words = {"en": "the of and to in that with".split(), "de": "der die und nicht mit über für".split(), "fr": "le la et les une été ça".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(0, 12))), x) for i, x in enumerate(["en", "de", "fr", "en"] * 12)]
    rows += [(i, t, "de") for i, t in enumerate(["Über 12, 34!\n\tundso", "和漢 字", "A\xa0B", "x", "12", "", "퟿", "🙂 a"], 100)] + [(7, "the of", "en"), (None, "the of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS bucket", "2 AS n")
    known = [(t, x) for _, t, x in rows if x]
    got = langid.predict(df, langid.fit(df)).collect()
    want = plain_bayes(known, [t for _, t, _ in rows])
    assert len(got) == len(rows)
    for r, (i, _, _), (lang, score) in zip(got, rows, want, strict=True):
        assert (r.doc_id, r.lang_pred) == (i, lang) and abs(r.score - score) < 1e-4


def plain_probability(text, model):
    weights, slope, offset = model
    text = text or ""
    hashes = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    shift = 64 - quality.BITS
    kinds = [
        [(h * int(PLACES[40]) & M64) >> shift for h in hashes],
        [mixed((mixed(a * int(PLACES[0]) & M64) + mixed(b * int(PLACES[1]) & M64)) & M64) >> shift for a, b in zip(hashes, hashes[1:], strict=False)],
        *([gram_bucket(text[k : k + n], quality.BITS) for k in range(len(text) - n + 1)] for n in quality.GRAMS),
    ]
    score = sum(sum(float(weights[(k << quality.BITS) + b]) for b in found) / len(found) for k, found in enumerate(kinds) if found)
    return 1 / (1 + math.exp(-(slope * score + offset)))


def plain_kept(text, model):
    n = test_models.brute_counts(text)
    return not (n[0] < 20 or 100 * n[4] > 30 * n[0]) and plain_probability(text, model) >= quality.THRESHOLD


def test_quality_against_plain_scores(spark, documents):
    rows = test_models.labelled(80) + [(500, "é ü " * 30, 1), (501, None, 0), (502, "word " * 25 + "和漢", 1), (0, "again " * 30, 0)]
    docs = documents([(i, t) for i, t, _ in rows] + [(None, rows[1][1]), (1, rows[1][1])])
    # Contradictory labels: the lower one counts.
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.assess(docs, model).collect()
    assert len(got) == docs.count()
    for r, text in zip(got, [t for _, t, _ in rows] + [rows[1][1]] * 2, strict=True):
        assert abs(r.probability - plain_probability(text, model)) < 1e-6 and r.kept == plain_kept(text, model)


def test_fit_decreases_the_loss_and_calibrates():
    rng = np.random.default_rng(5)
    good = np.arange(200) % 2 == 0
    rows = [(np.arange(6, dtype=np.int32), (rng.dirichlet([3 if g else 1, 1, 1, 1 if g else 3, 1, 1])).astype(np.float32)) for g in good]
    weights, slope, offset = quality.train(rows, good, 0.5)
    x = np.array([weights[b] @ v for b, v in rows])
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    loss = lambda p: -(np.log(p[good]).mean() + np.log(1 - p[~good]).mean()) / 2
    assert loss(p) < 0.6 and abs(p[:: 5].mean() - 0.5) < 0.05  # better than a coin; mean as the share on the rows calibrated on


def test_sample_is_bounded_in_bytes(spark, documents):
    rows = test_models.labelled(60)
    docs, labels = documents([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, sample_bytes=1) is not None  # one text of each class at least


def plain_pipeline(rows, model):
    """All stages but packing, over (id, text) with distinct ids."""
    docs = [(i, t) for i, t in rows if plain_kept(t, model)]
    lines = test_models.brute_lines(docs)
    docs = [(i, lines[i][0]) for i, _ in docs if not lines[i][2] or lines[i][0].strip()]
    docs = [(i, t) for (i, t), keep in zip(sorted(docs), [x[3] for x in test_minhash.brute(sorted(docs), 5, 80)], strict=True) if keep]
    out = {}
    for (i, raw, removed, spans, _), (j, text) in zip(test_substrings.brute(docs), sorted(docs), strict=True):
        assert i == j and raw == len(text.encode())
        data, kept, at = text.encode(), b"", 0
        for s, e in spans:  # whole characters only
            while s < e and data[s] & 0xC0 == 0x80:
                s += 1
            while s < e < len(data) and data[e] & 0xC0 == 0x80:
                e -= 1
            kept, at = kept + data[at:s], e
        kept = (kept + data[at:]).decode()
        if kept.strip() or not removed:
            out[i] = kept
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 8))) for _ in range(900)]
    line = lambda: " ".join(rng.choices(words, k=12)) + "."
    passage, shared = " ".join(rng.choices(words, k=60)), [line() for _ in range(4)]
    rows = []
    for i in range(90):
        text = [line() for _ in range(rng.randint(2, 6))]
        if i % 5 == 1:
            text.insert(1, passage[rng.randint(0, 30) :])
        if i % 7 == 2:
            text += shared
        rows.append((i, "\n".join(text)))
    near = [(200 + i, rows[i][1].replace(rows[i][1].split()[5], "changed", 1)) for i in range(8)]
    rows += [(100 + i, rows[3 * i][1]) for i in range(10)] + near
    rows += [(300, None), (301, ""), (302, "short one"), (303, passage), *((400 + i, " ".join(rng.choices("### $$$ %%% click &&&".split(), k=40))) for i in range(20))]
    rng.shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(rows, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert 60 < len(want) < len(rows) - 25
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for i, t in want.items()}
    got, used = collections.defaultdict(list), collections.Counter()
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert max(used.values()) <= 4096
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in got.items()} == ids


STAGES = corpus_pipeline.STAGES[:4]


@pytest.mark.parametrize("stage", [f for _, f in STAGES], ids=[n for n, _ in STAGES])
def test_stages_with_odd_rows(spark, tmp_path, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, empty tables."""
    long_ = " ".join(f"word{k}" for k in range(60_000))
    clean = [f"this is the clean text number {i} and it tells of the river {i * 7} and the hill {i * 13} near town {i * 17} with no word found in any other of them" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(50, None), (51, ""), (52, " \n "), (53, long_), (None, clean[0]), (0, clean[0]), (0, clean[0]), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    names = "n_removed n_spans kept rest id row __id __row __lines __kept __n_lines __n_removed spans n_bytes component_id node s t h g size pos first quality __gone hash kind block".split()
    docs = docs.selectExpr("*", *(f"'{c}' AS {c}" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == c for r in got for c in names)
    kept = collections.Counter((r.doc_id, r.text or "") for r in got)
    assert all(kept[i, t] for i, t in rows[1:12]) and kept[53, long_] == 1
    assert kept[0, clean[0]] == 3
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_names_of_operators_do_not_clash(documents):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    docs = documents(rows).selectExpr("*", "1 AS __id", "2 AS __row", "3 AS __lines", "4 AS __kept", "5 AS h", "6 AS size")
    got = sorted(linedup.dedup_lines(docs).collect())
    assert [(r["__id"], r["__row"], r["__lines"], r["__kept"], r.h, r["size"]) for r in got] == [(1, 2, 3, 4, 5, 6)] * 2
    assert [(r.text, r["__n_removed"]) for r in got] == [("a\nb\nc", 0), ("d", 3)]


@pytest.mark.parametrize("length", [24, 30, 279])
def test_lengths_of_strings(documents, length):
    rng = random.Random(3)
    text = "".join(rng.choices("abcd", k=900))
    docs = [(1, text), (2, text[100:700] + "x" + text[300:301]), (3, text[: length - 1]), (4, text[:length])]
    rows = substrings.dedup_substrings(documents(docs), length).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in rows) == test_substrings.brute(docs, length)


@pytest.mark.parametrize("length", [0, 23, 280])
def test_lengths_out_of_range(documents, length):
    with pytest.raises(ValueError, match="between"):
        substrings.dedup_substrings(documents([]), length)


def test_remembered_runs(documents, monkeypatch):
    """Small portions, so that runs come again in later ones, and a memory that overflows."""
    monkeypatch.setattr(substrings, "WORK_BYTES", 300)
    monkeypatch.setattr(substrings, "SEND_BYTES", 600)
    monkeypatch.setattr(substrings, "REMEMBERED", 9)
    docs = test_substrings.corpus()
    rows = substrings.dedup_substrings(documents(docs).coalesce(1)).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in rows)
    assert got == test_substrings.brute(docs)
