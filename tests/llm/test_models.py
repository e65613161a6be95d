"""Operators 3, 9 and 10: exact parts against brute force, models by held-out accuracy."""

import random
import re

import pytest

from proseflow.llm import langid, linedup, quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {k for k, w in enumerate(windows) if windows.count(w) > 1}
    covered = {k + d for k in twice for d in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


TEXTS = [None, "", " \n\t", "word", "é ü x # | <b>", "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h i", "x\nx\n\n \nx\ny", "one two " * 20000, "\x0b a\x0cb\r\nc"]


def test_counts(documents):
    rows = {r.doc_id: r for r in quality.assess(documents(enumerate(TEXTS)), None).collect()}
    for i, text in enumerate(TEXTS[:8] + TEXTS[9:]):
        i = TEXTS.index(text)
        r = rows[i]
        n = brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, text
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and r.kept != r.base_failed
    assert rows[8].n_repeat_words == 40000 and not rows[8].kept


def labelled(n=240):
    rng = random.Random(8)
    clean = "the quick report shows that many small rivers reach open water before winter ends and people walk along".split()
    junk = "click ### $$$ free %%% win *** buy now!!! &&& xxx".split()
    return [(i, " ".join(rng.choices(junk if i % 4 == 0 else clean, k=60)), int(i % 4 != 0)) for i in range(n)]


def test_quality_model(spark, documents):
    rows = labelled()
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 3] + [(None, 1, 0), (1, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.assess(docs, model).collect()}
    held = [(i, q) for i, _, q in rows if i % 3 == 0]
    assert sum((got[i].probability >= quality.THRESHOLD) == bool(q) for i, q in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_without_labels(spark, documents):
    docs = documents([(1, "word " * 5), (2, None)])
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert quality.assess(documents([]), None).count() == 0


def test_language(spark):
    rng = random.Random(2)
    words = {"en": "the of and to in that with for this which".split(), "de": "der die und nicht mit ist auch über für ein".split(), "fr": "le la et les des pour dans est une été".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 !", "fr"), (903, "the of " * 100000, None), (904, "和漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    model = langid.fit(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows[:180] if i % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[904].lang_pred in words and all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(df.limit(0))
    assert [r.lang_pred for r in langid.predict(df.where("doc_id = 1"), none).collect()] == ["und"]
    assert langid.predict(df.limit(0), model).count() == 0


def test_pieces_share_and_lose_no_gram(monkeypatch):
    text = "abc defg hij " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "GROUP_BYTES", 7)
    assert (langid.features(text) == whole).all()


def brute_lines(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_lines(documents):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choices(["a", "b", "", "c d"], k=rng.randint(0, 9)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\ny\nz\nx\ny\nz"), (104, "\n".join(map(str, range(5000)))), (105, "\n".join(map(str, range(2500, 9000))))]
    rng.shuffle(docs)
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_removed"]) for r in linedup.dedup_lines(documents(docs)).collect()}
    assert got == brute_lines(docs)
    assert linedup.dedup_lines(documents([])).count() == 0
    same = linedup.dedup_lines(documents([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted((str(r.doc_id), r["__n_removed"]) for r in same) == [("1", 0), ("1", 0), ("None", 3)]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_windows_shorter_than_size(n):
    import numpy as np

    from proseflow.llm.words import windows

    assert len(windows(np.arange(n - 1, dtype=np.uint64), n)) == 0
