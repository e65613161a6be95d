"""How the work of the prose queries is dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from proseflow.sources import tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("corpus", [tables.english, tables.russian, tables.pairs])
def test_texts_of_one_row_group_are_made_by_several_tasks(spark, corpus):
    """The file of keys is one row group; all of its texts would be made, and worked on, in one task."""
    rows = corpus(spark, SF)
    assert spark.read.parquet(f"{SF}/orders.parquet").count() == rows.count() == 15_000
    each = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(each) >= 4 and max(r["count"] for r in each) < 6000


def test_runs_and_words_are_found_without_a_fold(spark):
    """Runs of nouns are searched for in a text of the tokens, and findings of single words need no runs."""
    from proseflow.operators import rules_en

    toks = spark.sql("SELECT array(named_struct('tok', 'a', 'phrase', false, 'still', false, 'ends', true)) AS ts").first().ts
    row = lambda tok, kind: toks[0].asDict() | {"tok": tok} | {k: k == kind for k in ("phrase", "still", "ends")}
    kinds = [("a", ""), ("b", "still"), ("c", ""), ("d", ""), ("e", ""), ("x", "ends"), *((w, "") for w in "fghi"), ("y", "phrase"), ("j", ""), ("k", ""), ("l", ""), ("z", "ends"), *((w, "") for w in "mnop")]
    df = spark.createDataFrame([([row(*k) for k in kinds],)], "ts array<struct<tok:string,phrase:boolean,still:boolean,ends:boolean>>")
    found = df.select(rules_en.clusters_of(F.col("ts")).alias("c"))
    assert found.first().c == ["a c d e", "m n o p"]
    assert "zip_with" not in found._jdf.queryExecution().analyzed().toString().lower().replace("zipwith", "zip_with")


@pytest.mark.parametrize("name, most", [("gate_findings", 20), ("glossary_merged", 12)])  # 64 and 54 before
def test_plans_over_pairs_stay_small(spark, name, most):
    """Parts that are read more than once are stored: one plan of them all, each with its own segmentation, filled the driver."""
    from proseflow.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= most


def _plan(spark, name):
    from proseflow.plans import queries

    return queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["file_line", "number"])
def test_a_kind_of_loss_works_out_no_other(spark, kind):
    assert "perhaps" not in _plan(spark, f"fidelity_{kind}")


def test_hedges_need_no_other_kind(spark):
    from proseflow.operators import fidelity

    assert fidelity.FILE_LINE not in _plan(spark, "fidelity_hedge")


@pytest.mark.parametrize("name", ["glued_tokens", "ru_tokens"])
def test_tokens_need_no_sentences(spark, name):
    """Sentences are cut at the mark \\ue002; a token lies in one line and one sentence."""
    assert "" not in _plan(spark, name)


def test_glued_tokens_are_those_of_all_findings(spark):
    from proseflow.operators import gate_ru

    texts = ["UIшка. API-ключ, не-API `xй` https://a.example/жz\nweb-серверы ok. Код2x «кодX»…\n```\nкодY\n```\nUIшка", None, "", "a" * 9 + "й. Б" + "z" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r.doc_id, r.match) for r in gate_ru.text_findings(df).where("rule = 'glued'").collect())
    assert sorted((r.doc_id, r.match) for r in gate_ru.glued_tokens(df).collect()) == want and len(want) >= 4


def test_documents_in_one_row_group_are_work_for_all_tasks(spark, tmp_path):
    rows = spark.range(300).selectExpr("id AS doc_id", "concat('Text ', id) AS text").coalesce(1)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    docs = tables.documents(spark, str(tmp_path), "doc_id", "text")
    sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 300


def _by_broadcast(df) -> list[str]:
    """Keys of the joins that the plan does by broadcast."""
    return re.findall(r"BroadcastHashJoin \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_spans_meet_by_shuffle(spark):
    """Stored spans take few bytes on disk, by which Spark broadcast them: 900,000 rows as 71 and 112 MB."""
    from proseflow.operators import intervals
    from proseflow.sources.storage import checkpointed

    docs = spark.range(50).selectExpr("id AS doc_id", "'abc def' AS text")
    words = checkpointed(docs.selectExpr("doc_id", "1 AS line", "5 AS col", "3 AS width"))
    found = intervals.by_character(words, docs)
    labels = checkpointed(docs.selectExpr("doc_id", "'def' AS item", "4 AS start", "7 AS end"))
    scores = intervals.span_scores(labels, checkpointed(found), ["doc_id"])
    assert not _by_broadcast(found) and not _by_broadcast(scores)
    assert [tuple(r)[1:] for r in scores.distinct().collect()].count((1, 1, 1, 1)) == 50


@pytest.mark.parametrize("name", ["gate_findings", "glossary_merged", "report_ru", "span_scores_ru", "hedges_by_phrase"])
def test_findings_of_texts_are_not_broadcast(spark, monkeypatch, name):
    """What grows with the documents meets by shuffle, in every part that is stored and in the result."""
    from proseflow.plans import queries
    from proseflow.sources import storage

    keys, stored = [], storage.stored

    def noted(df, *args, **kwargs):
        keys.extend(_by_broadcast(df))
        return stored(df, *args, **kwargs)

    monkeypatch.setattr(storage, "stored", noted)
    keys += _by_broadcast(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not [k for k in keys if "doc_id" in k or "pair_id" in k]


def test_russian_texts_are_cut_into_sentences_once(spark, monkeypatch):
    """Words, phrases and tokens each read all sentences; each cut the texts and sentences anew."""
    from proseflow.operators import gate_ru, rules_ru

    calls, cut, tokens = [], rules_ru.placed_sentences, rules_ru.placed_tokens
    monkeypatch.setattr(rules_ru, "placed_sentences", lambda text: calls.append("s") or cut(text))
    monkeypatch.setattr(rules_ru, "placed_tokens", lambda *x: calls.append("t") or tokens(*x))
    df = spark.createDataFrame([(1, "Узлы сети целы. Крутые узлы."), (2, None)], "doc_id long, text string")
    found = gate_ru.text_findings(df)
    assert sorted(calls) == ["s", "t"]
    assert sorted((r.rule, r.col, r.match) for r in found.collect()) == [("domain", 1, "Узлы"), ("lexicon", 24, "узлы")]
