"""Word uses over a stream with a restart and late rows; reports as files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from proseflow.operators import dictionary, rules_en
from proseflow.sources import reports
from proseflow.streaming import check

SCHEMA = "doc_id long, text string, ts timestamp"
DAY = dt.datetime(2026, 1, 1)


def test_word_uses_after_a_restart(spark, tmp_path):
    texts = ["Ensure it. They should ensure the fix.", "Fix it; the fix is new. Call them.", "Lose it. You should call."]
    rows = [(i % 5, texts[i % 3], DAY + dt.timedelta(hours=7 * (i // 2))) for i in range(24)]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = check.word_uses(check.read_documents(spark, source, SCHEMA), bucket="12 hours")
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(rows[:12])
    run()
    arrive(rows[12:])
    run()  # a new query from the same state: counts of open windows go on
    late = (9, "Ensure it.", DAY)
    arrive([late, (8, "Go.", DAY + dt.timedelta(days=30))])
    run()
    arrive([(8, "Go.", DAY + dt.timedelta(days=31))])
    run()
    key = lambda r: (r.bucket, r.doc_id, r.base, r.kind, r.example, r.n, tuple(r.first))
    got = [key(r) for r in spark.read.parquet(sink).collect() if r.doc_id != 8]
    want = [key(r) for r in check.word_uses(spark.createDataFrame(rows, SCHEMA), bucket="12 hours").collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got)) > 10


def test_reports_are_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["He can't stop.", "Remove the cover.", "", "The file was removed by it.\nÉ"] * 3)] + [(3, "Again.")], "doc_id long, text string")
    made = rules_en.reports(docs.dropDuplicates(["doc_id"]), dictionary.seed()).select("doc_id", "text", (F.col("doc_id") % 2).alias("hard"))
    path = str(tmp_path / "reports")
    reports.write(made.repartition(3), path)
    got = {int(r.file): r.text for r in reports.read(spark, path).collect()}
    assert got == {r.doc_id: r.text for r in made.collect()} and len(got) == 12
    assert tuple(reports.status(spark, path).head()) == (12, 1, 6) or reports.status(spark, path).head().asDict() == {"documents": 12, "failed": 6, "exit_code": 1}
    reports.write(made.where("doc_id = 2"), path, overwrite=True)
    assert [r.file for r in reports.read(spark, path).collect()] == ["2"]
    assert reports.status(spark, path).head().asDict() == {"documents": 1, "failed": 0, "exit_code": 0}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "reports")
    broken = spark.range(20).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"), F.lit(0).cast("long").alias("hard"))
    with pytest.raises(Exception, match="broken"):
        reports.write(broken, path)
    assert not os.path.isdir(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="not there"):
        reports.write(spark.range(1).select(F.col("id").alias("doc_id")), path)
