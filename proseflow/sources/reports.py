"""Reports as files: a Spark data source that writes a file for each document, with a commit.

A task writes its files to a folder of its own attempt.  When all tasks are done the driver
moves one folder for each task into place and writes the status; a failed task or job leaves
nothing but a folder of attempts, which goes.  So the driver handles as many names as there
are partitions, whatever the documents.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STATUS = "status.json"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the folder of its attempt, its partition, documents and those with hard findings."""

    folder: str
    partition: int
    documents: int
    hard: int


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.staging = os.path.join(path, f"_staging-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        folder = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(folder)
        documents = hard = 0
        for row in iterator:
            name = re.sub(r"[^\w.-]", "_", str(row.doc_id))
            target = os.path.join(folder, f"{name}.txt")
            k = 1
            while os.path.exists(target):  # documents of one id are files of their own
                k += 1
                target = os.path.join(folder, f"{name}-{k}.txt")
            with open(target, "w", encoding="utf-8", newline="") as out:
                out.write(row.text or "")
            documents += 1
            hard += (row.hard or 0) > 0
        return Written(folder, task.partitionId(), documents, hard)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if name.startswith("part-") or name == STATUS:
                    old = os.path.join(self.path, name)
                    shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        os.makedirs(self.path, exist_ok=True)
        for m in done:
            os.rename(m.folder, os.path.join(self.path, f"part-{m.partition:05d}-{self.job}"))
        status = {"documents": sum(m.documents for m in done), "failed": sum(m.hard for m in done)}
        last = os.path.join(self.path, f"_{STATUS}-{self.job}")
        with open(last, "w", encoding="utf-8") as out:
            json.dump(status | {"exit_code": int(status["failed"] > 0)}, out)
        os.replace(last, os.path.join(self.path, STATUS))  # comes last: with it, the reports are complete
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ReportFiles(DataSource):
    """``format("report_files").option("path", folder)`` for rows of ``doc_id, text, hard``; the folder is one that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "doc_id long, text string, hard long"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        missing = {"doc_id", "text", "hard"} - set(schema.names)
        if missing or "path" not in self.options:
            raise ValueError(f"reports need a path and the columns doc_id, text, hard; not there: {sorted(missing) or 'path'}")
        return ReportWriter(self.options["path"].removeprefix("file://"), overwrite)


def write(reports: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes ``reports(doc_id, text, hard)``: a file for each row, and ``status.json`` with the exit code."""
    reports.sparkSession.dataSource.register(ReportFiles)
    reports.write.format("report_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of the reports in a folder."""
    from pyspark.sql import functions as F

    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("file"), F.col("value").alias("text"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """``documents, failed, exit_code`` of the last write."""
    return spark.read.json(f"{path}/{STATUS}")
