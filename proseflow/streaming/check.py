"""The rules over streams.

Findings are stateless by document, so a stream runs the same plan as a table.  Word uses are
stateful: the first use and the count of each word of a document in a window of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import dictionary, rules_en, segments

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def findings(stream: DataFrame, mode: str = "auto") -> DataFrame:
    """Findings of each document as it arrives."""
    return rules_en.findings(stream, mode, own=dictionary.seed())


def counts(stream: DataFrame) -> DataFrame:
    """Running counts of findings by kind (complete or update mode); the state has a row for each kind."""
    return findings(stream).groupBy("rule", "kind").agg(F.count("*").alias("n"))


def word_uses(stream: DataFrame, delay: str = "1 hour", bucket: str = "1 day", own: dictionary.Dictionary | None = None) -> DataFrame:
    """``bucket, doc_id, base, kind, example, n, first``: words to change by document and window of ``ts``.

    Kind and example are those of the first use by sentence and place.  A window ends when the
    watermark has passed it; its state goes then, and rows that come later than ``delay`` are
    left out.  In append mode each group comes once.  Over a table the same, without a watermark.
    """
    own = own or dictionary.seed()
    rows = own.attached(segments.counted_sentences(stream, "ts"))
    judged = rules_en.judged(segments.tokens_of(F.col("text")))
    hits = rows.select("doc_id", "ts", "sent", rules_en.short(F.col("text")).alias("example"), F.inline(T.let(judged, rules_en.hits_of)))
    if stream.isStreaming:
        hits = hits.withWatermark("ts", delay)
    at = F.struct("sent", "ord")
    grouped = hits.groupBy(F.window("ts", bucket).alias("w"), "doc_id", "base").agg(F.min_by(F.struct("kind", "example"), at).alias("x"), F.count("*").alias("n"), F.min(at).alias("first"))
    return grouped.select(F.col("w.start").alias("bucket"), "doc_id", "base", "x.kind", "x.example", "n", "first")
