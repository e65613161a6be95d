"""The corpus pipeline: quality rules, line dedup, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns those it
keeps with the columns of ``docs``; the last returns packed sequences.  Columns beyond those
of ``documents`` stay, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.llm import linedup, minhash, packing, quality, substrings
from proseflow.llm.common import stored, table
from proseflow.llm.queries import tokenizer_path


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep.

    A null, empty or short text goes, since it has fewer than 20 words.  Repeated rows are
    judged alike and null ids do not matter.  Long texts are judged whole.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the lines that no earlier document has in a window of three.

    A document of which nothing but white space is left goes; one that had nothing, null or
    empty, stays.  Rows with one id and text are one document, a null id is later than all others.
    """
    rest = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))).alias("rest")
    left = linedup.dedup_lines(docs.select("doc_id", "text", rest)).where("__n_removed = 0 OR text RLIKE '\\\\S'")
    return _with_length(left.select(*(c if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose id is the smallest of its group of near copies (5 words, 0.8).

    Null and empty texts, and rows with a null id, have no copies and stay.  Rows with one id
    are one document: they stay or go together.
    """
    gone = minhash.near_duplicates(docs, words=5, threshold=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the strings of 50 bytes that an earlier document has, in whole characters.

    A document of which nothing but white space is left goes; one that had nothing stays, a
    null text as an empty one.  Rows with one id do not remove each other, nor do null ids.
    """
    cut = substrings.dedup_substrings(docs, carry=True, characters=True)
    text = F.col("kept").cast("string")
    left = cut.where((F.col("n_removed") == 0) | text.rlike(r"\S"))
    # The columns given come from the struct: one of them may be called as one of the operator's own.
    return _with_length(left.select(*(text.alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids.  A null or empty text is its end id alone; every row is a document of its own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("packing", pack),
]

#: The quality model and the token ids are beyond SQL; tests compare with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's table goes when the next one's is written."""
    docs, drop = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, drop_next = stored(stage(spark, docs, sf_dir))
        if drop:
            drop()
        drop = drop_next
    return STAGES[-1][1](spark, docs, sf_dir)
