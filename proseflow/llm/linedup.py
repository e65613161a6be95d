"""Operator 10: removal of repeated passages of three lines, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import join_skewed, stored

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and ``__n_lines, __n_removed``.

    Every ``window`` consecutive lines are a window, unless all are blank.  Of windows that
    are equal anywhere in the table, the first in order of (id, line) stays; the lines that
    a later one covers go, merged where windows overlap.  Texts of fewer lines and null
    texts (no lines) stay as they are, and long texts are read whole.  A null id comes after
    all others.  Rows with the same id and text count as one document, so that neither
    removes the other.  Other columns stay, whatever their names; only the two new ones
    would replace columns that have theirs.
    """
    other = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    id_, text = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.col(text_col)
    # The columns given travel in a struct, so that none clashes with those used here.
    keyed = docs.select(id_.alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), F.struct(*other).alias("rest"))

    def at(i: Column) -> Column:
        parts = [F.get("l", i + k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h"), F.hash(*reversed(parts)).alias("g"), F.concat(*parts).rlike(r"\S").alias("seen"))

    found = keyed.where("text IS NOT NULL").select("id", "row", lines_of(F.col("text")).alias("l")).where(F.size("l") >= window)
    found = found.select("id", "row", F.inline(F.transform(F.sequence(F.lit(0), F.size("l") - window), at))).where("seen").drop("seen")
    found, _ = stored(found)  # a few bytes for each line; read three times
    place = F.struct("id", "row", "pos")
    grouped = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("size"))
    firsts, _ = stored(grouped.where("first <> last").drop("last"))
    removed = (
        join_skewed(found, firsts, ["h", "g"], "size").where(place != F.col("first"))
        .groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    )
    out = keyed.join(removed, ["id", "row"], "left").withColumn("lines", lines_of(F.col("text")))
    n = F.size("lines")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("at", lambda p: p + window)),
        F.concat(F.col("at"), F.array(n)),
        lambda a, b: F.slice(F.col("lines"), a + 1, F.greatest(b - a, F.lit(0))),
    )
    kept = F.when(F.col("at").isNull(), F.col("lines")).otherwise(F.flatten(gaps))
    out = out.withColumn("kept", kept)
    whole = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return out.select(
        *(whole.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in other),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("__n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("__n_removed"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, row_number() OVER (PARTITION BY ls[i + 1], ls[i + 2], ls[i + 3] ORDER BY doc_id, i) AS k
      FROM l, unnest(range(0, len(ls) - 2)) AS t(i)
      WHERE regexp_matches(ls[i + 1] || ls[i + 2] || ls[i + 3], '\\S')),
covered AS (SELECT DISTINCT doc_id, pos + d AS line FROM w, unnest([0, 1, 2]) AS t(d) WHERE k > 1),
each AS (SELECT l.doc_id, i AS line, ls[i + 1] AS s, c.line IS NOT NULL AS gone
         FROM l, unnest(range(0, len(ls))) AS t(i) LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.line = i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM each GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
