"""Line dedup by winnowing over line hashes.

Every window of ``window`` consecutive lines selects its smallest line hash as fingerprint,
so two places that share such a run share a selected fingerprint. Fingerprints are joined
over their positions: only those selected at two places are followed up. Matches are then
extended over the lines before and after: each window that selected a shared fingerprint is
compared as a whole by a 128-bit hash of its lines, and windows that occurred earlier join to
maximal repeated runs, which are deleted.

All steps are Spark functions. Counts are combined before each shuffle, so a line in a third
of all documents is one row per task; joins on hot lines are left to adaptive execution, which
can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared

WINDOW = 3


def _windows(one: Column, two: Column, window: int) -> Column:
    """Array of (line, at, print, one, two) of all windows of a document. The shifted copies
    are arguments of ``arrays_zip``, so the hashes are computed once and not per element."""
    n = F.size(one) - (window - 1)
    shifted = [F.slice(h, k + 1, n) for h in (one, two) for k in range(window)]

    def pick(x: Column, i: Column) -> Column:
        piece = F.array(*[x[str(k)] for k in range(window)])
        least = F.array_min(piece)
        return F.struct(
            i.alias("line"),
            (i + F.array_position(piece, least).cast("int") - 1).alias("at"),
            least.alias("print"),
            F.xxhash64(piece).alias("one"),
            F.xxhash64(F.array(*[x[str(k)] for k in range(window, 2 * window)])).alias("two"),
        )

    return F.transform(F.arrays_zip(*shifted), pick)


def line_decisions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, lines, deleted): each input row as a struct, its lines, and the numbers (from 0)
    of the lines to delete, missing if there are none. See ``line_dedup``."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(shared.NO_ID))
    body = F.xxhash64(text)
    lines = F.split(text, "\n", -1)
    one = F.transform(lines, lambda x: F.xxhash64(x))
    two = F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x))
    hashed = docs.select(doc.alias("doc"), body.alias("body"), one.alias("one"), two.alias("two"))
    hashed = hashed.filter(F.size("one") >= window)
    windows = shared.written(hashed.select("doc", "body", _windows(F.col("one"), F.col("two"), window).alias("w")))

    prints = F.array_distinct(F.transform("w", lambda x: F.struct(x["print"].alias("print"), x["at"].alias("at"))))
    chosen = windows.select(F.explode(prints).alias("p")).groupBy("p.print").agg(F.count(F.lit(1)).alias("n"))
    joint = chosen.filter(F.col("n") > 1).select("print")
    places = windows.select("doc", "body", F.explode("w").alias("w")).select("doc", "body", "w.line", "w.print", "w.one", "w.two")
    around = places.join(joint, "print", "left_semi")
    first = around.groupBy("one", "two").agg(F.min(F.struct("doc", "line")).alias("first"))
    later = around.join(first, ["one", "two"]).filter(F.struct("doc", "line") > F.col("first"))
    run = F.explode(F.sequence(F.col("line"), F.col("line") + (window - 1)))
    gone = later.select("doc", "body", run.alias("line")).groupBy("doc", "body").agg(F.collect_set("line").alias("deleted"))
    rows = docs.select(F.struct("*").alias("row"), doc.alias("doc"), body.alias("body"), lines.alias("lines"))
    return rows.join(gone, ["doc", "body"], "left").select("row", "lines", "deleted")


def kept_text() -> Column:
    """Text of the lines that stay, over the columns of ``line_decisions``."""
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("deleted"))
    joined = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return F.when(F.col("deleted").isNull(), F.col("row.text")).otherwise(joined)


def line_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Delete lines of runs of ``window`` or more lines that occurred before.

    A window of lines is a later repeat if the same lines also start at a smaller (doc_id,
    line number), in another document or further up in the same one. Returns a row per input
    row: doc_id, n_lines, n_deleted, text (missing if the input is). Lines end at a newline and
    are compared as they are; an empty text is one empty line, a missing text has no line. A
    missing doc_id counts as larger than any other. Rows with equal doc_id are ordered by line
    number alone. Other columns are not looked at.
    """
    out = line_decisions(docs.select("doc_id", "text"), window)
    return out.select(
        "row.doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).cast("bigint").alias("n_deleted"),
        kept_text().alias("text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, runs of three lines or more."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM l
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, first_value(doc_id) OVER p AS fd, first_value(i) OVER p AS fi FROM w WHERE c IS NOT NULL
      WINDOW p AS (PARTITION BY a, b, c ORDER BY doc_id, i)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM f WHERE fd < doc_id OR (fd = doc_id AND fi < i)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM l ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_deleted,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
