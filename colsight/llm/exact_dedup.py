"""Exact dedup with a heavy-hitter split.

Texts are reduced to SHA-256 digests in one scan. Misra-Gries counters (``freqItems``) name
every digest that may hold more than ``support`` of the rows; an exact count over those
candidates verifies them and finds the winner of each. The verified winners, at most
``1 / support`` rows, are broadcast, so copies of a frequent text are settled on the map side
and never meet in one task. All other digests are counted and joined by ordinary shuffles, in
which no digest holds more than ``support`` of the rows. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared

SUPPORT = 1e-3


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Returns a row per input row: doc_id, keep_id (doc_id of the row that stays), group_size,
    kept, text_sha256. A missing text counts as empty. A missing doc_id is smaller than any
    other: such a row stays only if its whole group has none, and then keep_id is missing and
    kept is true. Repeated rows of the winning doc_id are all kept, as an id names one document.
    ``support`` (at least 0.0001) bounds the broadcast winners by ``1 / support`` rows.
    """
    digest = F.unhex(F.sha2(shared.text_or_empty(), 256))
    digests = shared.written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest")))
    frequent = digests.select(F.hex("digest").alias("digest")).freqItems(["digest"], support)
    suspects = frequent.select(F.explode("digest_freqItems").alias("item")).select(F.unhex("item").alias("digest"))
    rows = digests.count()

    def groups(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    heavy = groups(digests.join(F.broadcast(suspects), "digest", "left_semi")).filter(F.col("group_size") > support * rows)
    heavy = shared.written(heavy)
    found = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = found.unionByName(rest.join(groups(rest), "digest"))
    return settled.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
