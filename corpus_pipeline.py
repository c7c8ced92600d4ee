"""Pipeline from documents to token ids: language ID, line dedup, MinHash near-dedup, benchmark
decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept.
All but the last return the columns of ``docs``; further columns travel along. A column named
n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.functions.exprs import free_name
from colsight.llm import shared
from colsight.llm.bpe import bpe, vocabulary_path
from colsight.llm.decontamination import contaminated
from colsight.llm.language_id import UNDECIDED, identify
from colsight.llm.line_dedup import kept_text, line_decisions
from colsight.llm.minhash_dedup import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is missing or has no letter are rejected and go."""
    return identify(docs).filter(F.col("lang_pred") != UNDECIDED).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines or more are deleted; a document of which no line is
    left goes."""
    decided = line_decisions(docs)
    gone = F.coalesce(F.size("deleted"), F.lit(0))
    decided = decided.filter((gone == 0) | (gone < F.size("lines")))
    text = kept_text()
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        counted = F.when(gone == 0, F.col("row.n_chars")).otherwise(F.length(text)).cast(kind)
        new["n_chars"] = counted.alias("n_chars")
    return decided.select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with
    the smallest doc_id stays; a missing doc_id is larger than all others. A document is a doc_id
    with its text: rows without doc_id, or with the same one, that differ in their texts are
    documents of their own, and rows that repeat both stay or go together."""
    row = free_name(docs.columns, "row")
    numbered = shared.written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_dedup(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(shared.NO_ID))
    ids = numbered.select(row, F.struct(number.alias("id"), F.unhex(F.md5(shared.text_or_empty())).alias("digest")).alias("at"))
    placed = shared.written(groups.join(ids, row))
    stays = placed.groupBy("component_id").agg(F.min("at").alias("stays"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    dropped = placed.join(stays, "component_id").filter("at <> stays").select(F.col(row).alias("dropped"))
    kept = numbered.join(shared.bounded(shared.written(dropped)), numbered[row] == F.col("dropped"), "left_anti")
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Every row is judged by its own text, whatever
    its doc_id."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them. Rows
    with a missing or repeated doc_id are encoded like all others."""
    out = bpe(docs, vocabulary_path())
    return out.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: SQL cannot say language ID and BPE; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
