"""Derived inputs shared by the Spark queries and their SQL counterparts.

The given tables hold no missing values, so some queries work on a copy with values
blanked out by a fixed rule. Every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_N = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_note",
]
EVENTS_N = [
    "event_id",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts",
    "user_id",
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value",
]
LINEITEM_DUP = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
ORDERS_GAP = [
    "o_orderkey",
    "o_totalprice",
    "CASE WHEN month(o_orderdate) IN (3, 7, 11) THEN NULL ELSE o_orderdate END AS o_orderdate",
]
MESSAGES = [
    "conv_id",
    "turn",
    "concat(text, ' ', CASE WHEN (conv_id + turn) % 4 = 0 THEN 'Why did o_orderstatus drop?' "
    "WHEN (conv_id + turn) % 4 = 1 THEN 'Forecast the O_TOTALPRICE' "
    "WHEN (conv_id + turn) % 4 = 2 THEN 'compare regions' ELSE 'hello' END) AS text",
]
EVENT_TEXTS = [
    "event_id",
    "event_type",
    "CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE substring(cast(ts AS {text}), 1, 10) END AS day",
    "CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE substring(cast(ts AS {text}), 1, 10) END AS broken_day",
    "CASE WHEN event_id % 6 = 0 THEN ' NA ' WHEN event_id % 6 = 1 THEN 'null' ELSE event_type END AS tagged",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    return read(spark, sf_dir, table).selectExpr(*[c.replace("{text}", "string") for c in columns])


def sql(table: str, columns: list[str]) -> str:
    return f"(SELECT {', '.join(c.replace('{text}', 'VARCHAR') for c in columns)} FROM {table})"


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(labels, "doc_id", "left")  # most documents have no label


DOC_LABELS_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
