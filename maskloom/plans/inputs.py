"""Inputs every registered query reads: the given tables, or tables Spark
derives from them.  Each Spark builder has its DuckDB twin (used by the
oracle SQL) right next to it so the two stay in step.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "s"  # test salt; production callers pass a secret



def spread(df: DataFrame) -> DataFrame:
    """Round-robin only when the scan has fewer splits than task slots.

    A table stored as one Parquet row group is one task however large its
    texts are.  On a cluster reading many files the scan already has more
    splits than slots and this is a no-op (no shuffle).  Where row groups are
    large, one split holds the rows of many and the others none: so a split of
    over ``TEXTS_A_TASK`` rows (counted from the files' footers) is dealt out too.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(max(slots, ceil(df.count() / TEXTS_A_TASK)))
    held = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    return df.repartition(max(slots, ceil(held["rows"] / TEXTS_A_TASK))) if (held["most"] or 0) > TEXTS_A_TASK else df


#: Tasks for each split of a table whose rows become texts: its rows are small, the work on each is not.
RECORD_TASKS = 8
#: Rows of such a table, and of a table of texts, that a task takes at most.
RECORDS_A_TASK, TEXTS_A_TASK = 100_000, 100_000


def spread_records(df: DataFrame) -> DataFrame:
    """Rows of a few numbers, from each of which a text is made, over ``RECORD_TASKS`` times the splits
    (the task slots at least), and no more than ``RECORDS_A_TASK`` to a task.

    A split holds millions of such rows and, where row groups are large, most
    splits hold none; so tasks would grow with the table.  Splits grow in
    number with it only beyond the size of one; so the rows are counted (from
    the files' footers).
    """
    splits, slots = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, RECORD_TASKS * splits, ceil(df.count() / RECORDS_A_TASK)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` from ``documents``."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` — one synthetic record per order that hits all 8 types."""
    o = spread_records(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    s = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("订单"), s("o_orderkey"),
        F.lit("于"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.lit("成交"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.lit("元，电话138"), F.lpad(s("o_custkey"), 8, "0"),
        F.lit("，证件"), F.lpad(s("o_custkey"), 17, "1"),
        F.lit("X，卡"), F.lpad(s("o_orderkey"), 16, "6"),
        F.lit("，邮箱u"), s("o_custkey"),
        F.lit("@mail.example.com，IP 10.0."), (F.col("o_orderkey") % 250).cast("string"),
        F.lit("."), (F.col("o_custkey") % 250).cast("string"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, doc_id, text``: documents plus the order records."""
    return documents(spark, sf_dir).select(F.lit("doc").alias("src"), "doc_id", "text").unionByName(
        pii_texts(spark, sf_dir).select(F.lit("ord").alias("src"), "doc_id", "text")
    )


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, md``: each document with every line break doubled (paragraphs)."""
    return documents(spark, sf_dir).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("md"))


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-list items: each document split by line; the first line is a title item.

    ``doc_id, item_idx, type, text, title, page``.
    """
    d = documents(spark, sf_dir)
    lines = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("item_idx", "line"))
    is_title = F.col("item_idx") == 0
    return lines.select(
        "doc_id",
        F.col("item_idx").cast("int").alias("item_idx"),
        F.when(is_title, F.lit("title")).otherwise(F.lit("text")).alias("type"),
        F.when(is_title, F.lit(None).cast("string")).otherwise(F.col("line")).alias("text"),
        F.when(is_title, F.col("line")).otherwise(F.lit(None).cast("string")).alias("title"),
        F.lit(1).alias("page"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------

DUCK_PII = """(SELECT o_orderkey AS doc_id, concat('订单', CAST(o_orderkey AS VARCHAR), '于',
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '成交', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR),
  '元，电话138', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '，证件', lpad(CAST(o_custkey AS VARCHAR), 17, '1'),
  'X，卡', lpad(CAST(o_orderkey AS VARCHAR), 16, '6'), '，邮箱u', CAST(o_custkey AS VARCHAR),
  '@mail.example.com，IP 10.0.', CAST(o_orderkey % 250 AS VARCHAR), '.', CAST(o_custkey % 250 AS VARCHAR)) AS text
  FROM orders)"""

DUCK_DOCS = "(SELECT doc_id, text FROM documents)"

DUCK_CORPUS = f"""(SELECT 'doc' AS src, doc_id, text FROM {DUCK_DOCS} d
  UNION ALL SELECT 'ord' AS src, doc_id, text FROM {DUCK_PII} p)"""

DUCK_MARKDOWN = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS md FROM documents)"
