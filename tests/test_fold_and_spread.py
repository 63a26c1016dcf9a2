"""The literal fold with few and with many pairs; records are spread over more tasks than splits."""

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.plans import inputs


def test_few_and_many_pairs_fill_alike(spark):
    for n in (1, C.FEW_PAIRS, C.FEW_PAIRS + 1, 300):
        names = [f"<{i}>" for i in range(n)]
        pairs = [(x, "\ue000\ue010\ue001" if i == n - 1 else f"[{i + 1}]<{i + 1}>") for i, x in enumerate(names)]
        text = "a" + "b".join(names) + "c"
        df = spark.createDataFrame([(text, pairs), (None, pairs), ("none", pairs)], "t string, p array<struct<span:string,repl:string>>")
        want = "a" + "b".join(r for _, r in pairs) + "c"
        assert [r.o for r in df.select(C.literal_replace("t", F.col("p")).alias("o")).collect()] == [want, None, "none"]


def test_records_get_more_tasks_than_splits(spark, tmp_path):
    # before, a table of as many splits as slots stayed as it was, however few of them held rows
    slots = spark.sparkContext.defaultParallelism
    orders = spark.range(0, 4000, 1, slots).selectExpr("id as o_orderkey", "id as o_custkey", "1.5D as o_totalprice", "timestamp'2024-01-02 03:04:05' as o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    splits = inputs.table(spark, str(tmp_path), "orders").rdd.getNumPartitions()
    texts = inputs.pii_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() == max(slots, inputs.RECORD_TASKS * splits) and texts.count() == 4000
