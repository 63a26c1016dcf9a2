"""Tokens of a chosen length: more values than tokens of that length."""

from pyspark.sql import functions as F

from maskloom.operators import strategies, vault


def test_more_values_than_tokens(spark):
    new = spark.range(40).select(F.concat(F.lit("__MASKED_x_"), (F.col("id") % 16).cast("string"), F.lit("__")).alias("token"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("original"), F.lit("X").alias("entity_type"))
    done = vault.resolve_collisions(new, "s", hex_len=1)  # 16 tokens of one digit
    assert done.count() == done.select("token").distinct().count() == done.select("original").distinct().count() == 40


def test_more_words_than_masks(spark):
    occ = spark.range(40).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("span"))
    none = spark.createDataFrame([], "original string, replacement string, priority long")
    got = strategies.custom_delta(occ, none, "s", 1)
    assert got.count() == got.select("replacement").distinct().count() == 40
