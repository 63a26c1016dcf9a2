"""Tables that grow with the corpus never pass through the driver."""

from pyspark.sql import functions as F

from maskloom.operators import strategies
from maskloom.session import stored


def test_known_texts_are_not_broadcast(spark):
    occ = stored(spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.concat(F.lit("w"), F.col("id") % 90).alias("span"), F.lit("PER").alias("type")), "occ")
    words = stored(spark.range(3).select(F.concat(F.lit("w"), "id").alias("original"), F.concat(F.lit("x"), "id").alias("replacement"), F.col("id").alias("priority")), "words")
    prior = stored(spark.range(2, 50).select(F.concat(F.lit("w"), "id").alias("original"), F.concat(F.lit("某人 "), F.col("id") + 5).alias("mask_text")), "prior")
    got = strategies.hybrid_mapping(occ, ["doc_id"], words, prior=prior)
    rows = {r.original: (r.mask_text, r.is_custom) for r in got.collect()}
    assert rows == {"w0": ("x0", True), "w1": ("x1", True)} | {f"w{i}": (f"某人 {i + 5}", False) for i in range(50, 90)}
    for df, known, col in ((words, prior, "original"), (occ, prior, "span"), (occ, words, "span")):
        # by its size as a file, each of these tables was sent to every task
        assert "Broadcast" not in strategies._without(df, known, col)._jdf.queryExecution().executedPlan().toString()
