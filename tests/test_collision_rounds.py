"""Rounds that settle collisions: few contested rows, so the tokens given away are not shuffled."""

from pyspark.sql import functions as F

from maskloom.operators import vault
from maskloom.session import stored


def test_taken_tokens_stay_where_they_are(spark):
    taken = stored(spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("token")), "taken")
    todo = stored(taken.where("token in ('t7', 't8')").select("token", F.lit("a").alias("original"), F.lit("X").alias("entity_type")), "todo")
    near = vault._among(taken, todo)
    assert sorted(r.token for r in near.collect()) == ["t7", "t8"]
    assert "hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()


def test_rounds_settle_every_row_once(spark):
    delta = spark.createDataFrame([("t1", c, "X") for c in "abc"] + [("t2", "d", "X"), ("t3", "e", "X")], "token string, original string, entity_type string")
    held = spark.createDataFrame([("t3", "z", "X")], "token string, original string, entity_type string")
    out = {r.original: r.token for r in vault.resolve_collisions(delta, "s", held).collect()}
    assert set(out) == set("abcde") and len(set(out.values())) == 5
    assert out["a"] == "t1" and out["d"] == "t2" and out["e"] not in ("t3", "t1", "t2")
