"""The committed vault: jobs that run again, attempts that died, partitions that are read."""

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import jobs, mask, restore, vault
from maskloom.session import scratch_path


def entities(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")).alias("span"), F.lit("EMAIL").alias("type"))


def test_a_job_that_runs_again_adds_no_row(spark):
    v = vault.CommittedVault(spark, scratch_path(spark, "cv"))
    assert v.rows().count() == 0 and v.jobs().count() == 0
    _, delta = vault.plan_tokens(entities(spark, 50), "s", v)
    assert v.commit(delta, "a", "s") and not v.commit(delta, "a", "s")
    first = sorted(map(tuple, v.rows().collect()))
    assert len(first) == 50
    _, again = vault.plan_tokens(entities(spark, 60), "s", v)
    assert again.count() == 10  # only what is new
    assert not v.commit(again, "a", "s") and v.commit(again, "b", "s")
    assert v.rows().count() == 60 and sorted(r.job for r in v.jobs().collect()) == ["a", "b"]
    assert set(first) <= set(map(tuple, v.rows().collect()))


def test_rows_of_an_attempt_without_entry_are_not_seen(spark):
    path = scratch_path(spark, "cv")
    v = vault.CommittedVault(spark, path)
    _, delta = vault.plan_tokens(entities(spark, 20), "s", v)
    lost = delta.select("*", F.lit("lost").alias("attempt"), vault.token_prefix(F.col("token")).alias("prefix"))
    lost.write.mode("append").partitionBy("prefix").parquet(path)  # as if the job had died before its entry
    assert v.rows().count() == 0
    assert v.commit(delta, "a", "s") and v.rows().count() == 20


def test_a_job_reads_the_partitions_of_its_values(spark):
    v = vault.CommittedVault(spark, scratch_path(spark, "cv"))
    v.commit(vault.plan_tokens(entities(spark, 400), "s", v)[1], "a", "s")
    known = v.known(entities(spark, 2), "s")
    assert set(r.original for r in known.collect()) >= {"u0@x.org", "u1@x.org"} and known.count() < 40
    plan = known._jdf.queryExecution().executedPlan().toString()
    partitions = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "prefix" in partitions and partitions.count(",") <= 3  # two values and the losers


def test_collision_losers_are_found_again(spark, monkeypatch):
    monkeypatch.setattr(C, "TOKEN_HEX_LEN", 2)  # 256 tokens: losers in every job
    v = vault.CommittedVault(spark, scratch_path(spark, "cv"))
    docs = spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(80)], "doc_id long, text string")
    masked, delta = jobs.mask_job(docs, ["doc_id"], "s", prior_vault=v)
    v.commit(delta, "a", "s")
    assert v.rows([vault.LOSERS]).count() > 0
    more = docs.unionByName(spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(80, 160)], docs.schema))
    masked2, delta2 = jobs.mask_job(more, ["doc_id"], "s", prior_vault=v)
    v.commit(delta2, "b", "s")
    assert delta2.count() == 80 and v.rows().select("token").distinct().count() == v.rows().count() == 160
    before = {r.doc_id: r.masked for r in masked.collect()}
    after = {r.doc_id: r.masked for r in masked2.collect()}
    assert all(after[i] == before[i] for i in before) and len(set(after.values())) == 160


def test_round_trip_over_a_committed_vault(spark):
    v = vault.CommittedVault(spark, scratch_path(spark, "cv"))
    docs = spark.createDataFrame([(1, "a@b.com 10.0.0.1"), (None, "a@b.com")], "doc_id long, text string")
    masked, delta = jobs.mask_job(docs, ["doc_id"], "s", prior_vault=v)
    v.commit(delta, "a", "s")
    back = restore.unmask_text(masked, "masked", ["doc_id"], v.rows())
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select("doc_id", F.col("text").alias("restored")).collect()))
    assert mask.entities_of(masked, ["doc_id"]).count() == 3
