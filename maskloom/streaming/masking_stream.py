"""Structured Streaming use of the mask job (P4, an extension of R1).

Texts arriving in micro-batches are masked with the same tokens a batch run
would give, and the vault grows by each batch's new entities.  Masking is
stateless per row; the only cross-batch state is the vault table, so
``foreachBatch`` does, per epoch: plan tokens against the vault that earlier
epochs have committed → commit this epoch's vault rows → write its masked texts.
The commit is once per epoch and the texts replace the epoch's own partition
(dynamic overwrite), so an epoch that runs again adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, vault


def mask_batch(spark: SparkSession, batch: DataFrame, epoch: int, text_col: str, id_cols: Sequence[str],
               salt: str, out_dir: str, vault_dir: str) -> None:
    """One micro-batch of the streaming mask job (idempotent per epoch).

    It reads the vault partitions of its own values only.  An epoch that runs
    again after its commit finds its values known, with the same tokens."""
    committed = vault.CommittedVault(spark, vault_dir)
    masked, delta = jobs.mask_job(batch, list(id_cols), salt, text_col, committed)
    committed.commit(delta, f"epoch-{epoch}", salt)
    masked.select(*id_cols, "masked", "n_entities").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("epoch").parquet(out_dir)


def run_mask_stream(spark: SparkSession, source: str, schema: str, text_col: str, id_cols: Sequence[str], salt: str,
                    out_dir: str, vault_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None = None) -> None:
    """Process everything available in ``source`` (Parquet files) and stop.

    ``checkpoint_dir`` must be in the cluster's shared folder: it records
    which files each epoch consumed, so a restarted query resumes exactly.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.parquet(source)

    def each(df: DataFrame, epoch_id: int) -> None:
        mask_batch(df.sparkSession, df, int(epoch_id), text_col, id_cols, salt, out_dir, vault_dir)

    q = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
