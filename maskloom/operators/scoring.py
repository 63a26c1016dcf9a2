"""Model scoring that resumes (inventory N4).

Each distinct chunk is scored once.  Results stand in a Parquet store, one
folder a model, that outlives the job; a job scores only the chunks the store
has no result for, in parts by the chunk's digest, each part its own write.  A
job that ends early leaves the parts it wrote, and the next one goes on there.

The store is append-only.  A chunk whose model call failed is kept with its
error and scored again by the next job; of several rows of a chunk a result
goes before an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .ner import score_chunks

STORE_SCHEMA = "digest string, response string, error string"
#: Parts of a job, by the first hex digit of the digest.
PARTS = tuple("0123456789abcdef")
#: A chunk that stands in very many rows meets its result once for each of these.
SALTS = 64


def _digest(chunk: Column) -> Column:
    """The sha256 of a chunk; a null chunk has one of its own."""
    return F.sha2(F.coalesce(F.concat(F.lit("="), chunk), F.lit("")), 256)


def read_scores(spark: SparkSession, path: str, model_name: str) -> DataFrame:
    """``digest, response, error`` of the chunks that ``model_name`` was asked, one row each."""
    try:
        rows = spark.read.schema(STORE_SCHEMA).parquet(_folder(path, model_name))
    except Exception as exc:
        if not any(x in str(exc) for x in ("PATH_NOT_FOUND", "does not exist")):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)
    best = F.min_by(F.struct("response", "error"), F.struct(F.col("error").isNotNull(), "response", "error"))
    return rows.groupBy("digest").agg(best.alias("r")).select("digest", "r.response", "r.error")


def _folder(path: str, model_name: str) -> str:
    if not model_name.replace("-", "").replace("_", "").replace(".", "").isalnum() or model_name.startswith("."):
        raise ValueError("a model name holds letters, digits, '-', '_' and '.'")
    return f"{path.rstrip('/')}/{model_name}"


def score_missing(chunks: DataFrame, model: Callable[[str], str], path: str, model_name: str, text_col: str = "chunk") -> int:
    """Score the distinct chunks that the store has no result for; how many there were."""
    spark = chunks.sparkSession
    distinct = chunks.select(F.col(text_col).alias("chunk")).distinct().withColumn("digest", _digest(F.col("chunk")))
    known = read_scores(spark, path, model_name).where("error is null").select("digest")
    part = F.substring("digest", 1, 1)
    todo = stored(distinct.join(known, "digest", "left_anti").withColumn("part", part), "chunks_to_score")
    counts = {r.part: r["count"] for r in todo.groupBy("part").count().collect()}  # 16 rows
    for p in PARTS:
        if p in counts:
            some = todo.where(F.col("part") == p).drop("part").repartition("digest")
            scored = score_chunks(some, model, ["digest"], passthrough=())
            scored.select("digest", "response", "error").write.mode("append").parquet(_folder(path, model_name))
    return sum(counts.values())


def score_chunks_stored(
    chunks: DataFrame, model: Callable[[str], str], key_cols: Sequence[str], path: str, model_name: str,
    text_col: str = "chunk", passthrough: Sequence[str] = ("offset",),
) -> DataFrame:
    """N4 over a store: the rows of :func:`ner.score_chunks`, every distinct chunk scored once and none that the
    store at ``path`` already has from ``model_name`` (a changed model or prompt wants another name).

    Null chunks and repeated rows are scored and returned like any other; no
    rows give no rows.  Results come back to the chunks by digest and a salt,
    so a chunk that stands in a third of all rows is split.
    """
    score_missing(chunks, model, path, model_name, text_col)
    keys = list(key_cols) + [c for c in passthrough if c in chunks.columns]
    row = F.struct(*(F.col(f"`{c}`") for c in [*keys, text_col])).alias("row")
    rows = chunks.select(row, _digest(F.col(f"`{text_col}`")).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    rows = stored(rows, "chunks_by_digest")
    pairs = rows.select("digest", "salt").distinct()
    answers = pairs.join(read_scores(chunks.sparkSession, path, model_name), "digest")
    return rows.join(answers, ["digest", "salt"]).select("row.*", "response", "error")
