"""Plan-shape checks: JVM-only queries hold no Python node, every regex runs
once per scan, and results do not depend on the partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.patterns import REGEX_REGISTRY
from maskloom.operators import detect, mask, ner
from maskloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["mask_text", "mask_literal", "mask_spans", "detect_regex_entities", "chunk_text",
                                 "unmask_text", "round_trip", "mask_markdown", "strategy_context", "merge_detections"])
def test_no_python_in_jvm_queries(spark, key):
    plan = _plan(QUERIES[key](spark, SF))
    assert not any(n in plan for n in PYTHON_NODES), key


def test_python_only_in_model_hook(spark):
    assert any(n in _plan(QUERIES["score_chunks"](spark, SF)) for n in PYTHON_NODES)


def test_each_regex_once_per_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = _plan(mask.mask_text(docs, "text", ["doc_id"], "s"))
    # one scan of the text for its pieces, then each pattern on its runs (once more for the gaps where places are asked for)
    assert plan.count("regexp_extract_all") == len(REGEX_REGISTRY) + 1 and len(re.findall(r"regexp_extract_all\(_?text#", plan)) == 1
    plan = _plan(detect.detect_regex_entities(docs, "text", ["doc_id"]))
    assert plan.count("regexp_extract_all") == 2 * len(REGEX_REGISTRY) + 1 and len(re.findall(r"regexp_extract_all\(_?text#", plan)) == 1


def test_results_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    def digest(df):
        return sorted(tuple(r) for r in df.collect())
    for n in (1, 7):
        d = docs.repartition(n)
        assert digest(mask.mask_text(d, "text", ["doc_id"], "s").drop("entities")) == digest(
            mask.mask_text(docs, "text", ["doc_id"], "s").drop("entities"))
        assert digest(ner.chunk_text(d, "text", ["doc_id"])) == digest(ner.chunk_text(docs, "text", ["doc_id"]))
