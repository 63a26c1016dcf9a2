"""The scan for runs: its classes of characters, and one scan of the runs a pattern needs."""

import re

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.functions.patterns import REGEX_REGISTRY

ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_.+-/:"
UNITS = "年月日元万亿美欧"


def test_classes_hold_the_same_characters(spark):
    points = [i for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    chars = spark.createDataFrame([(chr(i),) for i in points], "c string")
    digit = F.col("c").rlike(r"\A\p{Nd}\z")
    plain = F.col("c").isin([*(ASCII + UNITS)])
    wrong = chars.select(
        "c",
        (F.col("c").rlike(rf"(?s)\A[{C._SPAN_CHARS_PLAIN}]\z") != plain).alias("plain"),
        (F.col("c").rlike(rf"(?s)\A[{C._SPAN_CHARS}]\z") != (plain | digit | (F.col("c") == "@"))).alias("span"),
        (F.col("c").rlike(rf"(?s)\A[^{C._SPAN_CHARS}]\z") == (plain | digit | (F.col("c") == "@"))).alias("other"),
    ).where("plain or span or other")
    assert wrong.count() == 0


def test_each_pattern_scans_its_runs_at_once(spark):
    text = "，".join(["13800138001", "12元", "x@y.org", "1.2.3.4", "13900139001", "2024-01-02", "12:30", "6222020200112233", "1.2", "7亿元", "12元", "a@b.c"])
    df = spark.createDataFrame([(text,), (text.replace("，", " 𝟞 "),), (text.replace("，", "\n"),), (None,)], "text string")
    got = df.select("text", C.regex_entities("text").alias("e"))
    for r in got.collect():
        want = [(t, m.group()) for t, p in REGEX_REGISTRY.items() for m in re.finditer(p, r.text or "")]
        assert [(e.type, e.span) for e in r.e] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "flatten" not in plan and plan.count("array_join") == len(REGEX_REGISTRY)
