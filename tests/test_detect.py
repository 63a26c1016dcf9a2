"""Golden regex vectors (FIXTURES §2) and offset laws."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import detect

VECTORS = [
    ("PHONE", "电话13800138000座机010-12345678，0101234567-8", ["13800138000", "010-12345678", "0101234567"]),
    ("ID", "ID 11010519900307123X, 110105199003071234", ["11010519900307123X", "110105199003071234"]),
    ("BANK", "卡6222020200112233 6222020200112233456", ["6222020200112233", "6222020200112233456"]),
    ("EMAIL", "a.b@c.com. x@y", ["a.b@c.com."]),
    ("IP", "1.2.3.4 999.999.999.999 1234.5.6.7 1.2.3.4.5", ["1.2.3.4", "999.999.999.999", "234.5.6.7", "1.2.3.4"]),
    ("DATE", "2024年1月2日 2024-01-02 2024/1/2 12024-1-2 2024年1月", ["2024年1月2日", "2024-01-02", "2024/1/2", "2024-1-2"]),
    ("TIME", "10:20:30 1:2 2001:10:20:30:40", ["10:20:30", "1:2", "01:10:20", "30:40"]),
    ("MONEY", "100万元 1,000元 5美元 5万美元 3.5亿元 2欧元 100日元", ["100万元", "000元", "5美元", "3.5亿元", "2欧元"]),
    ("PHONE", "１３８００１３８０００", []),
]


@pytest.mark.parametrize("etype,text,expected", VECTORS)
def test_golden_vectors(spark, etype, text, expected):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.span for r in detect.detect_type(df, "text", etype, ["doc_id"]).orderBy("seq").collect()]
    assert got == expected


def test_phone_and_email_overlap(spark):
    df = spark.createDataFrame([(1, "13800138000@qq.com")], "doc_id long, text string")
    rows = detect.detect_regex_entities(df, "text", ["doc_id"]).orderBy("seq").collect()
    assert [(r.type, r.span) for r in rows] == [("PHONE", "13800138000"), ("EMAIL", "13800138000@qq.com")]


def test_offsets_are_code_points(spark):
    text = "😀a 1.2.3.4 卡6222020200112233"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for r in detect.detect_regex_entities(df, "text", ["doc_id"]).collect():
        assert text[r.start:r.end] == r.span


def test_custom_pattern_registry_order():
    reg = detect.registry_with({"ORDERNO": r"订单\d+", "PHONE": r"\d{3}"})
    assert list(reg)[0] == "PHONE" and reg["PHONE"] == r"\d{3}" and list(reg)[-1] == "ORDERNO"


def test_guards_do_not_change_results(spark):
    # rows with and without digits, '@', ':' and '元'
    rows = [(1, "no digits here"), (2, "x@y.z 12:30 5元 2024-1-2 13800138000"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", C.regex_entities("text").alias("e")).orderBy("doc_id").collect()
    assert got[0].e == [] and got[2].e == [] and got[3].e == []
    assert [x.type for x in got[1].e] == ["PHONE", "EMAIL", "DATE", "TIME", "MONEY"]


def test_dedup_entities(spark):
    ents = spark.createDataFrame(
        [(1, 0, "PER", 0, 1, "a", 0.9), (1, 1, "PER", 2, 3, "b", 0.5), (1, 2, "PER", 4, 5, "a", 0.9)],
        "doc_id long, seq long, type string, start int, end int, span string, prob double",
    )
    out = detect.dedup_entities(ents, ["doc_id"]).orderBy("seq").collect()
    assert [(r.span, r.start) for r in out] == [("a", 0), ("b", 2)]


def test_filter_types_aliases(spark):
    ents = spark.createDataFrame([("人名",), ("地名",), ("XYZ",)], "type string")
    out = sorted(r.type for r in detect.filter_types(ents, ["PER", "LOC"]).collect())
    assert out == ["LOC", "PER"]
