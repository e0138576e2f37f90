import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from redline.functions import kernels as K, text as T, values as V
from redline.functions import geometry as G


def one(spark, value, f, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [(None, ""), ("Ａ　 b\r\n\n\nc ", "A b\nc"), ("\t x  y", "x y"), ("", "")])
def test_normalize_text(spark, raw, want):
    got = one(spark, raw, T.normalize_text)
    assert got == want
    assert one(spark, got, T.normalize_text) == got


@pytest.mark.parametrize("raw, want", [
    ("| a | b |\n|---|:--:|\n| 1 |  |", "a | b\n1"), ("a\tb\nc\t d  e ", "a | b\nc | d e"), ("x\n\n | \n", "x"), (None, ""), ("a | b", "a | b"),
])
def test_normalize_table_text(spark, raw, want):
    got = one(spark, raw, T.normalize_table_text)
    assert got == want
    assert one(spark, got, T.normalize_table_text) == got


@pytest.mark.parametrize("line, number, level", [
    ("第三条 付款", "三", 1), ("第12章", "12", 1), ("3.2 交货", "3.2", 2), ("3.2.1、验收", "3.2.1", 3), ("（四）其他", "四", 3), ("二、质量", "二", 2), ("7. 违约", "7", 2), ("100.5元", "100", 2), ("3.2. x", "3", 2),
])
def test_detect_number(spark, line, number, level):
    got = one(spark, line, T.detect_number)
    assert (got["number"], got["level"]) == (number, level)


def test_detect_number_none(spark):
    assert one(spark, "第三条正文", T.detect_number) is None
    assert one(spark, "正文", T.detect_number) is None


@pytest.mark.parametrize("line, key", [("甲方（签字/盖章）：", "甲方"), ("联系电话：1", "电话"), ("账 号:5", "账号"), ("统一社会信用代码/身份证号：9", "统一社会信用代码"), ("签订日期: 2026", "日期")])
def test_detect_field(spark, line, key):
    assert one(spark, line, T.detect_field)["field_key"] == key


def test_no_field(spark):
    assert one(spark, "付款方式：电汇", T.detect_field) is None
    assert one(spark, "付款方式：电汇", T.detect_section) == "付款方式"
    assert one(spark, "付款方式说明", T.detect_section) is None


def test_starts_with_number(spark):
    df = spark.createDataFrame([("3.2交货", "3.2", True), ("3.21交货", "3.2", False), ("4交货", "3", False), ("3a", "3", False)], "c string, n string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.starts_with_number(F.col("c"), F.col("n"))).collect())


def test_values(spark):
    text = "支付￥1,000.5万元,于2026年6月30日前,比例 12.5 %,逾期30日支付违约金,提交仲裁"
    got = {e["kind"]: list(e["vals"]) for e in one(spark, one(spark, text, T.normalize_text), V.elements)}
    assert {"¥1,000.5万元", "1,000.5万元"} <= set(got["amount"]) or {"￥1,000.5万元", "1,000.5万元"} <= set(got["amount"])
    assert {"2026年6月30日", "30日", "6月"} <= set(got["date"])
    assert got["ratio"] == ["12.5%"] and got["breach"] == ["违约"] and got["jurisdiction"] == ["仲裁"]


@settings(max_examples=60, deadline=None)
@given(st.text("abc\n", max_size=30), st.text("abc\n", max_size=30))
def test_segments_rebuild(a, b):
    s = K.segments(a, b)
    assert "".join(x["text"] for x in s if x["op"] != "insert") == a
    assert "".join(x["text"] for x in s if x["op"] != "delete") == b


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=25), st.text("abcd", max_size=25))
def test_longest_common_substring(a, b):
    want = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
    assert K.longest_common_substring(a, b) == want


def test_row_segments_rebuild():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([" | ".join(rng.choice("xyz") for _ in range(3)) for _ in range(rng.randint(0, 6))] for _ in range(2))
        s = K.row_segments(a, b)
        left = "".join(x["text"] for x in s if x["op"] != "insert").split("\n")
        assert [x for x in left if x][: len(a)] == a or len(a) != len(b)


def test_signature():
    import hashlib
    import hmac

    body = b'{"a":1}'
    sign = hmac.new(b"k", body, hashlib.sha256).hexdigest()
    assert K.verify_signature("k", body, sign) and not K.verify_signature("k", body + b" ", sign)


@pytest.mark.parametrize("box, want", [([120.0, 240.0, 360.0, 480.0], None), ([0.1, 0.2, 0.5, 0.8], [60, 160, 300, 640]), ([100.0, 200.0, 500.0, 800.0], [60, 160, 300, 640]), ([1200.0, 1000.0, 2400.0, 2000.0], [600 * 1200 / 1654, 800 * 1000 / 2339, 600 * 2400 / 1654, 800 * 2000 / 2339]), ([1.0], [])])
def test_to_points(spark, box, want):
    got = one(spark, box, lambda c: G.to_points(c, F.lit(600.0), F.lit(800.0), F.lit(1654.0), F.lit(2339.0)), "array<double>")
    assert want is None or got == pytest.approx(want)


def test_region_and_cosine(spark):
    assert one(spark, [700.0, 900.0, 300.0, -5.0], lambda c: G.region(c, F.lit(600.0), F.lit(800.0)), "array<double>") == pytest.approx([0.5, 0, 1, 1])
    assert one(spark, [5.0, 5.0, 5.0, 9.0], lambda c: G.region(c, F.lit(600.0), F.lit(800.0)), "array<double>") is None
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], 0.70710678), ([], [1.0], 0.0), ([0.0], [1.0], 0.0), ([1.0, 2.0, 9.0], [1.0, 2.0], 1.0)], "a array<double>, b array<double>, want double")
    for r in df.withColumn("got", G.cosine(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"])
