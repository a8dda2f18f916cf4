"""Scalar functions on stated values."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions import scalars as S


def values(spark, rows, kind, expression):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, ["3", " 2.5 ", "x", None, "true", "NaN", ""], "string", S.number) == [3.0, 2.5, 0.0, 0.0, 1.0, 0.0, 0.0]
    cells = ["51,000,000,000원", "-", "24.35%", "약 12주", "없음", None, "0", "△5", "2025-12-31", ""]
    assert values(spark, cells, "string", S.parse_number) == [51e9, None, 24.35, 12.0, None, None, 0.0, 5.0, 2025.0, None]
    assert values(spark, ["1", "", None, "z"], "string", S.as_float) == [1.0, None, None, None]
    assert values(spark, [-1.0, 0.5, 7.0], "double", S.unit) == [0.0, 0.5, 1.0]


def test_bands_and_ladders(spark):
    assert values(spark, [75.0, 74.9, 55.0, 35.0, 34.9], "double", S.band) == ["urgent", "review", "review", "watch", "low"]
    assert values(spark, [100.0, 99.0, 9.0, None], "double", lambda x: S.ladder(x, ((100, 20), (50, 15), (10, 5)))) == [20.0, 15.0, 0.0, 0.0]


def test_names(spark):
    names = ["[기재정정] 주요사항보고서(전환사채권 발행결정)", "[첨부추가][x] a·b-c", "단일판매ㆍ공급계약체결", None, "　[기타]z "]
    assert values(spark, names, "string", S.compact_name) == ["주요사항보고서(전환사채권발행결정)", "abc", "단일판매공급계약체결", "", "z"]
    assert values(spark, names, "string", S.is_correction) == [True, True, False, False, False]


def test_formats(spark):
    assert values(spark, ["1234", "1234.5", "", None, "n/a"], "string", lambda x: S.format_number(x, "%")) == ["1,234%", "1,234.50%", "-", "-", "n/a"]
    assert values(spark, ["20240301", "20240229"], "string", lambda x: S.minus_days(x, 1)) == ["20240229", "20240228"]
    assert values(spark, [" a, ,b "], "string", S.csv_values) == [["a", "b"]]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0), ([0.0], [1.0], 0.0), ([], [], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0)])
def test_cosine(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(want)
