import pytest
from pyspark.sql import functions as F

from epochwright.functions import labels
from epochwright.functions.arrays import argmax, half_even

CASES = [
    ("Sleep stage W", 0), ("Sleep stage 1", 1), ("Sleep stage 2", 2), ("Sleep stage 3", 3),
    ("Sleep stage 4", 3), ("Sleep stage R", 4), ("Sleep stage ?", None), ("Movement time", None),
    ("unknown label", None), ("", None), (None, None), ("  Sleep stage 2\n", 2),
    ("\tSleep stage R\r\n", 4), ("sleep stage 2", None),
]


def test_map_annotation(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", labels.map_annotation(F.col("t")).alias("s")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(CASES)}


@pytest.mark.parametrize(
    "stem, want",
    [
        ("SC4001E0", ("SC00", 1)),
        ("SC4451E0", ("SC45", 1)),
        ("SC4822G0", ("SC82", 2)),
        ("not-a-stem", (None, None)),
        ("ST7011J0", (None, None)),
        ("SC4001E", (None, None)),
        ("SC4001E00", (None, None)),
    ],
)
def test_parse_stem(spark, stem, want):
    subject, night = labels.parse_stem(F.lit(stem))
    assert tuple(spark.range(1).select(subject, night).first()) == want


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (2.4999, 2)], "x double, y long")
    assert df.filter(half_even(F.col("x")) != F.col("y")).isEmpty()


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.5, 0.5, 0.0],)], "p array<double>")
    assert [r[0] for r in df.select(argmax(F.col("p"))).collect()] == [1, 0]


def test_texts(spark):
    df = spark.createDataFrame([(62.5, 2.5), (66.667, None)], "e double, o double")
    rows = df.select(labels.efficiency_text(F.col("e")), labels.onset_text(F.col("o"))).collect()
    assert [tuple(r) for r in rows] == [("62%", "2 min"), ("67%", "—")]


def test_agreement_bands(spark):
    df = spark.createDataFrame(
        [(-0.1, "poor"), (0.0, "slight"), (0.2, "slight"), (0.21, "fair"), (0.694, "substantial"),
         (1.0, "almost perfect"), (float("nan"), None)],
        "k double, want string",
    )
    got = df.withColumn("got", labels.agreement_band(F.col("k")))
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).isEmpty()
