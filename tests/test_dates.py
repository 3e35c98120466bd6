from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assetloom.functions import dates


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    values = [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30, 0, 123456), datetime(1969, 12, 31, 23, 59, 59)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
        instant = dates.utc_instant(F.col("t"))
        rows = df.select(F.unix_micros(instant), dates.utc_naive(instant)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    epoch = datetime(1970, 1, 1)
    assert [r[1] for r in rows] == values
    assert [r[0] for r in rows] == [round((v - epoch).total_seconds() * 1_000_000) for v in values]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01T00:00:00", datetime(2024, 1, 1)),
        ("2024-01-01 05:30:00.5+00", datetime(2024, 1, 1, 5, 30, 0, 500000)),
        ("2024-01-01T05:30:00+02:00", datetime(2024, 1, 1, 3, 30)),
        ("2024-01-01", datetime(2024, 1, 1)),
        ("2024-01-01T05", datetime(2024, 1, 1, 5)),
        ("not a date", None),
        ("2024-13-01", None),
    ],
)
def test_parse_any_orders_both_forms_on_one_line(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.parse_any(F.col("t"))).first()[0] == expected


def test_iso_text_writes_a_fraction_only_when_there_is_one(spark):
    values = [datetime(2024, 1, 1, 1, 2, 3), datetime(2024, 1, 1, 1, 2, 3, 40)]
    df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
    assert [r[0] for r in df.select(dates.iso_text(F.col("t"))).collect()] == [v.isoformat() for v in values]
