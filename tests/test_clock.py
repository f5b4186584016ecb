from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echolens.functions import clock

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-15T12:00:00Z", datetime(2024, 1, 15, 12)),
        ("2024-01-15T12:00:00+00:00", datetime(2024, 1, 15, 12)),
        ("2024-01-15T12:00:00.5+02:00", datetime(2024, 1, 15, 10, 0, 0, 500_000)),
        ("2024-01-15T12:00:00", datetime(2024, 1, 15, 12)),
        ("2024-01-15", datetime(2024, 1, 15)),
        ("soon", NOW),
        (None, NOW),
    ],
)
def test_iso_text(spark, zone, text, expected):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.createDataFrame([(text, 86_400.5)], "t string, s double")
        got = row.select(clock.iso_or_now(F.col("t"), NOW), clock.epoch(F.col("s"))).first()
        assert tuple(got) == (expected, datetime(1970, 1, 2, 0, 0, 0, 500_000))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_windows(spark):
    row = spark.range(1).select(
        clock.days_before_midnight(7, datetime(2024, 1, 31, 15)),
        clock.days_before_now(7, datetime(2024, 1, 31, 15)),
        clock.days_before_midnight(0) <= clock.now(),
        clock.days_before_now(1) < clock.now(),
        clock.age_in_days(clock.timestamp(datetime(2024, 2, 5)), NOW),
        clock.age_in_days(clock.timestamp(datetime(2024, 1, 30, 12)), NOW),
    ).first()
    assert tuple(row) == (datetime(2024, 1, 24), datetime(2024, 1, 24, 15), True, True, 0.0, 0.5)
