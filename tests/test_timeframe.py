from datetime import date, datetime

import pytest

from earshot.plans.buckets import bucket_days
from earshot.plans.timeframe import Timeframe, add, bucket_starts, calendar_weeks, truncate

NOW = datetime(2024, 3, 13, 15, 30)


@pytest.mark.parametrize(
    "args,want",
    [
        ({"start": datetime(2024, 1, 5), "stop": datetime(2024, 1, 9), "year": 2020}, (datetime(2024, 1, 5), datetime(2024, 1, 9))),
        ({"year": 2024, "month": 2, "week": 9}, (datetime(2024, 2, 1), datetime(2024, 3, 1))),
        ({"year": 2020, "week": 53}, (datetime(2020, 12, 28), datetime(2021, 1, 4))),
        ({"year": 2024, "week": 1}, (datetime(2024, 1, 1), datetime(2024, 1, 8))),
        ({"year": 2023, "period": "day"}, (datetime(2023, 1, 1), datetime(2024, 1, 1))),
        ({"period": "day"}, (datetime(2024, 3, 13), datetime(2024, 3, 14))),
        ({"period": "week"}, (datetime(2024, 3, 11), datetime(2024, 3, 18))),
        ({"period": "month"}, (datetime(2024, 3, 1), datetime(2024, 4, 1))),
        ({"period": "year"}, (datetime(2024, 1, 1), datetime(2025, 1, 1))),
        ({}, (datetime(1970, 1, 1), datetime(2024, 3, 14, 15, 30))),
        ({"period": "month", "tz": "America/New_York"}, (datetime(2024, 3, 1, 5), datetime(2024, 4, 1, 4))),
    ],
)
def test_resolve(args, want):
    t = Timeframe.resolve(NOW, **args)
    assert (t.start, t.stop) == want


def test_before_has_the_same_length():
    t = Timeframe(datetime(2024, 1, 10), datetime(2024, 1, 15))
    assert t.before() == Timeframe(datetime(2024, 1, 5), datetime(2024, 1, 10))


def test_months_are_added_to_the_last_bucket():
    assert [b.date() for b in bucket_starts(datetime(2024, 1, 31), datetime(2024, 4, 1), "month")] == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 29)]
    assert bucket_starts(datetime(2024, 1, 2), datetime(2024, 1, 1), "day") == []
    assert add(datetime(2024, 2, 29), "year") == datetime(2025, 2, 28)


def test_truncate_and_weeks():
    assert truncate(NOW, "week") == datetime(2024, 3, 11) and truncate(NOW, "year") == datetime(2024, 1, 1)
    weeks = calendar_weeks(date(2024, 1, 3), date(2024, 1, 9))
    assert [w[0] for w in weeks] == [date(2024, 1, 1), date(2024, 1, 8)]


def test_bucket_days_cover_each_day_once(spark):
    rows = bucket_days(spark, datetime(2023, 10, 31), datetime(2024, 4, 15), "month").collect()
    assert len({r.shifted_day for r in rows}) == len(rows)
