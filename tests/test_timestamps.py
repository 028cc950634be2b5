from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idsync.operators.timestamps import compile_clock, compile_date, day_month_order, iso_instants, mask_of, normalise_timestamps, to_utc, tz_version, zone_table

V = tz_version()
ZONES = ["America/New_York", "Europe/Berlin", "Australia/Adelaide", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe"]


def iso(date, clock=None, zone=None, month_first=False):
    return iso_instants([date], [clock], [zone], np.array([month_first]), V)[0]


@pytest.mark.parametrize(
    "date, clock, zone, wanted",
    [
        ("2024-03-10", "02:30", "America/New_York", "2024-03-10T07:30:00.000Z"),  # skipped: moves on by an hour
        ("2024-11-03", "1:30 AM", "America/New_York", "2024-11-03T05:30:00.000Z"),  # twice: the first
        ("2024-11-03", "02:00", "America/New_York", "2024-11-03T07:00:00.000Z"),
        ("2024-03-10T03:00:00.000000", None, "America/Los_Angeles", "2024-03-10T10:00:00.000Z"),
        ("31-03-2024", "0200", "Europe/London", "2024-03-31T01:00:00.000Z"),
        ("2025-03-18T17:45:00+0900", None, "Europe/Berlin", "2025-03-18T08:45:00.000Z"),
        ("1641663000", None, None, "2022-01-08T17:30:00.000Z"),
        ("1641421810129", None, None, "2022-01-05T22:30:10.129Z"),
        ("Fri, 01 Apr 2022 15:00:00 +0300", None, None, "2022-04-01T12:00:00.000Z"),
        ("20220106T112500Z", None, None, "2022-01-06T11:25:00.000Z"),
        ("2022-01-03T14:40+09:00[Asia/Seoul]", "23:00", None, "2022-01-03T05:40:00.000Z"),
        ("2022-01-05T19:15:00.000000", None, "Europe/Berlin", "2022-01-05T18:15:00.000Z"),
        ("June 10, 2024", "3:15pm", "Asia/Tokyo", "2024-06-10T06:15:00.000Z"),
        ("13 NOV 1989", "0005", None, "1989-11-13T00:05:00.000Z"),
        ("2024-01-02", "12:10am", None, "2024-01-02T00:10:00.000Z"),
        ("2024-01-02", "18:15:00-0400", "Asia/Tokyo", "2024-01-02T22:15:00.000Z"),
        ("2024-01-02", "13:00 GMT", "Asia/Tokyo", "2024-01-02T13:00:00.000Z"),
        ("2024-01-02", "23.55", "No/Zone", "2024-01-02T23:55:00.000Z"),
        ("2024-01-02", "tbd", None, "2024-01-02"),
        ("2024-01-02", "25:99", None, "2024-01-02"),
        ("2024-01-02 25:00:00", None, None, "2024-01-02"),
        ("03-06-2023", None, None, "2023-06-03"),
        (" 2024/02/29 ", None, None, "2024-02-29"),
        ("2023-02-29", "10:00", None, None),
        ("2023-13-05", None, None, None),
        ("0000-00-00", "10:00", None, None),
        ("99-99-2024", None, None, None),
        ("31-31-1999", None, None, None),
        ("Foo 10, 2024", None, None, None),
        ("1969-07-01", "12:00", "America/New_York", "1969-07-01T16:00:00.000Z"),
        ("1875-01-01", "12:00", "America/New_York", "1875-01-01T16:56:02.000Z"),  # before time zones, the sun's time
        ("2101-07-01", "12:00", "America/New_York", "2101-07-01T16:00:00.000Z"),
        ("2733-07-01", "12:00", "America/New_York", "2733-07-01T16:00:00.000Z"),
        ("9999-01-01", "12:00", "America/New_York", "9999-01-01T17:00:00.000Z"),
        ("Wednesday, 24 September 2025 10:15:30.123456789[America/Argentina/ComodRivadavia]", None, None, "2025-09-24T13:15:30.123Z"),
        ("2025-09-24T10:15:30 [Europe/Paris]", None, None, "2025-09-24T08:15:30.000Z"),
        ("2025-09-24T10:15:30+02:00 [Europe/Paris]", None, "Asia/Tokyo", "2025-09-24T08:15:30.000Z"),
        ("2025-09-24T10:15:30Z[UTC]", None, "Asia/Tokyo", "2025-09-24T10:15:30.000Z"),
        (" " * 5000 + "2024-02-29" + " " * 5000, None, None, "2024-02-29"),
        ("", "10:00", None, None),
        (None, "10:00", None, None),
        ("tbc", None, None, None),
        ("9" * 100_000, None, None, None),
    ],
)
def test_notations(date, clock, zone, wanted):
    assert iso(date, clock, zone) == wanted


def test_month_first():
    assert iso("03-06-2023", month_first=True) == "2023-03-06"
    assert iso("2023/03/06", month_first=True) == "2023-03-06"


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(ZONES), st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)))
def test_local_times_against_the_zone_library(name, local):
    """fold=0 is the first of a doubled hour; for a skipped one it moves on by the gap."""
    wanted = local.replace(tzinfo=ZoneInfo(name), microsecond=0, fold=0).astimezone(timezone.utc)
    ms = np.array([int((local.replace(microsecond=0) - datetime(1970, 1, 1)) / timedelta(milliseconds=1))])
    got = to_utc(ms, np.array([name], object), V)[0]
    assert got == int(wanted.timestamp() * 1000)


@pytest.mark.parametrize("name", ZONES)
def test_around_every_change_of_a_zone(name):
    """Whole hours, minutes and seconds around all changes of some years."""
    starts, _ = zone_table(V, name)
    near = [int(s) + d * 1000 for s in starts[-60:-40] for d in (-7200, -3601, -3600, -1801, -1800, -1, 0, 1, 1799, 1800, 3600)]
    got = to_utc(np.array(near), np.array([name] * len(near), object), V)
    wanted = [int((datetime(1970, 1, 1) + timedelta(milliseconds=n)).replace(tzinfo=ZoneInfo(name), fold=0).astimezone(timezone.utc).timestamp() * 1000) for n in near]
    assert got.tolist() == wanted


def test_masks_compile_once():
    assert mask_of(np.array(["2024-03-01T10:05Z", "Mai"])).tolist() == ["9999-99-99A99:99A", "AAA"]
    assert compile_date("9999-99-99A99:99A") is compile_date("9999-99-99A99:99A")
    assert compile_date("A9A9") is None and compile_clock("99:99")[0] == "clock"


def test_order_of_day_and_month_per_source(spark):
    rows = [("x", "13-02-2020"), ("x", "01-02-2020"), ("x", "02-13-2020"), ("x", "14.02.2020"), ("y", "02/13/2020"), ("z", "01-01-2020"), (None, "02-13-2020"), ("y", None)]
    df = spark.createDataFrame(rows, "source string, d string")
    orders = day_month_order([(df, "d")], "source")
    got = {r[0]: r[1] for r in orders.collect()}
    assert got == {"x": False, "y": True, "z": False, None: True}
    out = normalise_timestamps(df.withColumn("__extra", df.d), "d", orders=orders, source="source")
    assert {(r.source, r.d, r.iso_value) for r in out.collect()} == {
        ("x", "13-02-2020", "2020-02-13"), ("x", "01-02-2020", "2020-02-01"), ("x", "02-13-2020", None), ("x", "14.02.2020", "2020-02-14"),
        ("y", "02/13/2020", "2020-02-13"), ("z", "01-01-2020", "2020-01-01"), (None, "02-13-2020", "2020-02-13"), ("y", None, None),
    }


def test_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([], "d string, iso_value string, c string")
    out = normalise_timestamps(df, "d", clock="c")
    assert out.columns == ["d", "c", "iso_value"] and out.count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(ZONES), st.integers(1880, 2499), st.integers(0, 8783))
def test_any_year(zone, year, hour):
    """Every local hour of the years of the table against the standard library (fold 0, skipped hours moved on)."""
    local = datetime(year, 1, 1) + timedelta(hours=hour)
    wanted = local.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).replace(tzinfo=None)
    ms = lambda d: int((d - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    assert to_utc(np.array([ms(local)]), np.array([zone], object), V)[0] == ms(wanted)


def test_version_is_of_the_data():
    assert V not in ("", "system") and len(V) >= 5
    with pytest.raises(RuntimeError):
        zone_table("another", "Europe/Berlin")
