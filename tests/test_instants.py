from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from loomspan.functions.instants import to_utc_millis

BERLIN, NY = "Europe/Berlin", "America/New_York"


def wall(zone, y, m, d, h=0, mi=0, s=0, ms=0, fold=0):
    return int(datetime(y, m, d, h, mi, s, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1000 + ms


CASES = [
    ("2023-05-01T10:20:30Z", BERLIN, "dmy", wall("UTC", 2023, 5, 1, 10, 20, 30)),
    (" 2023-05-01T10:20:30.1239+02:00\t", BERLIN, "dmy", wall("UTC", 2023, 5, 1, 8, 20, 30, 123)),
    ("2023-05-01T10:20:30-0330", NY, "mdy", wall("UTC", 2023, 5, 1, 13, 50, 30)),
    ("2023-05-01T10:20:30+02", NY, "mdy", wall("UTC", 2023, 5, 1, 8, 20, 30)),
    ("2023-05-01T10:20:30+02:00[Europe/Paris]", NY, "mdy", wall("UTC", 2023, 5, 1, 8, 20, 30)),
    ("20230501T102030Z", BERLIN, "dmy", wall("UTC", 2023, 5, 1, 10, 20, 30)),
    ("1672535750", BERLIN, "dmy", 1672535750000), ("1672535750123", BERLIN, "dmy", 1672535750123), ("1672535750123999", BERLIN, "dmy", 1672535750123),
    ("Sun, 01 Jan 2023 13:31:15 +1100", BERLIN, "dmy", wall("UTC", 2023, 1, 1, 2, 31, 15)),
    ("Tue, 3 Jan 2023 12:14:19 GMT", BERLIN, "dmy", wall("UTC", 2023, 1, 3, 12, 14, 19)),
    ("2023-05-01", BERLIN, "dmy", wall(BERLIN, 2023, 5, 1)), ("2023-05-01", "UTC", "dmy", wall("UTC", 2023, 5, 1)), ("2023-05-01", None, "dmy", None),
    ("01.02.2023 07:36", BERLIN, "dmy", wall(BERLIN, 2023, 2, 1, 7, 36)), ("01/02/2023 07:36 PM", NY, "mdy", wall(NY, 2023, 1, 2, 19, 36)),
    ("01/02/2023 12:05 AM", NY, "mdy", wall(NY, 2023, 1, 2, 0, 5)), ("01/02/2023 12:05 PM", NY, "mdy", wall(NY, 2023, 1, 2, 12, 5)),
    ("2023/02/11 21:09", "Asia/Tokyo", "ymd", wall("Asia/Tokyo", 2023, 2, 11, 21, 9)),
    ("10. Januar 2023, 04:30 Uhr", BERLIN, "dmy", wall(BERLIN, 2023, 1, 10, 4, 30)), ("12 janvier 2023 à 02h47", "Europe/Paris", "dmy", wall("Europe/Paris", 2023, 1, 12, 2, 47)),
    ("21 de enero de 2023, 00:38", "America/Sao_Paulo", "dmy", wall("America/Sao_Paulo", 2023, 1, 21, 0, 38)), ("January 3, 2023 3:53 AM", NY, "mdy", wall(NY, 2023, 1, 3, 3, 53)),
    ("2023-07-01 10:00:00 CEST", BERLIN, "dmy", wall(BERLIN, 2023, 7, 1, 10)), ("2023-07-01 10:00:00 UTC", BERLIN, "dmy", wall("UTC", 2023, 7, 1, 10)),
    # A wall time that occurs twice, plain and with a name; one that doesn't occur.
    ("2023-10-29 02:30:00", BERLIN, "dmy", wall(BERLIN, 2023, 10, 29, 2, 30)), ("2023-10-29 02:30:00 CEST", BERLIN, "dmy", wall(BERLIN, 2023, 10, 29, 2, 30)),
    ("2023-10-29 02:30:00 CET", BERLIN, "dmy", wall(BERLIN, 2023, 10, 29, 2, 30, fold=1)),
    ("2023-03-26 02:30:00", BERLIN, "dmy", wall("UTC", 2023, 3, 26, 1, 30)), ("03/12/2023 02:30 AM", NY, "mdy", wall("UTC", 2023, 3, 12, 7, 30)),
    ("2024-02-29", "UTC", "dmy", wall("UTC", 2024, 2, 29)),
    # Counts of any length from nine digits on, back from 1970, and with a fraction; offsets after a name.
    ("915148800", BERLIN, "dmy", 915148800000), ("946684799000", BERLIN, "dmy", 946684799000), ("-315619200", BERLIN, "dmy", -315619200000), ("1683021600.1239", BERLIN, "dmy", 1683021600123), ("-946684799001", BERLIN, "dmy", -946684799001),
    ("99999999999", BERLIN, "dmy", 99999999999000), ("100000000000", BERLIN, "dmy", 100000000000), ("1683021600123456789", BERLIN, "dmy", 1683021600123), ("167253575012345", BERLIN, "dmy", 167253575012), ("9223372036854775807", BERLIN, "dmy", 9223372036854),
    ("2023-05-01 10:00:00 GMT+2", NY, "dmy", wall("UTC", 2023, 5, 1, 8)), ("2023-05-01 10:00:00 UTC+02:00", NY, "dmy", wall("UTC", 2023, 5, 1, 8)), ("2023-05-01T10:00:00-530", NY, "dmy", wall("UTC", 2023, 5, 1, 15, 30)),
]
NONE = ["", None, "--", "n/a", "yesterday", "gestern, 14 Uhr", "TBD", "2023-02-30", "2023-02-29", "2023-13-05T10:00:00Z", "31.11.2023 08:15", "0000-00-00 00:00:00", "2023-05-Invalid", "2023-05-01T24:00:00Z", "2023-05-01T10:60:00Z", "2023-05-01T10:00:00+19:00", "01/02/2023 13:05 PM", "5 Foo 2023", "2023-05-01 10:00:00 XYZ", "9" * 5000, "9999999999999999999", "12345678", "0", "-1", "1683021600123.5", "-", "1683021600.", "2023-05-01" * 3000]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, z, o, "extra") for i, (t, z, o, _) in enumerate(CASES)], "i int, text string, zone string, o string, wall string")
    got = {r["i"]: r["ms"] for r in to_utc_millis(df, "text", "zone", "o", "ms").collect()}
    assert {CASES[i][0]: got[i] for i in got} == {t: ms for t, _, _, ms in CASES}


def test_no_instant(spark):
    df = spark.createDataFrame([(t, BERLIN, "dmy") for t in NONE], "text string, zone string, o string")
    out = to_utc_millis(df, "text", "zone", "o", "ms")
    assert [r["text"] for r in out.where("ms is not null").collect()] == []
    assert to_utc_millis(df.limit(0), "text", "zone", "o", "ms").count() == 0


@pytest.mark.parametrize("zone", [BERLIN, NY, "Australia/Sydney", "Asia/Kolkata"])
def test_every_hour_of_a_year(spark, zone):
    at = [datetime(2023, 1, 1) + timedelta(minutes=30 * k) for k in range(2 * 24 * 365)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M"), zone, "dmy") for t in at], "text string, zone string, o string")
    got = {r["text"]: r["ms"] for r in to_utc_millis(df, "text", "zone", "o", "ms").collect()}
    z = ZoneInfo(zone)
    for t in at:
        assert got[t.strftime("%Y-%m-%d %H:%M")] == int(t.replace(tzinfo=z, fold=0).astimezone(timezone.utc).timestamp() * 1000)
