from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from slipweave.operators.timestamps import normalise_times

SCHEMA = "read_id long, user_id string, v string, device_zone string, device_locale string, arrived_at timestamp, instant_us string"


def us(*parts, zone="UTC", fold=0):
    t = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


BKK, NY = "Asia/Bangkok", "America/New_York"
CASES = [
    ("2024-04-24T16:37", BKK, "th-TH", us(2024, 4, 24, 16, 37, zone=BKK)),
    ("22-04-67 09:45", BKK, "th-TH", us(2024, 4, 22, 9, 45, zone=BKK)),
    ("๒๕/๐๔/๒๕๖๗ ๐๘:๑๖", BKK, "th-TH", us(2024, 4, 25, 8, 16, zone=BKK)),
    ("29 เม . ย . 67 00:00 น .", BKK, "th-TH", us(2024, 4, 29, zone=BKK)),
    ("11 เมษายน 2567 เวลา 14.00 น.", BKK, "th-TH", us(2024, 4, 11, 14, zone=BKK)),
    ("12 พ.ค.2567 - 16:45", BKK, "en-GB", us(2024, 5, 12, 16, 45, zone=BKK)),
    ("8/10/25, 3:37 PM", NY, "en-US", us(2025, 8, 10, 15, 37, zone=NY)),
    ("8/10/25 3:37 pm", BKK, "en-GB", us(2025, 10, 8, 15, 37, zone=BKK)),
    ("May 11, 2024 12:35:02 AM", NY, "en-US", us(2024, 5, 11, 0, 35, 2, zone=NY)),
    ("Mon, 06 May 2024 11:18:38 +1000", BKK, "th-TH", us(2024, 5, 6, 1, 18, 38)),
    ("02/05/2024 23:13 (UTC+07:00)", None, "en-GB", us(2024, 5, 2, 16, 13)),
    ("12 Apr 2024 06:45:41 GMT-5", None, "en-US", us(2024, 4, 12, 11, 45, 41)),
    ("18 Jan 2024 09:31 ICT", NY, "en-US", us(2024, 1, 18, 2, 31)),
    ("20240509T225022+0545", BKK, "th-TH", us(2024, 5, 9, 17, 5, 22)),
    ("20240427174422", "Asia/Tokyo", "ja-JP", us(2024, 4, 27, 17, 44, 22, zone="Asia/Tokyo")),
    ("２０２４年１月２４日 １:３１", "Asia/Tokyo", "ja-JP", us(2024, 1, 24, 1, 31, zone="Asia/Tokyo")),
    ("11. Mai 2024, 10:04 Uhr", "Europe/Berlin", "de-DE", us(2024, 5, 11, 10, 4, zone="Europe/Berlin")),
    ("2024-04-18 14:57:29.417420 +00:00", BKK, "th-TH", us(2024, 4, 18, 14, 57, 29, 417420)),
    ("1714641211", None, None, 1714641211000000),
    ("1714800646.368", None, None, 1714800646368000),
    ("1715166918108", BKK, "th-TH", 1715166918108000),
    ("2024-11-03 01:30:00", NY, "en-US", us(2024, 11, 3, 1, 30, zone=NY)),  # twice: the first
    ("31.03.2024 02:29", "Europe/Berlin", "de-DE", us(2024, 3, 31, 1, 29)),  # skipped: the offset before
    (" 22/04/2024 08:13:01\t", BKK, "en-GB", us(2024, 4, 22, 8, 13, 1, zone=BKK)),
    *[(v, BKK, "th-TH", None) for v in ("", "   ", None, "เมื่อวาน", "2024-05-12", "21:53:57", "31/02/2024 10:00:00", "0000-00-00 00:00:00", "??/??/2025 ??:??", "2024-05-01 25:00:00", "13:6", "x" * 5000)],
]


def test_printed_times(spark):
    at = datetime(2026, 1, 1)
    rows = [(i, f"u{i}", v, z, loc, at, "clash") for i, (v, z, loc, _) in enumerate(CASES)]
    rows += [rows[0], (None, "u", "2024-04-24T16:37", BKK, "th-TH", at, "")]
    out = normalise_times(spark.createDataFrame(rows, SCHEMA), "read_id", "user_id", "v", "device_zone", "device_locale", "arrived_at")
    got = {r.read_id: r.instant_us for r in out.collect()}
    want = {i: c[3] for i, c in enumerate(CASES) if c[3] is not None}
    assert {i: (CASES[i][0], got.get(i)) for i in want} == {i: (CASES[i][0], w) for i, w in want.items()}
    assert set(got) == set(want)


def test_missing_zone_is_estimated_from_the_owner(spark):
    rows = [(1, "u", "2024-05-01 10:00:00", "Asia/Tokyo", "ja-JP", datetime(2024, 5, 1, 1, 5), ""), (2, "u", "2024-05-02 10:00:00", None, "ja-JP", datetime(2024, 5, 2, 1, 5), ""),
            (3, "v", "2024-05-02 10:00:00", "No/Zone", "en-GB", datetime(2024, 5, 2, 17, 0), ""), (4, "w", "2024-05-02 10:00:00", NY, "en-US", datetime(2024, 5, 3), "")]
    out = {r.read_id: r for r in normalise_times(spark.createDataFrame(rows, SCHEMA), "read_id", "user_id", "v", "device_zone", "device_locale", "arrived_at").collect()}
    assert (out[2].zone_from, out[2].zone_used, out[2].instant_us) == ("ESTIMATED", "Asia/Tokyo", us(2024, 5, 2, 1))
    assert (out[3].zone_from, out[3].zone_used) == ("ESTIMATED", NY)  # the nearest before arrival


def test_zones_follow_the_history_of_an_owner(spark):
    """A traveller: each row takes the zone used at that time, and rows printed with an offset are evidence too."""
    rows, want, i = [], {}, 0
    for month, zone, locale in ((1, "Asia/Tokyo", "en-GB"), (4, "Europe/Berlin", "en-GB"), (7, NY, "en-GB")):
        for day in range(1, 21):
            i += 1
            hidden = day % 5 == 0
            rows.append((i, "u", f"2024-0{month}-{day:02d} 10:00:00", None if hidden else zone, locale, datetime(2024, month, day, 20), ""))
            if hidden:
                want[i] = us(2024, month, day, 10, zone=zone)
    rows.append((100, "v", "2024-05-01 10:00:00 +09:00", None, "ja-JP", datetime(2024, 5, 1, 2), ""))
    rows.append((101, "v", "2024-05-01 10:00:00", "Asia/Tokyo", "ja-JP", datetime(2024, 5, 1, 2), ""))
    rows.append((102, "v", "2024-05-02 10:00:00", NY, "en-US", datetime(2024, 5, 2, 15), ""))
    rows.append((103, "v", "2024-05-02 12:00:00", "", "ja-JP", datetime(2024, 5, 2, 20), ""))
    want[103] = us(2024, 5, 2, 3)
    out = {r.read_id: r.instant_us for r in normalise_times(spark.createDataFrame(rows, SCHEMA), "read_id", "user_id", "v", "device_zone", "device_locale", "arrived_at").collect()}
    assert {k: out[k] for k in want} == want


def test_empty_table(spark):
    assert normalise_times(spark.createDataFrame([], SCHEMA), "read_id", "user_id", "v", "device_zone", "device_locale", "arrived_at").count() == 0
