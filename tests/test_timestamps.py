from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from webloom.operators.timestamps import instants, with_source_zone

NODES = [("de", "Europe/Berlin", "dmy"), ("us", "America/New_York", "mdy"), ("cn", "Asia/Shanghai", "dmy"), ("ie", "Europe/Dublin", "dmy"), ("in", "Asia/Kolkata", "dmy"), ("ch", "America/Chicago", "mdy")]


def ms(*a, tz="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(tz), fold=fold).timestamp() * 1000)


CASES = [
    ("2024-05-03T10:20:30Z", "us", ms(2024, 5, 3, 10, 20, 30)),
    ("  2024-05-03 10:20  ", "de", ms(2024, 5, 3, 8, 20)),
    ("2024-05-03T10:20:30.987654321+05:30", "us", ms(2024, 5, 3, 4, 50, 30) + 987),
    ("2024-05-03 10:20:30,5", "de", ms(2024, 5, 3, 8, 20, 30) + 500),
    ("2024-05-03 10:20:30 America/New_York", "de", ms(2024, 5, 3, 14, 20, 30)),
    ("2024-05-03T10:20:30-04:00[America/New_York]", "de", ms(2024, 5, 3, 14, 20, 30)),
    ("2024-05-03 10:20:30 UTC-5", "de", ms(2024, 5, 3, 15, 20, 30)),
    ("03/04/2024 05:06:07", "de", ms(2024, 4, 3, 5, 6, 7, tz="Europe/Berlin")),
    ("03/04/2024 05:06:07", "us", ms(2024, 3, 4, 5, 6, 7, tz="America/New_York")),
    ("3/14/2024 12:05 AM", "us", ms(2024, 3, 14, 0, 5, tz="America/New_York")),
    ("14.03.2024 12:05:06", "us", ms(2024, 3, 14, 12, 5, 6, tz="America/New_York")),
    ("Mon Mar 04 05:06:07 CST 2024", "cn", ms(2024, 3, 4, 5, 6, 7, tz="Asia/Shanghai")),
    ("Mon Mar 04 05:06:07 CST 2024", "ch", ms(2024, 3, 4, 5, 6, 7, tz="America/Chicago")),
    ("Mon Mar 04 05:06:07 CST 2024", "de", ms(2024, 3, 4, 11, 6, 7)),
    ("Mon Jul 01 05:06:07 IST 2024", "ie", ms(2024, 7, 1, 4, 6, 7)),
    ("Mon Jul 01 05:36:07 IST 2024", "in", ms(2024, 7, 1, 0, 6, 7)),
    ("Wed, 03 May 2024 10:20:30 GMT", "de", ms(2024, 5, 3, 10, 20, 30)),
    ("Friday, 03-May-24 10:20:30 GMT", "de", ms(2024, 5, 3, 10, 20, 30)),
    ("Thu Jul  4 10:49:29 2024", "us", ms(2024, 7, 4, 10, 49, 29, tz="America/New_York")),
    ("16 de septiembre de 2022, 12:46:14 +10:00", "us", ms(2022, 9, 16, 2, 46, 14)),
    ("18. März 2025, 13:24:41 +01:00", "us", ms(2025, 3, 18, 12, 24, 41)),
    ("26 août 2021 16:24:44 +05:45", "us", ms(2021, 8, 26, 10, 39, 44)),
    ("1727104587", "us", 1727104587000), ("1727104587217", "us", 1727104587217), ("1753725526726497", "us", 1753725526726),
    ("20240503102030", "us", ms(2024, 5, 3, 14, 20, 30)), ("20240503T102030Z", "us", ms(2024, 5, 3, 10, 20, 30)),
    ("2024-10-27 02:30:00", "de", ms(2024, 10, 27, 0, 30)),  # twice: the first
    ("2024-03-31 02:30:00", "de", None),  # never
    ("2023-02-29 10:00:00", "de", None), ("2024-13-05T10:11:12Z", "de", None), ("1970-01-01T00:00:00Z", "de", None), ("0000-00-00 00:00:00", "de", None),
    ("2024-05-03 24:00:00", "de", None), ("2024-05-03 10:20:30 XQZ", "de", None), ("2024-05-03 10:20:30 No/Where", "de", None), ("2024-05-03 10:20", "??", None), ("2024-05-03 10:20Z", "??", ms(2024, 5, 3, 10, 20)),
    ("yesterday", "de", None), ("", "de", None), (None, "de", None), ("0", "de", None), ("x" * 50_000, "de", None), ("13:14/05/2024", None, None),
]


def test_every_kind(spark):
    df = spark.createDataFrame([(i, t, n, "clash") for i, (t, n, _) in enumerate(CASES)], "i int, t string, node string, tz_name string")
    nodes = spark.createDataFrame(NODES, "node string, tz_name string, date_order string")
    got = {r["i"]: r["utc_ms"] for r in instants(with_source_zone(df, nodes), "t", "tz_name", "date_order", "abbreviations").collect()}
    assert [(c[0], c[1], got[i]) for i, c in enumerate(CASES)] == [tuple(c) for c in CASES]


@pytest.mark.parametrize(("policy", "want"), [("last", ms(2024, 10, 27, 1, 30)), ("null", None)])
def test_policies(spark, policy, want):
    df = spark.createDataFrame([("2024-10-27 02:30:00", "de"), ("2024-03-31 02:30:00", "de")], "t string, node string")
    nodes = spark.createDataFrame(NODES, "node string, tz_name string, date_order string")
    rows = instants(with_source_zone(df, nodes), "t", "tz_name", "date_order", "abbreviations", ambiguous=policy, nonexistent="shift").orderBy("t").collect()
    assert rows[1]["utc_ms"] == want
    assert rows[0]["utc_ms"] == ms(2024, 3, 31, 1, 30)


def test_random_against_zoneinfo(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for i in range(400):
        node, zone, _ = rng.choice(NODES)
        t = datetime(rng.randint(1990, 2035), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))
        rows.append((i, t.strftime("%Y-%m-%d %H:%M:%S"), node))
        at = t.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
        want[i] = int(at.timestamp() * 1000) if at.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t else None
    nodes = spark.createDataFrame(NODES, "node string, tz_name string, date_order string")
    df = with_source_zone(spark.createDataFrame(rows, "i int, t string, node string"), nodes)
    assert {r["i"]: r["utc_ms"] for r in instants(df, "t", "tz_name", "date_order", "abbreviations").collect()} == want
    assert instants(df.limit(0), "t", "tz_name", "date_order", "abbreviations", only_instants=True).count() == 0
