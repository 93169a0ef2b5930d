"""The cascade against fixed cases and against a second reading with zoneinfo."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from paperloom.operators.timestamps import Policy, abbreviations, with_utc_ms

SHANGHAI, CHICAGO, BERLIN, NEPAL = ("Asia/Shanghai", "ymd"), ("America/Chicago", "mdy"), ("Europe/Berlin", "dmy"), ("Asia/Kathmandu", "ymd")
NOWHERE = (None, None)
READ_AT = datetime(2024, 3, 10, 20, 0, tzinfo=UTC)


def ms(*at, micro=0, **zone):
    return int((datetime(*at, tzinfo=UTC) - timedelta(**zone)).timestamp()) * 1000 + micro // 1000


CASES = [
    ("1716951593", NOWHERE, 1716951593000),
    ("1716951593.046", NOWHERE, 1716951593046),
    ("1712181601683", NOWHERE, 1712181601683),
    ("1683613377944027", NOWHERE, 1683613377944),
    ("1683613377944027123", NOWHERE, 1683613377944),
    ("2024-11-03T05:39:54.479988Z", NOWHERE, ms(2024, 11, 3, 5, 39, 54, micro=479988)),
    ("2025-06-04T23:43:50+08:00", CHICAGO, ms(2025, 6, 4, 23, 43, 50, hours=8)),
    ("2024-04-06T18:48:24.984+0100", CHICAGO, ms(2024, 4, 6, 18, 48, 24, micro=984000, hours=1)),
    ("2021-04-21 03:34:02 -0500", SHANGHAI, ms(2021, 4, 21, 3, 34, 2, hours=-5)),
    ("2025-09-09 07:53 GMT+5:45", SHANGHAI, ms(2025, 9, 9, 7, 53, hours=5, minutes=45)),
    ("2025-05-17 04:08 UTC-3", SHANGHAI, ms(2025, 5, 17, 4, 8, hours=-3)),
    ("2022-11-26 10:00:28 UTC", BERLIN, ms(2022, 11, 26, 10, 0, 28)),
    ("2023-06-03", SHANGHAI, ms(2023, 6, 3, hours=8)),
    ("20220116", NEPAL, ms(2022, 1, 16, hours=5, minutes=45)),
    ("20241027T012705", BERLIN, ms(2024, 10, 27, 1, 27, 5, hours=2)),
    ("2021.6.27", BERLIN, ms(2021, 6, 27, hours=2)),
    ("09/12/2021 1:30 AM", CHICAGO, ms(2021, 9, 12, 1, 30, hours=-5)),
    ("09/12/2021 12:30 AM", CHICAGO, ms(2021, 9, 12, 0, 30, hours=-5)),
    ("01.05.2025 09:57", BERLIN, ms(2025, 5, 1, 9, 57, hours=2)),
    ("4/26/25 10:27", CHICAGO, ms(2025, 4, 26, 10, 27, hours=-5)),
    ("2024-06-21 10:33:57 CST", SHANGHAI, ms(2024, 6, 21, 10, 33, 57, hours=8)),
    ("2024-06-21 10:33:57 CST", CHICAGO, ms(2024, 6, 21, 10, 33, 57, hours=-6)),
    ("2024-06-21 10:33:57 CST", NOWHERE, None),
    ("2024-06-21 10:33:57 JST", NOWHERE, ms(2024, 6, 21, 10, 33, 57, hours=9)),
    ("Oct 30, 2022 2:15 AM CET", BERLIN, ms(2022, 10, 30, 2, 15, hours=1)),
    ("2022-10-30 02:15:00", BERLIN, None),
    ("2022-10-30 02:15:00[Europe/Berlin]", SHANGHAI, None),
    ("2022-03-27 02:15:00", BERLIN, None),
    ("2022-03-27 03:15:00", BERLIN, ms(2022, 3, 27, 1, 15)),
    ("2023-03-12 01:06:01[America/New_York]", SHANGHAI, ms(2023, 3, 12, 1, 6, 1, hours=-5)),
    ("2021-06-12 23:19:14 America/New_York", SHANGHAI, ms(2021, 6, 12, 23, 19, 14, hours=-4)),
    ("2021-06-12 23:19:14 America/Nowhere", SHANGHAI, None),
    ("Mon, 01 Apr 2024 07:46:30 +0800", CHICAGO, ms(2024, 4, 1, 7, 46, 30, hours=8)),
    ("16 Aug 2022, 23:56", BERLIN, ms(2022, 8, 16, 23, 56, hours=2)),
    ("March 13, 2022 at 4:37 pm", CHICAGO, ms(2022, 3, 13, 16, 37, hours=-5)),
    ("Dec 31, 2023 1:43 PM CST", SHANGHAI, ms(2023, 12, 31, 13, 43, hours=8)),
    ("31. März 2024, 3.35 Uhr", BERLIN, ms(2024, 3, 31, 3, 35, hours=2)),
    ("2025年01月23日20时11分03秒", SHANGHAI, ms(2025, 1, 23, 20, 11, 3, hours=8)),
    ("2021年5月15日 上午12:27", SHANGHAI, ms(2021, 5, 15, 0, 27, hours=8)),
    ("2022年3月16日 下午10:49", SHANGHAI, ms(2022, 3, 16, 22, 49, hours=8)),
    ("2024-03-10 20:30（北京时间）", CHICAGO, ms(2024, 3, 10, 20, 30, hours=8)),
    ("昨天 05:07", SHANGHAI, ms(2024, 3, 10, 5, 7, hours=8)),
    ("Yesterday 05:07", CHICAGO, ms(2024, 3, 9, 5, 7, hours=-6)),
    ("today at 01:08", NEPAL, ms(2024, 3, 11, 1, 8, hours=5, minutes=45)),
    ("yesterday", SHANGHAI, ms(2024, 3, 10, hours=8)),
    ("3 hours ago", SHANGHAI, None),
    ("21天前", SHANGHAI, None),
    ("just now", SHANGHAI, None),
    ("2024-02-30", SHANGHAI, None),
    ("2024-13-05", SHANGHAI, None),
    ("25:61", SHANGHAI, None),
    ("1970", SHANGHAI, None),
    ("0000-00-00 00:00:00", SHANGHAI, None),
    ("13:05 PM 2024", SHANGHAI, None),
    ("2024年5月1日 下午13:05", SHANGHAI, None),
    ("2023-06-03", NOWHERE, None),
    ("03/04/2022 10:00", SHANGHAI, None),
    ("", SHANGHAI, None),
    (None, SHANGHAI, None),
    ("x" * 100_000, SHANGHAI, None),
    ("2024-01-01 " + "0" * 5000, SHANGHAI, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "n int, text string, zone string, ord string, cap timestamp, _t string, utc_ms_old int")


def run(spark, cases, policy=Policy(), cap=READ_AT):
    df = frame(spark, [(i, t, z, o, cap, "kept", 1) for i, (t, (z, o), *_) in enumerate(cases)])
    out = with_utc_ms(df, "text", "zone", "ord", "cap", policy=policy)
    assert out.columns == [*df.columns, "utc_ms"]
    return {r.n: r.utc_ms for r in out.select("n", "utc_ms").collect()}


def test_cases(spark):
    got = run(spark, CASES)
    assert {CASES[i][0][:60] if CASES[i][0] else None: (CASES[i][2], v) for i, v in got.items() if v != CASES[i][2]} == {}


def test_policies(spark):
    twice, never = [("2022-10-30 02:15", BERLIN)], [("2022-03-27 02:15", BERLIN)]
    assert run(spark, twice, Policy(ambiguous="earlier"))[0] == ms(2022, 10, 30, 0, 15)
    assert run(spark, twice, Policy(ambiguous="later"))[0] == ms(2022, 10, 30, 1, 15)
    assert run(spark, never, Policy(nonexistent="shift"))[0] == ms(2022, 3, 27, 1, 15)


def test_empty_null_and_repeats(spark):
    assert run(spark, [("昨天 05:07", SHANGHAI)], cap=None) == {0: None}
    df = frame(spark, [])
    assert with_utc_ms(df, "text", "zone", "ord", "cap").count() == 0
    assert set(run(spark, [("2023-06-03", SHANGHAI)] * 3).values()) == {ms(2023, 6, 3, hours=8)}


def test_each_half_hour_around_changes(spark):
    """Against zoneinfo: a reading names one instant, none or two."""
    cases = [x for zone in ("America/New_York", "Europe/London", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kathmandu") for x in around(zone)]
    got = run(spark, cases)
    assert [(cases[i], v) for i, v in got.items() if v != cases[i][2]] == []


def around(zone):
    info, cases = ZoneInfo(zone), []
    start = datetime(2018, 1, 1, tzinfo=UTC)
    changes = [h for h in range(0, 366 * 24) if (start + timedelta(hours=h)).astimezone(info).utcoffset() != (start + timedelta(hours=h + 1)).astimezone(info).utcoffset()]
    for h in changes or [0]:
        for step in range(-8, 9):
            local = (start + timedelta(hours=h)).astimezone(info).replace(tzinfo=None) + timedelta(minutes=30 * step)
            folds = {local.replace(tzinfo=info, fold=f).astimezone(UTC) for f in (0, 1)}
            real = {x for x in folds if x.astimezone(info).replace(tzinfo=None) == local}
            want = int(next(iter(real)).timestamp() * 1000) if len(real) == 1 else None
            cases.append((local.strftime("%Y-%m-%d %H:%M:%S"), (zone, "ymd"), want))
    return cases


def test_abbreviations_come_from_the_zones():
    found = abbreviations()
    assert found["Asia/Shanghai|CST"] == 8 * 3600 and found["America/Chicago|CST"] == -6 * 3600
    assert "|CST" not in found and "|IST" not in found and found["|JST"] == 9 * 3600


def test_no_shuffle_and_no_python(spark):
    out = with_utc_ms(frame(spark, []), "text", "zone", "ord", "cap")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_query(spark, tiny):
    from paperloom.plans import times

    rows = times.found(spark, tiny)
    assert rows.columns == ["src_table", "rec_id", "utc_ms"]
    assert rows.count() == rows.select("src_table", "rec_id").distinct().count() > 300
    assert rows.where(F.col("utc_ms").isNull()).count() == 0
