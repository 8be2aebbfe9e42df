from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.operators import timestamps as T


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("Wed, 06 Jan 2021 09:36:01 +0000", us(2021, 1, 6, 9, 36, 1)),
    ("FRI, 04 NOV 2022 07:25:53 +0100", us(2022, 11, 4, 6, 25, 53)),
    ("Mon, 18 Jan 21 13:41:56 +0100", us(2021, 1, 18, 12, 41, 56)),
    ("Thu, 14 Jan 2021 13:03 +0800", us(2021, 1, 14, 5, 3)),
    ("Tue, 12 Jan 2021", us(2021, 1, 12)),
    ("Wed, 13 Jan 2021 09:43:48 UTC+0100", us(2021, 1, 13, 8, 43, 48)),
    ("Fri, 15 Jan 2021 06:55:08 -0500 (EST)", us(2021, 1, 15, 11, 55, 8)),
    ("Mon, 15 Feb 2021 01:09:18 +0530 (server)", us(2021, 2, 14, 19, 39, 18)),
    ("Sat Jan  9 01:46:00 EST 2021", us(2021, 1, 9, 6, 46)),
    ("Mon Jan 11 11:09:55 2021 +0100", us(2021, 1, 11, 10, 9, 55)),
    ("Jan 28, 2021 12:05:36 AM +0800", us(2021, 1, 27, 16, 5, 36)),
    ("2021年2月19日 下午3:29:50 +08:00", us(2021, 2, 19, 7, 29, 50)),
    ("2021年1月11日 上午12:09:48 +00:00", us(2021, 1, 11, 0, 9, 48)),
    ("20210117T220211Z", us(2021, 1, 17, 22, 2, 11)),
    ("2021-01-11T13:12:20.101559", us(2021, 1, 11, 13, 12, 20, micro=101559)),
    ("2021-01-11T07:54:15.3+01:00", us(2021, 1, 11, 6, 54, 15, micro=300000)),
    ("2021-01-13 22:37:35.592846+0800", us(2021, 1, 13, 14, 37, 35, micro=592846)),
    ("2021/01/07 21:43:38 +0100", us(2021, 1, 7, 20, 43, 38)),
    ("1611174104", us(2021, 1, 20, 20, 21, 44)),
    ("1610355632102", us(2021, 1, 11, 9, 0, 32, micro=102000)),
    ("1610984222517975", us(2021, 1, 18, 15, 37, 2, micro=517975)),
    ("1613290970.778", us(2021, 2, 14, 8, 22, 50, micro=778000)),
    ("2021-10-31 02:30:00 Europe/Berlin", us(2021, 10, 31, 0, 30)),  # twice: the earlier one
    ("2021-03-28 02:30:00 (Europe/Berlin)", us(2021, 3, 28, 1, 30)),  # skipped: the offset before
    ("2021-03-14T02:15:00[America/New_York]", us(2021, 3, 14, 7, 15)),
    ("  Date: Tue, 12 Jan 2021 09:05:14 +0100 ", us(2021, 1, 12, 8, 5, 14)),
    ("Wed, 21 Apr  2021\t11:32:05 +1000", us(2021, 4, 21, 1, 32, 5)),
    ("13/02/2021 10:00:00", us(2021, 2, 13, 10)),
    *[(x, None) for x in (None, "", "-", "yesterday", "unknown", "0000-00-00 00:00:00", "Thu, 32 Foo 2023 25:61:00 +0000", "31 Feb 2021", "x" * 100_000)],
]


def test_layouts(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(CASES)], "k int, v string")
    got = {r["k"]: r["utc_us"] for r in T.normalise(df, "v", F.lit("s")).collect()}
    assert {k: got[k] for k, _ in enumerate(CASES)} == {k: w for k, (_, w) in enumerate(CASES)}


def test_mixture_settles_a_source_by_its_other_values(spark):
    rows = [("eu", f"{d}/03/2021") for d in range(13, 29)] + [("us", f"03/{d}/2021") for d in range(13, 29)] + [("eu", "04/05/2021"), ("us", "04/05/2021"), ("odd", "04/05/2021"), ("odd", "05/04/2021")]
    df = spark.createDataFrame(rows, "s string, v string").withColumn("state", F.lit("clash"))
    got = {(r["s"], r["v"]): (r["state"], r["utc_us"], r["layout"]) for r in T.normalise(df, "v", F.col("s")).collect()}
    digits = [("eu", f"{d}032021") for d in range(13, 29)] + [("us", f"03{d}2021") for d in range(13, 29)] + [("eu", "04052021"), ("us", "04052021"), ("odd", "04052021"), ("odd", "20210405"), ("odd", "99999999")]
    eight = {(r["s"], r["v"]): (r["state"], r["utc_us"], r["layout"]) for r in T.normalise(spark.createDataFrame(digits, "s string, v string"), "v", F.col("s")).collect()}
    assert eight["eu", "04052021"] == ("sure", us(2021, 5, 4), "compact_day_first") and eight["us", "04052021"] == ("sure", us(2021, 4, 5), "compact_month_first")
    assert eight["odd", "04052021"][0] == "ambiguous" and eight["odd", "20210405"] == ("sure", us(2021, 4, 5), "compact") and eight["odd", "99999999"][0] == "none"
    assert got["eu", "04/05/2021"] == ("sure", us(2021, 5, 4), "day_first")
    assert got["us", "04/05/2021"] == ("sure", us(2021, 4, 5), "month_first")
    assert got["odd", "04/05/2021"][:2] == ("ambiguous", None)


def test_em_weights():
    w = T.mixture([("a", ("day_first",), 90), ("a", ("day_first", "month_first"), 10)])
    assert w["a", "day_first"] > 0.95
    assert sum(v for (s, _), v in w.items() if s == "a") == pytest.approx(1)


def test_found_leaves_out_header_layout_and_takes_empty_tables(spark, emails, threads):
    e = emails([{"id": 1, "date": "Wed, 6 Jan 2021 09:36:01 +0000"}, {"id": 2, "date": "2021-01-06"}, {"id": 3}, {"id": 4, "date": "-"}], extra=True)
    t = threads([{"id": "a", "start_date": "1611174104", "end_date": ""}])
    assert {tuple(r) for r in T.odd_instants(e, t).collect()} == {("emails", "2", "date", us(2021, 1, 6)), ("threads", "a", "start_date", us(2021, 1, 20, 20, 21, 44))}
    assert T.odd_instants(emails([]), threads([])).count() == 0
