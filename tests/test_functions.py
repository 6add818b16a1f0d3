"""Column expressions on hand-made edge values."""

import random
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from doorflux.functions import coercion, periods, rounding
from doorflux.functions.periods import Request, preset_request, shift_back


def evaluate(spark, ddl, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {ddl}")
    return [row.r for row in df.select("i", make(F.col("c")).alias("r")).orderBy("i").collect()]


def strip(text):
    return coercion.strip_rest(F.trim(text))


def test_strip(spark):
    raw = ["  a ", "\ta\n", " a　", " a b ", None, "\x1fa\x1c", ""]
    assert evaluate(spark, "string", raw, strip) == ["a", "a", "a", "a b", None, "a", ""]


def test_strip_is_python_strip(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    raw = [f"{space}x{space}y{space}" for space in spaces]
    assert evaluate(spark, "string", raw, strip) == [text.strip() for text in raw]


def test_count_from_text(spark):
    raw = ["3", "-4", "1.7", "abc", None, "1e2", " 5 ", "1d", "0x1p3", "nan", "", "-0.5", "1e30"]
    wanted = [3, 0, 1, 0, 0, 100, 5, 0, 0, 0, 0, 0, None]
    assert evaluate(spark, "string", raw, coercion.count_from_text) == wanted


def test_count_from_number(spark):
    raw = [3.9, -4.0, None, float("nan"), float("inf"), 1e30]
    assert evaluate(spark, "double", raw, coercion.count_from_number) == [3, 0, 0, 0, None, None]


def test_count_from_integer(spark):
    assert evaluate(spark, "int", [3, -4, None], coercion.count_from_integer) == [3, 0, 0]


def test_timestamp(spark):
    raw = ["2024-03-10 02:30:00", "bad", None, "2024-01-01 00:00:07.179575"]
    wanted = [datetime(2024, 3, 10, 2, 30), None, None, datetime(2024, 1, 1, 0, 0, 7, 179575)]
    assert evaluate(spark, "string", raw, coercion.timestamp) == wanted


def test_offset_minutes(spark):
    found = evaluate(spark, "int", [28, 29, None], lambda c: coercion.offset_minutes(c, {28: 53, 30: -5}))
    assert found == [53, 0, 0]


def _values(count):
    rng = random.Random(7)
    yield from (rng.uniform(-500, 500) for _ in range(count))
    for _ in range(count):  # ties: what remains after dividing by 2000 or 400
        before = rng.choice([400, 2000, 20000]) * rng.randint(1, 9)
        yield ((rng.randint(0, 90000) - before) / before) * 100
    yield from (0.05, 0.15, 0.25, 0.35, -0.05, -0.04, 0.0, 12.25, 12.35, 1e12 + 0.25)


def test_round_exact_is_python_round(spark):
    raw = list(_values(20000))
    found = evaluate(spark, "double", raw, rounding.round_exact)
    assert found == [round(value, 1) for value in raw]
    assert not any(str(value) == "-0.0" for value in found)


@pytest.mark.parametrize("digits", [1, 2])
def test_round_ties_up_by_exact_value(spark, digits):
    raw = [abs(value) for value in _values(20000)] + [0.125, 0.375, 1.005, 0.285, 33.335]
    step = Decimal(1).scaleb(-digits)
    wanted = [float(Decimal(value).quantize(step, ROUND_HALF_UP)) for value in raw]
    assert evaluate(spark, "double", raw, lambda c: rounding.round_exact(c, digits, "up")) == wanted


def test_two_decimals(spark):
    raw = [0.0, 0.125, 1.005, 99.999, 100.0, 7.1, 1234567.891]
    wanted = ["0.00", "0.13", "1.00", "100.00", "100.00", "7.10", "1234567.89"]
    assert evaluate(spark, "double", raw, rounding.two_decimals) == wanted


def test_growth(spark):
    pairs = [(0, 0), (5, 0), (4380, 4867), (0, 10), (None, 10), (6745, 7511)]
    df = spark.createDataFrame(pairs, "now bigint, before bigint")
    df = df.withColumn("change", rounding.percent_change(F.col("now"), F.col("before")))
    found = df.select(rounding.growth(F.col("now"), F.col("before"), F.col("change"))).collect()
    assert [row[0] for row in found] == [0.0, 100.0, -10.0, -100.0, 0.0, -10.2]


def test_nearest_whole_is_half_even(spark):
    assert evaluate(spark, "double", [2.5, 3.5, -2.5, 2.51], rounding.nearest_whole) == [2, 4, -2, 3]


def test_shift_back():
    assert shift_back(date(2024, 3, 31), "month") == date(2024, 2, 29)
    assert shift_back(date(2024, 2, 29), "year") == date(2023, 2, 28)
    assert shift_back(date(2024, 1, 15), "month") == date(2023, 12, 15)
    assert shift_back(date(2024, 3, 1), "day") == date(2024, 2, 29)
    assert shift_back(date(2024, 3, 1), "week") == date(2024, 2, 23)
    assert shift_back(date(2024, 3, 1), "quarter") is None
    assert Request("quarter", date(2024, 3, 1), date(2024, 3, 1)).previous() is None


def test_presets_agree(spark):
    days = [date(2023, 12, 28) + timedelta(days=i) for i in range(70)]
    for period in ("day", "week", "month", "year", "default"):
        first, last = periods.preset_range(F.lit(period), F.col("d"))
        df = spark.createDataFrame([(day,) for day in days], "d date").select("d", first, last)
        for day, start, end in df.collect():
            request = preset_request(period, day)
            assert (request.start_date, request.end_date) == (start, end)


def test_buckets_and_labels_ignore_the_time_zone(spark):
    # 02:30 does not exist on that day in the session's zone.
    moment = ["2024-03-10 02:30:00"]
    for unit, start in (("hour", "2024-03-10 02:00:00"), ("day", "2024-03-10 00:00:00"), ("month", "2024-03-01 00:00:00")):
        found = evaluate(spark, "string", moment, lambda c: periods.bucket(c.cast("timestamp_ntz"), unit))
        assert found == [datetime.fromisoformat(start)]
    labels = {
        "hour": "2024-03-10 02:00", "day": "2024-03-10", "month": "2024-03",
        "hour_of_day": "02:30", "day_of_month": "10/03", "month_name": "Tháng 03",
    }
    for style, wanted in labels.items():
        found = evaluate(spark, "string", moment, lambda c: periods.label(c.cast("timestamp_ntz"), style))
        assert found == [wanted]


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        periods.bucket(F.lit(None), "quarter")
    with pytest.raises(ValueError):
        periods.label(F.lit(None), "quarter")
