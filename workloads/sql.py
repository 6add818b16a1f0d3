"""SQL building blocks for the comparison engine (DuckDB dialect).

Nothing here is taken from the library but the dates and the store of a request: ranges,
units, labels and offsets are written out, so that a fault there shows.
"""

from __future__ import annotations

from doorflux.functions.periods import Request

# Bucket unit and peak label of each period, and minutes by which a
# store's clock runs fast.
UNIT = {"year": "month", "month": "day", "week": "day", "day": "hour"}
PEAK = {"day": "hour_of_day", "week": "day_of_month", "month": "day_of_month", "year": "month_name"}
CLOCK_CASES = (
    "WHEN 28 THEN 53 WHEN 30 THEN 82 WHEN 31 THEN 105 WHEN 32 THEN 45 WHEN 33 THEN 89 "
    "WHEN 34 THEN 103 WHEN 35 THEN 63 WHEN 36 THEN 179 WHEN 37 THEN 94"
)

# Label formats of buckets and peaks.
BUCKET_FORMAT = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "month": "%Y-%m"}
PEAK_FORMAT = {
    "hour_of_day": "%H:%M",
    "day_of_month": "%d/%m",
    "month_name": "Tháng %m",
}


def capped(column: str, constant: bool = False, above: int = 100) -> str:
    then = "1" if constant else f"CAST(round({column} * 1e-05, 0) AS BIGINT)"
    return f"CAST(CASE WHEN {column} > {above} THEN {then} ELSE {column} END AS BIGINT)"


def view(fact: str, stores: str, above: int = 100) -> str:
    """CTEs ending in ``v``, the normalised view."""
    return f"""
fact AS ({fact}), stores AS ({stores}),
v AS (
  SELECT f.recorded_at AS record_time, s.store_name,
         {capped('f.visitors_in', above=above)} AS in_count, {capped('f.visitors_out', above=above)} AS out_count,
         f.recorded_at - INTERVAL '9 hours' AS adjusted_time
  FROM fact f LEFT JOIN stores s ON f.store_id = s.store_id)"""


def in_range(request: Request, earlier: bool = False) -> str:
    """From 9 o'clock on the first day to 2 o'clock in the night after the last one.

    ``earlier`` moves both dates back by one period, to the end of a shorter month.
    """
    back = f" - INTERVAL 1 {request.period}" if earlier else ""
    first, last = (f"CAST(DATE '{day}'{back} AS DATE)" for day in (request.start_date, request.end_date))
    text = f"record_time >= {first} + INTERVAL 9 HOUR AND record_time < {last} + INTERVAL 26 HOUR"
    if request.store != "all":
        text += f" AND store_name = '{request.store}'"
    return text


def filtered(fact: str, stores: str, request: Request, above: int = 100) -> str:
    """CTEs ending in ``d``, the rows of a request."""
    return f"{view(fact, stores, above)}, d AS (SELECT * FROM v WHERE {in_range(request)})"


def buckets(fact: str, stores: str, request: Request, above: int = 100) -> str:
    """CTEs ending in ``b``, the bucket totals of a request."""
    return f"""{filtered(fact, stores, request, above)},
b AS (SELECT CAST(date_trunc('{UNIT[request.period]}', adjusted_time) AS TIMESTAMP) AS period_start,
             CAST(SUM(in_count) AS BIGINT) AS total_in
      FROM d GROUP BY 1)"""


def bucket_label(request: Request) -> str:
    return f"strftime(period_start + INTERVAL '9 hours', '{BUCKET_FORMAT[UNIT[request.period]]}')"


def peak_label(request: Request) -> str:
    return f"strftime(period_start + INTERVAL '9 hours', '{PEAK_FORMAT[PEAK[request.period]]}')"


def report(fact: str, stores: str, request: Request) -> str:
    """CTEs ending in ``r``, the report with its bucket starts."""
    return f"""{buckets(fact, stores, request)},
lagged AS (SELECT *, LAG(total_in, 1, 0) OVER (ORDER BY period_start) AS previous_in FROM b),
shown AS (SELECT * FROM lagged ORDER BY period_start DESC LIMIT 31),
shares AS (
  SELECT *, CASE WHEN SUM(total_in) OVER () > 0
                 THEN CAST(total_in AS DOUBLE) / CAST(SUM(total_in) OVER () AS DOUBLE) * 100.0
                 ELSE 0.0::DOUBLE END AS proportion_pct
  FROM shown),
r AS (
  SELECT period_start, {bucket_label(request)} AS period, CAST(total_in AS BIGINT) AS total_in,
         CAST(previous_in AS BIGINT) AS previous_in,
         CASE WHEN previous_in = 0 THEN 0.0::DOUBLE
              ELSE round((total_in - previous_in) * 100.0::DOUBLE / previous_in, 1) + 0.0::DOUBLE END AS pct_change,
         proportion_pct,
         coalesce(proportion_pct - LEAD(proportion_pct) OVER (ORDER BY period_start DESC), 0.0::DOUBLE) AS proportion_change
  FROM shares)"""


def rounded(source: str, value: str, name: str, ties: str = "even", digits: int = 1) -> str:
    """CTEs ending in ``rounded``: ``source`` with ``name`` = ``value`` rounded.

    Products with powers of two are exact; their sum keeps its error in ``e``.
    """
    tie = "f + 1" if ties == "up" else "CASE WHEN f / 2 = floor(f / 2) THEN f ELSE f + 1 END"
    if digits == 1:
        sums = f"""
p1 AS (SELECT *, ({value}) * 8.0::DOUBLE AS a, ({value}) * 2.0::DOUBLE AS b, 0.0::DOUBLE AS e0 FROM {source}),
p2 AS (SELECT *, a + b AS z FROM p1)"""
    else:
        sums = f"""
p0 AS (SELECT *, ({value}) * 32.0::DOUBLE AS a0, ({value}) * 4.0::DOUBLE AS b0 FROM {source}),
p00 AS (SELECT *, a0 + b0 AS z0 FROM p0),
p1 AS (SELECT *, ({value}) * 64.0::DOUBLE AS a, z0 AS b, (a0 - (z0 - (z0 - a0))) + (b0 - (z0 - a0)) AS e0 FROM p00),
p2 AS (SELECT *, a + b AS z FROM p1)"""
    return f"""{sums},
p3 AS (SELECT *, e0 + ((a - (z - (z - a))) + (b - (z - a))) AS e, floor(z) AS f FROM p2),
rounded AS (
  SELECT *, (CASE WHEN z - f < 0.5 THEN f WHEN z - f > 0.5 THEN f + 1
                  WHEN e < 0 THEN f WHEN e > 0 THEN f + 1 ELSE {tie} END)
            / {10**digits}.0::DOUBLE + 0.0::DOUBLE AS {name}
  FROM p3)"""


def offset_of(store: str) -> str:
    return f"(CASE {store} {CLOCK_CASES} ELSE 0 END)"


def corrected(moment: str, store: str) -> str:
    return f"({moment} - to_minutes({offset_of(store)}))"


def stripped(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def count_of_text(column: str) -> str:
    return f"greatest(CAST(trunc(coalesce(TRY_CAST(trim({column}) AS DOUBLE), 0)) AS BIGINT), 0)"
