"""The period report: newest buckets with change and share columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorflux.functions.periods import Request, label
from doorflux.functions.rounding import two_decimals
from doorflux.operators.buckets import bucket_totals
from doorflux.operators.normalize import Traffic, clock_time

# Headings of the exported report.
CSV_HEADINGS = ("Ky bao cao", "Tong luot vao", "Ty trong (%)", "Chenh lech (%)")
BYTE_ORDER_MARK = "﻿"


def with_previous(traffic: Traffic, request: Request) -> DataFrame:
    """The newest buckets, each with the total of the bucket before it.

    One bucket more than shown is taken, as the oldest shown still needs its
    predecessor. Thus the window sorts at most ``report_rows + 1`` rows.
    """
    shown = traffic.rules.report_rows
    newest_first = F.desc("period_start")
    candidates = bucket_totals(traffic, request).orderBy(newest_first).limit(shown + 1)
    in_time = Window.orderBy("period_start")
    before = F.lag("total_in", 1, 0).over(in_time)
    return (
        candidates.withColumn("previous_in", before).orderBy(newest_first).limit(shown)
    )


def report(traffic: Traffic, request: Request) -> DataFrame:
    """``period, total_in, pct_change, proportion_pct, proportion_change``.

    Shares are of the rows shown, and change against the next older row shown.
    """
    newest_first = Window.orderBy(F.desc("period_start"))
    total = F.col("total_in").cast("double")
    before = F.col("previous_in")
    change = F.when(before == 0, F.lit(0.0)).otherwise(
        F.round((F.col("total_in") - before) * 100.0 / before.cast("double"), 1)
    )
    whole = F.sum("total_in").over(Window.partitionBy())
    share = F.when(whole > 0, total / whole.cast("double") * 100.0).otherwise(F.lit(0.0))
    older_share = F.lead("proportion_pct").over(newest_first)
    return (
        with_previous(traffic, request)
        .withColumns({"pct_change": change, "proportion_pct": share})
        .withColumn(
            "proportion_change",
            F.coalesce(F.col("proportion_pct") - older_share, F.lit(0.0)),
        )
        .orderBy(F.desc("period_start"))
        .select(
            label(clock_time(F.col("period_start"), traffic.rules), request.unit).alias("period"),
            "total_in",
            "pct_change",
            "proportion_pct",
            "proportion_change",
        )
    )


def report_summary(traffic: Traffic, request: Request) -> DataFrame:
    """Sum and mean of the rows the report shows; zeros if it shows none."""
    shown = bucket_totals(traffic, request).orderBy(F.desc("period_start"))
    return shown.limit(traffic.rules.report_rows).agg(
        F.coalesce(F.sum("total_in"), F.lit(0)).alias("total_sum"),
        F.coalesce(F.avg("total_in"), F.lit(0.0)).alias("average_in"),
    )


def csv_rows(report_rows: DataFrame, byte_order_mark: bool = False) -> DataFrame:
    """The report as texts under the export headings.

    Shares have two decimals; changes drop a trailing ``.0``.
    """
    first, *rest = CSV_HEADINGS
    headings = [BYTE_ORDER_MARK + first if byte_order_mark else first, *rest]
    change = F.regexp_replace(F.format_string("%.1f", F.col("pct_change") + 0.0), r"\.0$", "")
    texts = (
        F.col("period"),
        F.col("total_in").cast("string"),
        two_decimals(F.col("proportion_pct")),
        change,
    )
    return report_rows.select(*[text.alias(name) for text, name in zip(texts, headings)])


def csv_name(request: Request) -> str:
    return f"bao_cao_{request.period}_{request.start_date}_{request.end_date}.csv"


def write_csv(report_rows: DataFrame, folder: str, request: Request) -> str:
    """Write the report (at most ``report_rows`` rows) with headings and a BOM."""
    path = f"{folder.rstrip('/')}/{csv_name(request)}"
    rows = csv_rows(report_rows, byte_order_mark=True)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
