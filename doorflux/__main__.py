"""Jobs for ``spark-submit`` or ``python -m doorflux``.

    load      --warehouse W --source dbo.store=PATH … [--tables F] [--offsets F] [--database D]
    dashboard --warehouse W --out O --period month [--start D --end D | --as-of D] [--store S]
    stores    --warehouse W --out O
    compact   --warehouse W [--rules F]
    view      --warehouse W --database D [--rules F]
    stream    --warehouse W --table dbo.num_crowd --landing FOLDER --checkpoint FOLDER [--distinct-within SPAN]

``load`` ends with 1 if a table failed.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from doorflux.config import (
    DEFAULT_OFFSETS,
    BusinessRules,
    default_specs,
    load_offsets,
    load_rules,
    load_specs,
)
from doorflux.functions.periods import ALL_STORES, Request, preset_request
from doorflux.operators.report import write_csv
from doorflux.operators.stores import store_names
from doorflux.plans.dashboard import dashboard
from doorflux.plans.load import run_etl, run_summary, source_keys
from doorflux.plans.warehouse import Warehouse
from doorflux.session import build_session
from doorflux.sources import jdbc_table, parquet_table
from doorflux.streaming import stream_load
from doorflux.streaming.incremental import batch_figures, landing_stream


def main(arguments: list[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    spark = build_session(f"doorflux {options.job}", options.master)
    return options.run(Warehouse(spark, options.warehouse), options) or 0


def load(warehouse: Warehouse, options) -> int:
    """Load all tables and write the figures of the run; with a database also publish."""
    specs = load_specs(options.tables) if options.tables else default_specs()
    offsets = load_offsets(options.offsets) if options.offsets else DEFAULT_OFFSETS
    named = dict(source.split("=", 1) for source in options.source)
    sources = {table: parquet_table(warehouse.spark, path) for table, path in named.items()}
    splits = {table: rest.split(",", 3) for table, rest in (x.split("=", 1) for x in options.split)}
    if options.jdbc_url:
        for spec in specs:
            if spec.source_table not in sources:
                column, lower, upper, parts = splits.get(spec.source_table, (None, None, None, 1))
                sources[spec.source_table] = jdbc_table(
                    warehouse.spark, options.jdbc_url, spec.source_table,
                    split_column=column, lower=lower, upper=upper, splits=int(parts),
                )
    figures = run_etl(
        warehouse, sources, specs, offsets, _rules(options), options.lookback, options.database
    )
    figures.write.mode("overwrite").json(options.out or f"{warehouse.root}/last_run")
    summary = run_summary(figures)
    summary.show()
    return 1 if summary.first()["failed"] else 0


def _rules(options) -> BusinessRules:
    return load_rules(options.rules) if options.rules else BusinessRules()


def _request(options) -> Request:
    """The dates given, or those of the period that holds ``as_of``."""
    if options.start and options.end:
        return Request.of(options.period, options.start, options.end, options.store)
    as_of = date.fromisoformat(options.as_of) if options.as_of else date.today()
    return preset_request(options.period, as_of, options.store)


def show_dashboard(warehouse: Warehouse, options) -> None:
    """Write the sections as JSON by section, and the report as CSV."""
    request, rules = _request(options), _rules(options)
    traffic = warehouse.traffic(rules, hourly=True)
    errors = warehouse.newest("fact_errors", rules.error_rows)
    parts = dashboard(traffic, warehouse.latest_record_time(), errors, request)
    try:
        parts.sections().write.mode("overwrite").partitionBy("section").json(f"{options.out}/sections")
        write_csv(parts.table_data, options.out, request)
    finally:
        parts.release()


def stores(warehouse: Warehouse, options) -> None:
    """Write the names of all stores."""
    store_names(warehouse.table("dim_stores")).write.mode("overwrite").json(options.out)


def compact(warehouse: Warehouse, options) -> None:
    for spec in default_specs():
        if spec.incremental:
            warehouse.compact(spec, _rules(options))


def view(warehouse: Warehouse, options) -> None:
    """Show what is published in the catalog and define the view anew, without a load."""
    for spec in default_specs():
        warehouse.publish_to_catalog(spec, options.database, analyze=False)
    warehouse.publish_view(options.database, _rules(options))


def stream(warehouse: Warehouse, options) -> None:
    """Load the files that have landed since the last run, and leave the figures of each batch."""
    specs = load_specs(options.tables) if options.tables else default_specs()
    [spec] = [spec for spec in specs if spec.source_table == options.table]
    schema = parquet_table(warehouse.spark, options.landing).schema
    keys = options.distinct_on.split(",") if options.distinct_on else list(source_keys(spec))
    with batch_figures(warehouse, spec) as figures:
        query = stream_load(
            warehouse, spec, landing_stream(warehouse, options.landing, schema), options.checkpoint,
            rules=_rules(options), distinct_on=keys, distinct_within=options.distinct_within,
        )
        query.awaitTermination()
        figures.wait(query)
    warehouse.stream_figures(spec.dest_table).orderBy("stream", "batch").show(truncate=False)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="doorflux")
    parser.add_argument("--master", help="local[8] and the like; omit under spark-submit")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name, run):
        added = jobs.add_parser(name)
        added.add_argument("--warehouse", required=True)
        added.set_defaults(run=run)
        return added

    loading = job("load", load)
    loading.add_argument("--source", action="append", default=[], metavar="TABLE=PATH")
    loading.add_argument("--jdbc-url")
    loading.add_argument("--tables")
    loading.add_argument("--offsets")
    loading.add_argument("--lookback")
    loading.add_argument("--rules", help="JSON or YAML of the business rules that differ")
    loading.add_argument("--database", help="show the tables and the view in this catalog database")
    loading.add_argument("--out", help="folder for the figures of the run")
    loading.add_argument(
        "--split", action="append", default=[], metavar="TABLE=COLUMN,LOWER,UPPER,PARTS",
        help="read a database table in parallel ranges of a column",
    )

    showing = job("dashboard", show_dashboard)
    showing.add_argument("--out", required=True)
    showing.add_argument("--period", default="day")
    showing.add_argument("--start")
    showing.add_argument("--end")
    showing.add_argument("--as-of", help="without dates: the day whose period is shown")
    showing.add_argument("--rules", help="JSON or YAML of the business rules that differ")
    showing.add_argument("--store", default=ALL_STORES)

    job("stores", stores).add_argument("--out", required=True)
    job("compact", compact).add_argument("--rules", help="JSON or YAML of the business rules that differ")

    viewing = job("view", view)
    viewing.add_argument("--database", required=True)
    viewing.add_argument("--rules", help="JSON or YAML of the business rules that differ")

    streaming = job("stream", stream)
    streaming.add_argument("--table", required=True, help="the source table whose rows land")
    streaming.add_argument("--landing", required=True, help="folder of Parquet files")
    streaming.add_argument("--checkpoint", required=True)
    streaming.add_argument("--tables")
    streaming.add_argument("--rules", help="JSON or YAML of the business rules that differ")
    streaming.add_argument("--distinct-within", help="load a repeated row once within this span")
    streaming.add_argument("--distinct-on", help="source columns that tell rows apart; the natural key by default")
    return parser


if __name__ == "__main__":
    sys.exit(main())
