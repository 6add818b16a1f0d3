"""Loading: extract, clean, check, write, publish and advance the mark."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorflux.config import (
    DEFAULT_MARK,
    DEFAULT_OFFSETS,
    DEFAULT_RULES,
    BusinessRules,
    TableSpec,
    default_specs,
    in_load_order,
)
from doorflux.functions.periods import interval, ntz
from doorflux.operators.clean import clean, keep_source_time
from doorflux.operators.quality import contract_for, flag
from doorflux.plans.warehouse import Commit, History, Load, Warehouse
from doorflux.sources.scan import extract

logger = logging.getLogger(__name__)

# What tells two records apart, used only with a lookback.
NATURAL_KEYS = {
    "fact_traffic": ("store_id", "device_position", "recorded_at"),
    "fact_errors": ("log_id",),
}


def source_keys(spec: TableSpec) -> tuple[str, ...]:
    """The source columns of a table's natural key."""
    source = {spec.stored_name(name): name for name in spec.source_columns}
    return tuple(source[key] for key in NATURAL_KEYS[spec.dest_table])


Offsets = Mapping[str, Mapping[int, int]]


@dataclass(frozen=True)
class Loaded:
    """The outcome of loading one table."""

    spec: TableSpec
    load: Load
    commit: Commit

    @property
    def published(self) -> bool:
        return self.load.load_id in self.commit.loads


def prepare(rows: DataFrame, spec: TableSpec, offsets: Offsets = DEFAULT_OFFSETS) -> DataFrame:
    """Raw source rows, cleaned and checked against the table's contract."""
    return checked(clean(keep_source_time(rows, spec), spec, offsets), spec)


def checked(cleaned: DataFrame, spec: TableSpec, taken: DataFrame | None = None) -> DataFrame:
    """Cleaned rows with their failures; ``taken`` holds rows whose keys are in use."""
    contract = contract_for(spec)
    if contract is None:
        logger.warning("no contract for %s: rows are not checked", spec.dest_table)
        return cleaned
    return flag(cleaned, contract, taken=taken)


def load_table(
    warehouse: Warehouse,
    spec: TableSpec,
    source: DataFrame,
    offsets: Offsets = DEFAULT_OFFSETS,
    rules: BusinessRules = DEFAULT_RULES,
    lookback: str | None = None,
    rebalance: bool = True,
    cluster: bool = False,
) -> Loaded:
    """Load one table: everything, or what is newer than its mark.

    The mark is the newest *source* time written, of accepted and of quarantined rows,
    in microseconds, because the extract compares source times. Rows older than the mark are not seen again
    unless a ``lookback`` is given; then rows already published are left out.
    """
    history = warehouse.history(spec.dest_table)
    mark = history.mark
    rows = extract(source, spec, mark, lookback)
    if spec.incremental and lookback is not None and mark != DEFAULT_MARK:
        rows = _unpublished(warehouse, spec, rows, offsets, mark, lookback)
    return write_and_publish(
        warehouse, spec, rows, history.next_load_id, history, offsets, rules, rebalance, cluster=cluster
    )


def write_and_publish(
    warehouse: Warehouse,
    spec: TableSpec,
    rows: DataFrame,
    load_id: str,
    history: History,
    offsets: Offsets = DEFAULT_OFFSETS,
    rules: BusinessRules = DEFAULT_RULES,
    rebalance: bool = True,
    batch: tuple[str, int] | None = None,
    cluster: bool = False,
) -> Loaded:
    """Clean, check, write and publish; ``batch`` names the stream and batch of the rows.

    A table with unique keys is checked on rows that are written once, so that the
    source is read once; its keys must differ from the published ones too, unless
    the load replaces those. Only loads and months whose keys may be among the new ones
    are read for that.
    """
    name, contract = spec.dest_table, contract_for(spec)
    cleaned = clean(keep_source_time(rows, spec), spec, offsets)
    twice = contract is not None and bool(contract.unique_fields)
    if twice:
        cleaned = warehouse.staged(cleaned, name)
    taken = None
    if twice and spec.incremental and history.current.loads:
        keys = [field.name for field in contract.unique_fields]
        taken = warehouse.where_it_may_be(name, keys[0], cleaned) if len(keys) == 1 else warehouse.table(name)
    load = warehouse.write_load(checked(cleaned, spec, taken), spec, load_id, rebalance, cluster)
    if name == "fact_traffic" and load.rows:
        load = warehouse.write_rollup(load, rules)
    return Loaded(spec, load, warehouse.publish(spec, load, history, batch))


def _unpublished(
    warehouse: Warehouse,
    spec: TableSpec,
    rows: DataFrame,
    offsets: Offsets,
    mark: str,
    lookback: str,
) -> DataFrame:
    """Rows whose natural key is not published yet, each key once.

    Only the loads and months that can lie in the lookback are read: a stored time
    is the source time less the largest clock offset, at most. Both sides enter
    the join as plain scans, so adaptive execution can split a hot key.
    """
    keys = NATURAL_KEYS[spec.dest_table]
    largest = max([0, *offsets.get(spec.bare_source_name, {}).values()])
    oldest = ntz(mark) - interval(lookback) - interval(f"{largest} minutes")
    time = spec.final_timestamp_col
    known = warehouse.between(spec.dest_table, time, oldest).filter(F.col(time) > oldest)
    keyed = _stored_beside_raw(rows, spec, offsets).dropDuplicates(list(keys))
    return _without_known(keyed, known, keys, rows.columns)


def unseen(
    warehouse: Warehouse,
    spec: TableSpec,
    rows: DataFrame,
    keys: Sequence[str],
    within: str,
    offsets: Offsets = DEFAULT_OFFSETS,
) -> DataFrame:
    """Rows of a batch that repeat none before them, in the batch or published.

    A row repeats another with the same ``keys`` (source columns) whose stored time is less than
    ``within`` away; a chain of such rows keeps its first. What is published is
    the memory: of it, the loads and months are read whose times the batch's rows may
    repeat. A batch in time reads the last loads, a late row those of its own time,
    so no row is taken for repeated, or dropped, for being late.
    """
    time = spec.final_timestamp_col
    stored = [spec.stored_name(key) for key in keys]
    keyed = _stored_beside_raw(rows, spec, offsets).dropDuplicates(list(dict.fromkeys([*stored, time])))
    span = None
    if time not in stored:
        span = interval(within)
        before = F.lag(time).over(Window.partitionBy(*stored).orderBy(time))
        keyed = keyed.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(time) - F.col("_before") >= span))
        keyed = keyed.drop("_before")
    if not warehouse.commit(spec.dest_table).loads:
        return keyed.select(*[F.col(f"_raw_{name}").alias(name) for name in rows.columns])
    known = warehouse.where_it_may_be(spec.dest_table, time, keyed, margin=span)
    return _without_known(keyed, known, stored, rows.columns, time, span)


def _stored_beside_raw(rows: DataFrame, spec: TableSpec, offsets: Offsets) -> DataFrame:
    """The rows as they will be stored, beside their raw columns."""
    raw = [F.col(name).alias(f"_raw_{name}") for name in rows.columns]
    return clean(rows.select("*", *raw), spec, offsets)


def _without_known(
    keyed: DataFrame, known: DataFrame, keys: Sequence[str], columns: Sequence[str],
    time: str | None = None, span: Column | None = None,
) -> DataFrame:
    names = [*keys, *([time] if span is not None else [])]
    known = known.select(*[F.col(name).alias(f"_known_{name}") for name in names])
    same = [F.col(key).eqNullSafe(F.col(f"_known_{key}")) for key in keys]
    if span is not None:
        apart = F.col(time) - F.col(f"_known_{time}")
        same.append((apart < span) & (-apart < span))
    fresh = keyed.join(known, same, "left_anti")
    return fresh.select(*[F.col(f"_raw_{name}").alias(name) for name in columns])


def run_etl(
    warehouse: Warehouse,
    sources: Mapping[str, DataFrame],
    specs: Iterable[TableSpec] | None = None,
    offsets: Offsets = DEFAULT_OFFSETS,
    rules: BusinessRules = DEFAULT_RULES,
    lookback: str | None = None,
    database: str | None = None,
) -> DataFrame:
    """Load all tables, dimensions first, and return one row of figures each.

    ``sources`` holds the raw table of each spec by its source table name. A
    table that fails is reported as such and the others are still loaded. With a
    ``database`` each table is shown in the catalog with its statistics, and the
    view of normalised traffic over them.
    """
    figures = []
    specs = in_load_order(default_specs() if specs is None else specs)
    for spec in specs:
        try:
            done = load_table(
                warehouse, spec, sources[spec.source_table], offsets, rules, lookback
            )
            if database is not None and contract_for(spec) is not None:
                warehouse.publish_to_catalog(spec, database)
        except Exception as error:
            logger.exception("loading %s failed", spec.dest_table)
            figures.append((spec.processing_order, spec.dest_table, "failed", 0, 0, False, None, str(error)))
            continue
        load = done.load
        figures.append((
            spec.processing_order,
            spec.dest_table,
            "succeeded",
            load.rows,
            load.rejected,
            done.published,
            done.commit.mark,
            None,
        ))
    if database is not None and {"fact_traffic", "dim_stores"} <= {spec.dest_table for spec in specs}:
        warehouse.publish_view(database, rules)
    return warehouse.spark.createDataFrame(
        figures,
        "processing_order int, dest_table string, status string, rows_loaded bigint, "
        "rows_rejected bigint, published boolean, mark string, error string",
    )


def run_summary(figures: DataFrame) -> DataFrame:
    """How many tables there were, and how many succeeded and failed."""
    return figures.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
