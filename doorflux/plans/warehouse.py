"""The warehouse folder: written loads, published versions, marks.

Layout of a table::

    <root>/<table>/data/load_id=…/outcome=accepted|rejected[/year=…/month=…]
    <root>/<table>/figures/load_id=…  rows, bounds and sketches of a load, by month
    <root>/<table>/commits/v=N      one JSON record: what is published, and the mark
    <root>/<table>/commits/newest   N of the newest record, or of one not long before
    <root>/<table>/streams/…        figures of stream batches
    <root>/<table>/staged           the cleaned rows of the last load of a table with unique keys

A load writes only its own folder and is invisible until a commit names it. The
commit carries the loads, those with quarantined rows, the high-water mark, the newest
stored time, the last batch of each stream and the rules of the hourly sums
together, so they never disagree; what a load knows of its months lies beside its rows. Every load that wrote a row is recorded, also one
without a good row, so no number is given out twice; a repeated attempt
overwrites the folder of the failed one, which no commit names. Nothing a reader may be
reading is ever changed. One writer per table at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from doorflux.config import DEFAULT_MARK, DEFAULT_RULES, BusinessRules, TableSpec
from doorflux.operators import histogram
from doorflux.operators.clean import SOURCE_TIME
from doorflux.operators.normalize import VIEW_NAME, Traffic, business_time, cap_outlier, register_view
from doorflux.operators.quality import CONTRACTS, FAILURES, PASSED
from doorflux.plans.figures import bins_of, figures_of, overlapping, schema_of, statistics
from doorflux.sources.files import child_names, exists, read_text, write_text

_FAILURES_DDL = f"{FAILURES} array<struct<column:string,check:string,failure_case:string>>"
_ROLLUP = (
    "record_time timestamp_ntz, store_id bigint, in_count bigint, out_count bigint, "
    "visitors_in bigint, visitors_out bigint, records bigint, grain string, year int, month int"
)
ROLLUP_TABLE = "traffic_hourly"
_KEPT = "outcome = 'accepted'"
#: The table property that keeps the number of the last load shown in the catalog.
_SHOWN = "doorflux.shown"


@dataclass(frozen=True)
class Commit:
    """A published version; version 0 is the table before its first load."""

    version: int = 0
    loads: tuple[str, ...] = ()
    rows: int = 0
    rejected: int = 0
    mark: str | None = None
    #: Finished loads with quarantined rows, published or not.
    rejects: tuple[str, ...] = ()
    #: The last batch of each stream that has been recorded.
    streams: Mapping[str, int] = field(default_factory=dict)
    #: The rules that a load's hourly and daily sums were made with.
    caps: Mapping[str, str] = field(default_factory=dict)
    #: The newest time stored in a published load.
    newest: str | None = None


@dataclass(frozen=True)
class History:
    """The published version, and the newest version number ever used."""

    current: Commit = Commit()
    newest: int = 0

    @property
    def mark(self) -> str:
        return self.current.mark or DEFAULT_MARK

    @property
    def next_load_id(self) -> str:
        return f"L{self.newest + 1:08d}"


@dataclass(frozen=True)
class Load:
    """What one load wrote, counted while it was written."""

    load_id: str
    rows: int
    rejected: int
    mark: str | None
    caps: str | None = None
    newest: str | None = None


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- writing ---------------------------------------------------------------

    def write_load(
        self, rows: DataFrame, spec: TableSpec, load_id: str, rebalance: bool = True, cluster: bool = False
    ) -> Load:
        """Write good and failed rows in one pass over the source.

        ``rebalance`` shuffles by partition and lets adaptive execution cut large
        partitions and join small ones, so that a month holding a third of the
        rows is written by many tasks and no task writes a file for every month.
        Turn it off for a source that already arrives in time order.

        With ``cluster`` the rows go by ranges of month and store instead, whose bounds
        Spark samples, so a file holds few stores and a chosen store touches few files; a
        store with many records is cut by time. The sample reads ``rows`` once more: use
        it for a source that is cheap to read, as ``compact`` does.
        """
        good = F.col(PASSED) if PASSED in rows.columns else F.lit(True)
        rows = rows.withColumn("outcome", F.when(good, "accepted").otherwise("rejected"))
        parts = ["outcome", *spec.partition_cols]
        order = [*parts, *[name for name in ("store_id", spec.final_timestamp_col) if name in rows.columns]]
        if cluster:
            rows = rows.repartitionByRange(*order)
        elif rebalance and spec.partition_cols:
            rows = rows.hint("rebalance", *parts)
        rows = rows.sortWithinPartitions(*order)

        kept = F.col("outcome") == "accepted"
        source_time = F.col(SOURCE_TIME) if SOURCE_TIME in rows.columns else F.lit(None).cast("timestamp_ntz")
        time = spec.final_timestamp_col
        stored_time = F.col(time).cast("timestamp_ntz") if time in rows.columns else F.lit(None).cast("timestamp_ntz")
        seen = Observation()
        # Counted in the stage that writes: a lost executor cannot count twice.
        rows = rows.observe(
            seen,
            F.count_if(kept).alias("rows"),
            F.count_if(~kept).alias("rejected"),
            F.max(source_time).cast("string").alias("mark"),
            F.max(F.when(kept, stored_time)).cast("string").alias("newest"),
        )
        path = f"{self._data(spec.dest_table)}/load_id={load_id}"
        rows.drop(SOURCE_TIME, PASSED).write.mode("overwrite").partitionBy(*parts).parquet(path)
        counts = seen.get
        return Load(load_id, counts["rows"], counts["rejected"], counts["mark"], newest=counts["newest"])

    def staged(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written once, for checks that read them more than once.

        They stay until the next load of the table takes their place.
        """
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/staged")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}/staged")

    def write_rollup(self, load: Load, rules: BusinessRules = DEFAULT_RULES) -> Load:
        """The sums of one traffic load at three grains, from what the load wrote."""
        fact = self._loads("fact_traffic", [load.load_id])
        self._write_rollup(histogram.grains_of_records(fact, rules), load.load_id)
        return replace(load, caps=caps_of(rules))

    def _write_rollup(self, grains: DataFrame, load_id: str) -> None:
        path = f"{self._data(ROLLUP_TABLE)}/load_id={load_id}"
        parts = ["grain", "year", "month"]
        rows = grains.hint("rebalance", *parts).sortWithinPartitions(*parts, "store_id", "record_time")
        rows.write.mode("overwrite").partitionBy(*parts).parquet(path)

    def write_figures(self, spec: TableSpec, load_id: str) -> None:
        """What a load knows of itself; a few rows, from the columns it wrote."""
        if spec.dest_table in CONTRACTS:
            found = figures_of(self._loads(spec.dest_table, [load_id]), spec)
            found.write.mode("overwrite").parquet(f"{self._figures(spec.dest_table)}/load_id={load_id}")

    def publish(
        self,
        spec: TableSpec,
        load: Load,
        history: History | None = None,
        batch: tuple[str, int] | None = None,
    ) -> Commit:
        """Record a load, and make it visible if it holds a good row.

        A full load replaces what was published, an incremental one adds to it. A load
        without any row changes nothing. ``batch`` names the stream and batch it is.
        """
        name = spec.dest_table
        history = self.history(name) if history is None else history
        current = history.current
        if load.rows + load.rejected == 0 or load.load_id in (*current.loads, *current.rejects):
            return current
        marks = [mark for mark in (current.mark, load.mark) if mark]
        commit = replace(
            current,
            version=history.newest + 1,
            rows=load.rows,
            rejected=load.rejected,
            mark=max(marks) if spec.incremental and marks else None,
            # a full load brings its bad rows again: those of the last one count
            rejects=(*(current.rejects if spec.incremental else ()), *([load.load_id] if load.rejected else [])),
            streams={**current.streams, **(dict([batch]) if batch else {})},
        )
        if load.rows:
            self.write_figures(spec, load.load_id)
            earlier = current if spec.incremental else Commit()
            times = [time for time in (earlier.newest, load.newest) if time]
            commit = replace(
                commit,
                loads=(*earlier.loads, load.load_id),
                caps={**earlier.caps, **({load.load_id: load.caps} if load.caps else {})},
                newest=max(times) if times else None,
            )
        return self._record(name, commit)

    def compact(self, spec: TableSpec, rules: BusinessRules = DEFAULT_RULES) -> Commit:
        """Publish the loads since the last compaction as one, so that readers list few folders.

        Its files are clustered by store, and its sums are made anew from the histograms,
        under ``rules``.

        All else that is recorded stays. The loads merged here remain for readers of
        the version before.
        """
        name = spec.dest_table
        history = self.history(name)
        current = history.current
        small = [load for load in current.loads if not load.startswith("C")]
        if len(small) < 2:
            return current
        load_id = f"C{history.newest + 1:08d}"
        load = self.write_load(self._loads(name, small), spec, load_id, cluster=True)
        if name == "fact_traffic" and all(each in current.caps for each in small):
            self._write_rollup(histogram.grains_of_values(self._rollup(small, "value"), rules), load_id)
            load = replace(load, caps=caps_of(rules))
        self.write_figures(spec, load_id)
        kept = [each for each in current.loads if each not in small]
        return self._record(name, replace(
            current,
            version=history.newest + 1,
            loads=(*kept, load_id),
            rows=load.rows,
            rejected=0,
            caps={**{k: v for k, v in current.caps.items() if k in kept}, **({load_id: load.caps} if load.caps else {})},
        ))

    def _record(self, name: str, commit: Commit) -> Commit:
        folder = self._commits(name)
        write_text(self.spark, f"{folder}/v={commit.version}/record.json", json.dumps(asdict(commit)))
        write_text(self.spark, f"{folder}/newest", str(commit.version))
        return commit

    def publish_to_catalog(
        self, spec: TableSpec, database: str = "default", analyze: bool = True
    ) -> None:
        """Show the published version as a catalog view, by one catalog call.

        The loads live in one external table, to which the partitions of loads not yet
        shown are added: load numbers rise, and a property of the table keeps the last one
        shown. Statistics are taken of the newest load, of the whole of a table that is
        always loaded in full with all its columns; see also ``statistics``.
        """
        contract = CONTRACTS[spec.dest_table]
        commit = self.commit(spec.dest_table)
        table = f"{database}.{spec.dest_table}"
        loads = f"{table}_loads"
        parts = ["load_id", "outcome", *spec.partition_cols]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {loads} ({contract.ddl}, {_FAILURES_DDL}, "
            f"load_id string, outcome string) USING parquet PARTITIONED BY ({', '.join(parts)}) "
            f"LOCATION '{self._data(spec.dest_table)}'"
        )
        properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {loads}").collect()}
        shown = int(properties.get(_SHOWN, 0))
        unknown = [load for load in commit.loads if _number(load) > shown]
        new = [{"load_id": load, "outcome": "accepted"} for load in unknown]
        if spec.partition_cols and unknown:
            months = self.figures(spec.dest_table, unknown).select("load_id", "year", "month").collect()
            new = [{"load_id": m.load_id, "outcome": "accepted", "year": m.year, "month": m.month} for m in months]
        for start in range(0, len(new), 500):
            added = " ".join(f"PARTITION ({_assigned(w)})" for w in new[start:start + 500])
            self.spark.sql(f"ALTER TABLE {loads} ADD IF NOT EXISTS {added}")
        if unknown:
            newest = max(map(_number, unknown))
            self.spark.sql(f"ALTER TABLE {loads} SET TBLPROPERTIES ('{_SHOWN}' = '{newest}')")
        published = ", ".join(f"'{load}'" for load in commit.loads) or "NULL"
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {table} AS SELECT {', '.join(contract.names)} FROM {loads} "
            f"WHERE outcome = 'accepted' AND load_id IN ({published})"
        )
        if not (analyze and commit.loads):
            return
        if spec.incremental:
            free = ", ".join(["outcome", *spec.partition_cols])
            newest = f"PARTITION (load_id = '{commit.loads[-1]}', {free})"
            self.spark.sql(f"ANALYZE TABLE {loads} {newest} COMPUTE STATISTICS")
        else:
            columns = ", ".join(contract.names)
            self.spark.sql(f"ANALYZE TABLE {loads} COMPUTE STATISTICS FOR COLUMNS {columns}")

    def publish_view(self, database: str = "default", rules: BusinessRules = DEFAULT_RULES) -> None:
        """Define or replace the lasting view of normalised traffic over the catalog's views.

        The outlier rule and the business time become functions of the catalog, made from
        the library's own expressions; the view, and any query, calls them by name.
        """
        count, moment = F.col("count"), F.col("moment")
        functions = (
            ("cap_outlier", "count", "bigint", "bigint", cap_outlier(count, rules)),
            ("business_time", "moment", "timestamp_ntz", "timestamp_ntz", business_time(moment, rules)),
        )
        for name, argument, takes, gives, body in functions:
            self.spark.sql(
                f"CREATE OR REPLACE FUNCTION {database}.{name}({argument} {takes}) RETURNS {gives} "
                f"RETURN {_sql_of(self.spark, body, argument, takes)}"
            )
        self.spark.sql(
            f"""CREATE OR REPLACE VIEW {database}.{VIEW_NAME} AS
                SELECT f.recorded_at AS record_time, s.store_name,
                       {database}.cap_outlier(f.visitors_in) AS in_count,
                       {database}.cap_outlier(f.visitors_out) AS out_count,
                       {database}.business_time(f.recorded_at) AS adjusted_time
                FROM {database}.fact_traffic f LEFT JOIN {database}.dim_stores s ON f.store_id = s.store_id"""
        )

    # -- reading ---------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """The published rows, with the contract's columns."""
        return self._loads(name, self.commit(name).loads)

    def figures(self, name: str, loads: Iterable[str] | None = None) -> DataFrame:
        """The figures of the published loads, or of those named: a row for each load and month."""
        loads = self.commit(name).loads if loads is None else loads
        paths = [f"{self._figures(name)}/load_id={load}" for load in loads]
        schema = schema_of(CONTRACTS[name])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._figures(name)).parquet(*paths)

    def statistics(self, name: str) -> DataFrame:
        """Rows, nulls, bounds and distinct values of each column, merged from the loads' figures."""
        return statistics(self.figures(name), CONTRACTS[name])

    def where_it_may_be(
        self, name: str, column: str, values: DataFrame, own: str | None = None, margin: Column | None = None
    ) -> DataFrame:
        """The published rows of the loads and months whose bounds meet the values of a batch,
        or come as near as ``margin``.

        ``own`` is the values' column, if it is named otherwise. No other load is read.
        """
        kind = self._type(name, column)
        ranges = bins_of(values.select(F.col(own or column).try_cast(kind).alias(column)), column)
        if margin is not None:
            ranges = ranges.select((F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high"))
        return self._zones(name, column, ranges)

    def between(self, name: str, column: str, low: Column | None, high: Column | None = None) -> DataFrame:
        """The published rows of the loads and months whose bounds meet ``low`` to ``high``."""
        kind = self._type(name, column)
        ends = [F.lit(None) if end is None else end for end in (low, high)]
        return self._zones(name, column, self.spark.range(1).select(ends[0].cast(kind).alias("low"), ends[1].cast(kind).alias("high")))

    @staticmethod
    def _type(name: str, column: str) -> str:
        return next(f.type for f in CONTRACTS[name].fields if f.name == column)

    def _zones(self, name: str, column: str, ranges: DataFrame) -> DataFrame:
        zones = overlapping(self.figures(name), column, ranges)
        rows = self._loads(name, sorted({zone["load_id"] for zone in zones}))
        months = {(zone["year"], zone["month"]) for zone in zones if zone["year"] is not None}
        if not months or {"year", "month"} - set(rows.columns):
            return rows
        # a month that some load of these is read for; others of it are left out by their bounds
        years: dict[int, list[int]] = {}
        for year, month in sorted(months):
            years.setdefault(year, []).append(month)
        touched = F.lit(False)
        for year, of_year in years.items():
            touched = touched | ((F.col("year") == year) & F.col("month").isin(of_year))
        return rows.filter(touched)

    def newest(self, name: str, rows: int) -> DataFrame:
        """The newest months of a table that together hold ``rows`` rows, by its figures."""
        loads = self.commit(name).loads
        held = self.figures(name, loads).groupBy("year", "month").agg(F.sum("rows").alias("rows"))
        seen, first = 0, None
        for month in held.orderBy(F.desc("year"), F.desc("month")).collect():
            first, seen = month, seen + month["rows"]
            if seen >= rows:
                break
        table = self._loads(name, loads)
        if first is None or first["year"] is None:
            return table
        later = (F.col("year") == first["year"]) & (F.col("month") >= first["month"])
        return table.filter((F.col("year") > first["year"]) | later)

    def latest_record_time(self, name: str = "fact_traffic") -> DataFrame:
        """One row: the newest time published, NULL if there is none; no file is read."""
        row = self.spark.createDataFrame([(self.commit(name).newest,)], "newest string")
        return row.select(F.col("newest").cast("timestamp_ntz").alias("latest_record_time"))

    def rollup(self, grain: str = "hour") -> DataFrame:
        """Sums of the published traffic loads by hour or business ``day``."""
        return self._rollup(self.commit("fact_traffic").loads, grain).select(*histogram.SUMS)

    def _rollup(self, loads: Iterable[str], grain: str) -> DataFrame:
        data = self._data(ROLLUP_TABLE)
        paths = [f"{data}/load_id={load}/grain={grain}" for load in loads]
        if not paths:
            return self.spark.createDataFrame([], _ROLLUP).drop("grain")
        reader = self.spark.read.schema(f"{_ROLLUP}, load_id string").option("basePath", data)
        return reader.parquet(*paths).drop("load_id", "grain")

    def rejected(self, name: str) -> DataFrame:
        """The rows of every finished load that broke the contract, with their failures."""
        data = self._data(name)
        paths = [f"{data}/load_id={load}/outcome=rejected" for load in self.commit(name).rejects]
        if not paths:
            return self.spark.createDataFrame([], self._schema(name)).drop("outcome")
        reader = self.spark.read.schema(self._schema(name)).option("basePath", data)
        return reader.parquet(*paths).drop("outcome")

    def history(self, name: str) -> History:
        """The state of a table; an unreadable or missing record counts as none.

        The newest number is looked for from the one noted last; only its record is read,
        unless it cannot be.
        """
        newest = self._newest_version(name)
        for version in range(newest, 0, -1):
            current = self._read_record(name, version)
            if current is not None:
                return History(current, newest)
        return History(newest=newest)

    def _newest_version(self, name: str) -> int:
        path = self._commits(name)
        noted = (read_text(self.spark, f"{path}/newest") or "").strip()
        if not noted.isdecimal():
            versions = [int(child[2:]) for child in child_names(self.spark, path) if child.startswith("v=")]
            return max(versions, default=0)
        version = int(noted)
        while exists(self.spark, f"{path}/v={version + 1}"):
            version += 1
        return version

    def _read_record(self, name: str, version: int) -> Commit | None:
        text = read_text(self.spark, f"{self._commits(name)}/v={version}/record.json")
        try:
            found = json.loads(text or "")
        except ValueError:
            return None
        if not isinstance(found, dict) or found.get("loads") is None:
            return None
        known = {f.name for f in fields(Commit)}
        values = {key: value for key, value in found.items() if key in known}
        for key in ("loads", "rejects"):
            values[key] = tuple(values.get(key) or ())
        return Commit(**{**values, "version": version})

    def commit(self, name: str) -> Commit:
        """The published version."""
        return self.history(name).current

    def mark(self, spec: TableSpec) -> str:
        return self.history(spec.dest_table).mark

    def marks(self, specs: Iterable[TableSpec]) -> DataFrame:
        """The high-water mark of each incremental table."""
        rows = [(spec.dest_table, self.mark(spec)) for spec in specs if spec.incremental]
        marks = self.spark.createDataFrame(rows, "dest_table string, mark string")
        return marks.withColumn("mark", F.col("mark").cast("timestamp_ntz"))

    def traffic(self, rules: BusinessRules = DEFAULT_RULES, hourly: bool = False) -> Traffic:
        """The published traffic for the dashboard queries."""
        stores, commit = self.table("dim_stores"), self.commit("fact_traffic")
        made = [commit.caps.get(load) for load in commit.loads]
        if not hourly or None in made:
            return Traffic.from_fact(self._loads("fact_traffic", commit.loads), stores, rules)
        caps, opening = caps_of(rules).rsplit(" ", 1)
        if any(each.rsplit(" ", 1)[0] != caps for each in made):
            # sums capped under other rules answer another question; histograms answer any
            values = self._rollup(commit.loads, "value")
            return Traffic.from_rollup(histogram.capped_sums(values, rules), stores, rules)
        hours, days = self._rollup(commit.loads, "hour").select(*histogram.SUMS), None
        if all(each.rsplit(" ", 1)[1] == opening for each in made):
            days = self._rollup(commit.loads, "day").select(*histogram.SUMS)
        return Traffic.from_rollup(hours, stores, rules, days)

    def traffic_of(self, store: str, rules: BusinessRules = DEFAULT_RULES, hourly: bool = False) -> Traffic:
        """The traffic of the stores of one name: their ids, up to a thousand, reach the scans."""
        traffic = self.traffic(rules, hourly)
        named = traffic.stores.filter(F.col("store_name") == store)
        ids = [row["store_id"] for row in named.select("store_id").limit(1001).collect()]
        return traffic if len(ids) > 1000 else traffic.of_stores(ids)

    def register_views(self, rules: BusinessRules = DEFAULT_RULES) -> None:
        """Session views of all tables and of the normalised traffic."""
        for name in CONTRACTS:
            self.table(name).createOrReplaceTempView(name)
        register_view(self.table("fact_traffic"), self.table("dim_stores"), rules)

    def record_batch(self, name: str, stream: str, kind: str, batch: int, values: Mapping) -> None:
        """Figures of a stream's batch; those of a batch that runs again take the place of the first."""
        path = f"{self.root}/{name}/streams/{kind}-{stream}-{batch:08d}.json"
        write_text(self.spark, path, json.dumps({"stream": stream, "batch": batch, **values}))

    def stream_figures(self, name: str) -> DataFrame:
        """One row per batch of each stream into a table: what arrived, was late, loaded and set aside."""
        folder = f"{self.root}/{name}/streams"
        loaded = "load_id string, rows bigint, rejected bigint, late bigint, published boolean, mark string"
        arrived = "arrived bigint, seconds double"
        found = []
        for kind, columns in (("load", loaded), ("progress", arrived)):
            schema = f"stream string, batch bigint, {columns}"
            if any(child.startswith(kind) for child in child_names(self.spark, folder)):
                found.append(self.spark.read.schema(schema).option("pathGlobFilter", f"{kind}-*.json").json(folder))
            else:
                found.append(self.spark.createDataFrame([], schema))
        return found[0].join(found[1], ["stream", "batch"], "left")

    # -- helpers ---------------------------------------------------------------

    def _data(self, name: str) -> str:
        return f"{self.root}/{name}/data"

    def _figures(self, name: str) -> str:
        return f"{self.root}/{name}/figures"

    def _commits(self, name: str) -> str:
        return f"{self.root}/{name}/commits"

    def _schema(self, name: str) -> str:
        return f"{CONTRACTS[name].ddl}, {_FAILURES_DDL}, load_id string, outcome string"

    def _loads(self, name: str, loads: Iterable[str]) -> DataFrame:
        """Only the named loads are listed; a contract's schema is not inferred."""
        contract = CONTRACTS.get(name)
        data = self._data(name)
        paths = [f"{data}/load_id={load}" for load in loads]
        if not paths:
            if contract is None:
                raise ValueError(f"{name} has not been loaded")
            return self.spark.createDataFrame([], contract.ddl)
        reader = self.spark.read.option("basePath", data)
        if contract is None:
            return reader.parquet(*paths).filter(_KEPT).drop("load_id", "outcome")
        rows = reader.schema(self._schema(name)).parquet(*paths)
        return rows.filter(_KEPT).select(*contract.names)


def caps_of(rules: BusinessRules) -> str:
    """The rules that the sums depend on, as text: of hours the first two, of days all."""
    return f"{rules.outlier_threshold} {rules.outlier_scale_ratio!r} {rules.working_hour_start}"


def _number(load_id: str) -> int:
    return int(load_id[1:])


def _sql_of(spark: SparkSession, body: Column, argument: str, kind: str) -> str:
    """A column of one argument as SQL text."""
    made = spark.createDataFrame([], f"{argument} {kind}").select(body.alias("body"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql()


def _assigned(values: Mapping[str, object]) -> str:
    return ", ".join(f"{name} = {value!r}" for name, value in values.items())
