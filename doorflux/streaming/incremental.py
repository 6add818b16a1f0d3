"""Loading files as they land; the checkpoint replaces the high-water mark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.storagelevel import StorageLevel

from doorflux.config import DEFAULT_MARK, DEFAULT_OFFSETS, DEFAULT_RULES, BusinessRules, TableSpec
from doorflux.functions.periods import ntz
from doorflux.plans.load import Offsets, unseen, write_and_publish
from doorflux.plans.warehouse import Warehouse
from doorflux.sources.scan import project

#: The name under which a stream's arriving rows are counted.
ARRIVED = "arrived"


class BatchFigures(StreamingQueryListener):
    """Records what arrived in each batch and how long it took, beside the loads' own figures."""

    def __init__(self, warehouse: Warehouse, spec: TableSpec):
        self._warehouse, self._spec = warehouse, spec
        self._ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(ARRIVED)
        if seen is not None and progress.numInputRows:
            values = {"arrived": seen["rows"], "seconds": progress.batchDuration / 1000}
            self._warehouse.record_batch(self._spec.dest_table, str(progress.id), "progress", progress.batchId, values)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.runId).set()

    def _of(self, run) -> Event:
        return self._ended.setdefault(str(run), Event())

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all figures of an ended query have come in."""
        self._of(query.runId).wait(seconds)


@contextmanager
def batch_figures(warehouse: Warehouse, spec: TableSpec) -> Iterator[BatchFigures]:
    """Streams started inside leave figures that ``Warehouse.stream_figures`` shows."""
    listener = BatchFigures(warehouse, spec)
    warehouse.spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        warehouse.spark.streams.removeListener(listener)


def landing_stream(
    warehouse: Warehouse, folder: str, schema: str, file_glob: str = "*.parquet"
) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    reader = warehouse.spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return reader.parquet(folder)


def stream_load(
    warehouse: Warehouse,
    spec: TableSpec,
    stream: DataFrame,
    checkpoint: str,
    offsets: Offsets = DEFAULT_OFFSETS,
    rules: BusinessRules = DEFAULT_RULES,
    distinct_on: Sequence[str] = (),
    distinct_within: str | None = None,
    on_loaded: Callable | None = None,
) -> StreamingQuery:
    """Load all files not loaded before, then stop.

    A load's commit notes the stream, by the id that its checkpoint keeps, and the
    batch: a batch that is run again after a failure is published once, and streams
    into one table do not take each other's batches for their own. A late row is
    loaded whenever its file lands. With ``distinct_within`` (an interval) a row
    is loaded once per ``distinct_on`` key within that span of stored time, however late it
    or its repeat comes, also after a restart or with a new checkpoint: rows are
    compared with what is published (see ``unseen``), and none is dropped for its age.
    """
    rows = project(stream, spec).observe(ARRIVED, F.count(F.lit(1)).alias("rows"))

    started: list[StreamingQuery] = []
    known = Event()

    def load(batch: DataFrame, number: int) -> None:
        known.wait()
        stream = str(started[0].id)
        history = warehouse.history(spec.dest_table)
        if history.current.streams.get(stream, -1) >= number:
            return  # recorded before a failure kept the checkpoint from noting it
        late = 0
        if distinct_within is not None:
            # read for the times it holds, for what is late, and for the load
            batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            fresh = batch
            if distinct_within is not None:
                mark = F.lit(False) if history.mark == DEFAULT_MARK else F.col(spec.timestamp_col) < ntz(history.mark)
                late = batch.agg(F.count_if(mark)).first()[0]
                fresh = unseen(warehouse, spec, batch, distinct_on, distinct_within, offsets)
            done = write_and_publish(
                warehouse, spec, fresh, history.next_load_id, history, offsets, rules, batch=(stream, number)
            )
        finally:
            if distinct_within is not None:
                batch.unpersist()
        warehouse.record_batch(spec.dest_table, stream, "load", number, {
            "load_id": done.load.load_id, "rows": done.load.rows, "rejected": done.load.rejected, "late": late,
            "published": done.published, "mark": done.commit.mark,
        })
        if on_loaded is not None:
            on_loaded(done)

    query = (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.append(query)
    known.set()
    return query
