"""File-by-file loading with a checkpoint."""

from datetime import datetime

import pytest

from doorflux.config import TRAFFIC
from doorflux.plans.load import write_and_publish
from doorflux.plans.warehouse import Warehouse
from doorflux.streaming import stream_load
from doorflux.streaming.incremental import batch_figures, landing_stream
from tests.conftest import rows
from workloads.fixtures import RAW_TRAFFIC_SCHEMA as RAW


@pytest.fixture
def landing(spark, tmp_path):
    folder = tmp_path / "landing"

    def land(*records):
        values = [(datetime.fromisoformat(at), ins, 0, "door", 5) for at, ins in records]
        spark.createDataFrame(values, RAW).coalesce(1).write.mode("append").parquet(str(folder))

    land.folder = str(folder)
    return land


def run(warehouse, landing, tmp_path, **options):
    done = []
    stream = landing_stream(warehouse, landing.folder, RAW)
    stream_load(warehouse, TRAFFIC, stream, str(tmp_path / "checkpoint"), on_loaded=done.append, **options).awaitTermination()
    return done


def counts(warehouse):
    return sorted(row.visitors_in for row in warehouse.table("fact_traffic").collect())


def test_each_file_is_loaded_once(spark, warehouse, landing, tmp_path):
    landing(("2024-01-01 10:00:00", 1))
    assert len(run(warehouse, landing, tmp_path)) == 1
    assert run(warehouse, landing, tmp_path) == []
    landing(("2024-01-01 09:00:00", 2), ("2024-01-01 11:00:00", 3))  # one of them late
    run(warehouse, landing, tmp_path)
    assert counts(warehouse) == [1, 2, 3]
    commit = warehouse.commit("fact_traffic")
    assert len(commit.loads) == 2 and list(commit.streams.values()) == [1]


def forget_last_batch(tmp_path):
    """As if the job had died between publishing and noting the batch."""
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("compacted", [False, True])
def test_batch_run_again_is_published_once(spark, warehouse, landing, tmp_path, compacted):
    landing(("2024-01-01 10:00:00", 10))
    run(warehouse, landing, tmp_path)
    landing(("2024-01-01 11:00:00", 11))
    run(warehouse, landing, tmp_path)
    if compacted:
        warehouse.compact(TRAFFIC)
    forget_last_batch(tmp_path)
    assert run(warehouse, landing, tmp_path) == []
    assert counts(warehouse) == [10, 11]


def test_a_new_checkpoint_and_a_second_stream_lose_nothing(spark, warehouse, landing, tmp_path):
    landing(("2024-01-01 10:00:00", 10))
    run(warehouse, landing, tmp_path)
    other = tmp_path / "other"
    spark.createDataFrame([(datetime(2024, 1, 1, 9), 11, 0, "door", 5)], RAW).write.parquet(str(other))
    stream = landing_stream(warehouse, str(other), RAW)
    stream_load(warehouse, TRAFFIC, stream, str(tmp_path / "second")).awaitTermination()
    assert counts(warehouse) == [10, 11]
    assert len(warehouse.commit("fact_traffic").streams) == 2


def test_repeated_rows_within_the_watermark_are_loaded_once(spark, warehouse, landing, tmp_path):
    landing(("2024-01-01 10:00:00", 1), ("2024-01-01 10:00:00", 1))
    options = {"distinct_on": ("storeid", "position", "recordtime"), "distinct_within": "1 day"}
    run(warehouse, landing, tmp_path, **options)
    landing(("2024-01-01 10:00:00", 1), ("2024-01-01 12:00:00", 2))
    run(warehouse, landing, tmp_path, **options)
    assert counts(warehouse) == [1, 2]


def test_stream_equals_batch(spark, warehouse, landing, tmp_path):
    records = [(f"2024-01-01 {hour}:00:00", hour) for hour in range(10, 20)]
    landing(*records[:4])
    run(warehouse, landing, tmp_path)
    landing(*records[4:])
    run(warehouse, landing, tmp_path)
    other = Warehouse(spark, str(tmp_path / "batch"))
    batch = spark.read.schema(RAW).parquet(landing.folder)
    write_and_publish(other, TRAFFIC, batch, "L1", other.history("fact_traffic"))
    assert rows(other.table("fact_traffic")) == rows(warehouse.table("fact_traffic"))


NATURAL = ("storeid", "position", "recordtime")


def test_a_late_row_is_loaded_and_its_repeat_is_not(spark, warehouse, landing, tmp_path):
    options = {"distinct_on": NATURAL, "distinct_within": "1 day"}
    landing(("2024-01-10 10:00:00", 1))
    landing(("2024-01-10 11:00:00", 2))
    run(warehouse, landing, tmp_path, **options)
    landing(("2024-01-05 10:00:00", 3), ("2024-01-10 12:00:00", 4))  # the first is five days late
    run(warehouse, landing, tmp_path, **options)
    assert counts(warehouse) == [1, 2, 3, 4]
    landing(("2024-01-05 10:00:00", 3), ("2024-01-10 10:00:00", 1), ("2024-01-05 11:00:00", 5))
    run(warehouse, landing, tmp_path, **options)
    assert counts(warehouse) == [1, 2, 3, 4, 5]
    late = {r.batch: r.late for r in warehouse.stream_figures("fact_traffic").collect()}
    assert max(late.values()) == 3 and sum(late.values()) == 4


def test_keys_without_a_time_are_told_apart_by_the_span(spark, warehouse, landing, tmp_path):
    options = {"distinct_on": ("storeid",), "distinct_within": "1 hour"}
    landing(("2024-01-01 10:00:00", 1), ("2024-01-01 10:50:00", 2), ("2024-01-01 11:40:00", 3), ("2024-01-01 12:40:00", 4))
    run(warehouse, landing, tmp_path, **options)
    assert counts(warehouse) == [1, 4]  # each of the others is within an hour of the one before
    landing(("2024-01-01 13:39:00", 5), ("2023-12-31 10:00:00", 6), ("2024-01-01 09:00:00", 7))
    run(warehouse, landing, tmp_path, **options)
    assert counts(warehouse) == [1, 4, 6, 7]


def test_figures_of_batches(spark, warehouse, landing, tmp_path):
    with batch_figures(warehouse, TRAFFIC) as figures:
        for records in ([("2024-01-01 10:00:00", 1)], [("2024-01-01 11:00:00", 2), ("2024-01-01 12:00:00", 3)]):
            landing(*records)
            stream = landing_stream(warehouse, landing.folder, RAW)
            query = stream_load(warehouse, TRAFFIC, stream, str(tmp_path / "checkpoint"))
            query.awaitTermination()
            figures.wait(query)
    found = warehouse.stream_figures("fact_traffic").orderBy("batch").collect()
    assert [(r.batch, r.arrived, r.rows, r.rejected, r.published) for r in found] == [(0, 1, 1, 0, True), (1, 2, 2, 0, True)]
    assert all(r.seconds > 0 for r in found) and len({r.stream for r in found}) == 1
    assert warehouse.stream_figures("fact_errors").count() == 0
