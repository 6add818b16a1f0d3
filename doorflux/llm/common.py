"""What the operators share: tables, checkpoints, Arrow columns, connected components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a Python worker handles at a time, whatever the size of Arrow's batches.
SLICE_CHARS = 2_000_000


def findable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    A folder of its own is taken only where the session has none and runs in one
    process, as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="doorflux-checkpoints-")
        context.setCheckpointDir(folder)
    return str(folder).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_part(key: str, parts: int) -> Column:
    """The part of a split by crc32 of a key written as text; null keys are in part 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(0))


def row_keys(*columns: str) -> list[Column]:
    """Two hashes ``_h1``, ``_h2`` that tell rows apart by these columns."""
    return [F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *columns).alias("_h2")]


def drawn(keys: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` distinct rows of each label out of ``(label, _h1, _h2)``, by their hashes.

    Repeated rows count once, so no number of copies outgrows the limit. The result is
    written; it has ``most`` rows a label, whatever ``keys`` has.
    """
    keys = keys.select(label, "_h1", "_h2").distinct()
    counts = {r[label]: r["n"] for r in keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return keys
    # a few more than asked for, then cut exactly
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, (1.2 * most + 50) / n))))
    near = keys.where(F.pmod("_h2", F.lit(1 << 20)) / (1 << 20) < share[F.col(label)])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h2", "_h1"))
    return checkpointed(near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank"))


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    function: Callable[[list[str]], dict[str, list]],
) -> DataFrame:
    """Adds the columns ``function`` makes of the texts; null texts are read as empty.
    A kept column that bears the name of a new one makes way for it.

    ``function`` gets a slice of whole texts of bounded total length (or one longer
    text) and returns a list of values for each new column. ``df`` has the columns
    to keep and the text, which is not returned.
    """
    made = df.sparkSession.createDataFrame([], schema).schema
    kept = [field for field in df.schema.fields if field.name not in (text, *made.names)]
    names = [field.name for field in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {field.name: to_arrow_type(field.dataType) for field in made.fields}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start, stop in slices(column):
                values = [x or "" for x in column.slice(start, stop - start).to_pylist()]
                results = function(values)
                arrays = [batch.column(batch.schema.get_field_index(n)).slice(start, stop - start) for n in names]
                arrays += [pa.array(results[n], types[n]) for n in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *types])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema])
    return df.mapInArrow(run, out)


def slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    import pyarrow.compute as pc

    start, size = 0, 0
    for row, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if row > start and size + length > most:
            yield start, row
            start, size = row, 0
        size += length
    if len(column) > start:
        yield start, len(column)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)`` as ``(node, root)``; root is the smallest node.

    Alternates two star operations: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Each round is written to the shared
    checkpoint folder; links never leave the executors. Nodes without a link to
    another node are not returned.
    """
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    seen = _digest(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        lowest = lowest.select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = checkpointed(small.where("a <> b").distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
