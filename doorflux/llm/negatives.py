"""Hard-negative mining: for each anchor and positive, the best rows of other labels in a window of scores.

A window reaches from a lower to an upper limit that are shares of the positive's
score, so the windows of one anchor overlap. Their upper limits cut the scores into
disjoint slots. Each task keeps the best rows of each slot only, the shuffle merges
these, and a window's answer is read off the slots from its upper limit downward: the
best of all scores at or below the limit, ended by the lower limit.

Anchors go in blocks of bounded size, each against all rows: one pass finds the
positives, one the negatives. A block is large enough that products, not reading,
take the time, and what a task sends on does not depend on its rows.

* rows with a null id, label or vector, or with a null or non-finite component, take no
  part, nor do those with a component beyond 2**23 after scaling (their scores may not
  fit a long)
* scores of vectors of different length run over the components that both have
* repeated rows are rows of their own, so copies of an anchor are its positives, and
  repeated anchors repeat their rows
* equal scores are ordered by smaller id; equal ids with equal scores give equal rows
* an anchor without another row of its label has no row; a window below zero is empty
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorflux.llm.common import checkpointed

POSITIVES, NEGATIVES = 5, 10
#: Components become floor(SCALE * x).
SCALE = 256
#: The window of negative scores, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors in a block, and the bytes that one may have.
ANCHORS, BLOCK_BYTES = 16_384, 64_000_000
#: Scores that a task holds at a time.
TILE = 2_000_000
_LARGEST = 2.0**23
_OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def prepared(df: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """``id``, ``label`` and ``vector`` of the rows that take part."""
    out = df.select(
        F.col(id).cast("long").alias("id"), label.alias("label"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("vector"),
        F.forall(
            F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < _LARGEST)
        ).alias("sound"),
    )
    return out.where(F.coalesce("sound", F.lit(False)) & F.col("id").isNotNull() & F.col("label").isNotNull()).drop("sound")


def _matrices(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, by length; longer ones are cut to ``width``, the others' end is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        short = min(int(size), width)
        yield rows, values[starts[rows][:, None] + np.arange(short)]


class _Block:
    """A block of anchors as the tasks need it."""

    def __init__(self, rows: pa.Table, labels: dict):
        vectors = rows["vector"].combine_chunks()
        self.ids = rows["id"].to_numpy()
        width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
        self.matrix = np.zeros((len(rows), width))
        for at, part in _matrices(vectors, width):
            self.matrix[at, :part.shape[1]] = part
        self.labels = np.array([labels[x] for x in rows["label"].to_pylist()], "i8")
        self.own = (self.matrix**2).sum(axis=1)

    def __len__(self) -> int:
        return len(self.ids)


def _best(rows: DataFrame, block: _Block, labels: dict, top: int, upper: np.ndarray, lower: np.ndarray, same: bool) -> DataFrame:
    """The ``top`` best rows of each anchor and slot: anchor (place in the block), slot, score, id.

    Slot ``k`` of an anchor holds the scores from ``lower[anchor, k]`` to ``upper[anchor, k]``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((block, labels, upper, lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, labels, upper, lower = shared.value
        slots = upper.shape[1]
        # best so far: anchor * slots + slot, score, id
        kept = (np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8"))
        bar, bar_id = lower.copy(), np.full(lower.shape, np.iinfo("i8").max)

        def merge(kept, new):
            place, score, ident = (np.concatenate(x) for x in zip(kept, *new, strict=True))
            order = np.lexsort((ident, -score, place))
            place, score, ident = place[order], score[order], ident[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, int)
            rank = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
            last = rank == top - 1
            bar.ravel()[place[last]] = score[last]
            bar_id.ravel()[place[last]] = ident[last]
            keep = rank < top
            return place[keep], score[keep], ident[keep]

        for batch in batches:
            ids, tags, vectors = batch.columns
            ids = ids.to_numpy()
            tags = np.array([labels.get(x, -1) for x in tags.to_pylist()], "i8")
            for at, part in _matrices(vectors, block.matrix.shape[1]):
                step = max(1, TILE // max(1, len(at)))
                for start in range(0, len(block), step):
                    some = slice(start, min(start + step, len(block)))
                    scores = block.matrix[some, :part.shape[1]] @ part.T
                    fits = (block.labels[some, None] == tags[at][None, :]) == same
                    new = []
                    for slot in range(slots):
                        near = fits & (scores >= bar[some, slot, None]) & (scores <= upper[some, slot, None])
                        i, j = np.nonzero(near)
                        score, ident = scores[i, j], ids[at[j]]
                        good = (score > bar[some][i, slot]) | (ident <= bar_id[some][i, slot])
                        new.append(((i[good] + start) * slots + slot, score[good], ident[good]))
                    if any(len(x[0]) for x in new):
                        kept = merge(kept, new)
        place, score, ident = kept
        for start in range(0, len(place), 100_000):
            part = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place[part] // slots).astype("i4")), pa.array((place[part] % slots).astype("i4")),
                 pa.array(score[part].astype("i8")), pa.array(ident[part])],
                names=["anchor", "slot", "score", "id"],
            )

    found = rows.mapInArrow(run, "anchor int, slot int, score bigint, id bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def limits(positives: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score of each window; ``low > high`` where there is none.

    A negative's score times 100 lies between ``low`` and ``high`` times the positive's.
    """
    return -(-low * positives // 100), high * positives // 100


def slots_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint slots, from the greatest upper limit downward, for the windows of each anchor.

    A slot ends above the next lower limit; none reaches below the anchor's least window.
    Windows that do not exist leave an empty slot.
    """
    open_ = low <= high
    top = np.where(open_, high.astype(float), -np.inf)
    upper = -np.sort(-top, axis=1)
    floor = np.where(open_, low.astype(float), np.inf).min(axis=1, keepdims=True)
    below = np.concatenate([upper[:, 1:], np.full((len(upper), 1), -np.inf)], axis=1)
    return upper, np.maximum(below + 1, floor)


def mine(
    df: DataFrame,
    anchors: Column,
    label: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = ANCHORS,
) -> DataFrame:
    """The negatives of all rows for which ``anchors`` holds.

    ``anchors`` is a condition on the columns ``id`` (the row's id), ``label`` and
    ``vector``. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    rows = prepared(df, id, vector, label)
    chosen = rows.where(F.coalesce(anchors, F.lit(False)))
    chosen = checkpointed(chosen.withColumn("number", F.monotonically_increasing_id()))
    size = chosen.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, size["width"] or 1))))
    blocks = ceil(size["rows"] / block_rows)
    results = []
    for k in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k)
        results.append(_of_block(rows, own.select("id", "label", "vector").toArrow(), positives, negatives, low, high))
        if blocks > 1:
            # each block's rows are few; written, they need no second look at the table
            results[-1] = checkpointed(results[-1])
    out = spark.createDataFrame([], _OUT)
    for result in results:
        out = out.union(result)
    return out


def _of_block(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    if not len(anchors):
        return spark.createDataFrame([], _OUT)
    labels = {x: k for k, x in enumerate(dict.fromkeys(anchors["label"].to_pylist()))}
    block = _Block(anchors, labels)
    shape = (len(block), 1)
    everything = np.full(shape, np.inf), np.full(shape, -np.inf)
    # the anchor itself is among the rows of its label
    found = _best(rows, block, labels, positives + 1, *everything, same=True).orderBy("anchor", "rank").collect()
    chosen: list[list[tuple[int, int]]] = [[] for _ in range(len(block))]
    for r in found:
        chosen[r["anchor"]].append((r["score"], r["id"]))
    for k, mine_ in enumerate(chosen):
        itself = (int(block.own[k]), int(block.ids[k]))
        if itself in mine_:
            mine_.remove(itself)
        del mine_[positives:]
    table = np.array([[s for s, _ in x] + [-1] * (positives - len(x)) for x in chosen], "i8").reshape(len(block), positives)
    least, most = limits(table, low, high)
    windows = spark.createDataFrame(
        [
            (k, int(block.ids[k]), n + 1, ident, score, int(least[k, n]), int(most[k, n]))
            for k, x in enumerate(chosen) for n, (score, ident) in enumerate(x)
        ],
        "anchor int, anchor_id bigint, nth int, positive_id bigint, positive_score bigint, least bigint, most bigint",
    )
    best = _best(rows, block, labels, negatives, *slots_of(least, most), same=False)
    # at most positives x negatives rows an anchor; from the upper limit downward
    falling = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("loss"), F.col("id"))))
    slots = best.groupBy("anchor").agg(falling.alias("falling"))
    inside = F.filter("falling", lambda x: (-x.loss <= F.col("most")) & (-x.loss >= F.col("least")))
    return windows.join(slots, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "x")
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"),
        "positive_score", (-F.col("x.loss")).alias("negative_score"),
    )
