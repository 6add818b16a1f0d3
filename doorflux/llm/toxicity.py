"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (4, 6 or 8 long, letters and spaces, in lower
case, hashed). Its value is the log ratio of its shares among toxic and other labelled
texts; a logistic regression on these values gives the weights. No n-gram of at least
``LEAST_TEXTS`` texts is left out. ``fit_all`` takes all distinct labelled rows, ``labelled_sample``
draws a bounded sample of them, at most ``FIT_ROWS`` of each label, the same whenever the rows are the same.
Scoring covers every text.

The features of the rows to fit stay on the executors, packed to between one and two bytes each: each round of the regression is
one pass over them that returns a gradient, at most ``2 ** BITS`` numbers a task. A quarter of the
rows, by a hash of the text, has no part in counts and weights; slope and intercept of the score are
fitted on it, since texts that the weights were fitted on score too far from 0.5. With
fewer than ``LEAST_APART`` of these texts of a label the weights take all rows.

* null and empty texts score as a text without any feature
* repeated rows are scored each; labels that are null are not learned from
* without labels of both kinds nothing is learned, and every score is 0
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.llm import ngrams
from doorflux.llm.common import checkpointed, drawn, map_texts, row_keys, slices

SIZES, BITS = (4, 6, 8), 20
#: One in so many of the texts to fit sets the scale of the score, if each label has enough of them.
APART, LEAST_APART = 4, 10
#: Rounds of the regression at most, and the weight of the squared weights.
ROUNDS, PENALTY = 60, 1e-4
#: Labelled rows of each label that a sample takes at most.
FIT_ROWS = 10_000
#: Tasks that count features and make gradients, at least; counts or gradients that the driver gets at a time, at most.
FIT_TASKS, GRADIENTS = 8, 8
#: A feature is kept if it occurs in so many texts.
LEAST_TEXTS = 5
THRESHOLD = 0.7
#: A slice of the texts to fit: whether set apart, labels, number of features of each text, their packed places.
BLOCK = pa.schema([("apart", pa.bool_()), ("y", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("near", pa.binary()), ("far", pa.binary())])
BLOCK_SQL = "apart boolean, y array<boolean>, lengths array<bigint>, near binary, far binary"
#: Characters of text that a task handles at a time; their features are one block.
SLICE = 500_000
#: What a task adds to a sum.
VECTOR = pa.schema([("part", pa.int32()), ("value", pa.float64()), ("vector", pa.binary())])
VECTOR_SQL = "part int, value double, vector binary"


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram, as present or not, and the intercept."""

    weights: np.ndarray
    intercept: float


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, of the wanted features only if given."""
    codes, owner = ngrams.letter_codes(texts)
    pairs = []
    for size in SIZES:
        h, row = ngrams.hashed(codes, owner, size, BITS)
        if wanted is not None:
            hit = wanted[h]
            h, row = h[hit], row[hit]
        pairs.append(row.astype("i8") << BITS | h)
    both = np.concatenate(pairs)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both >> BITS, both & (1 << BITS) - 1


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``y`` of at most ``fit_rows`` distinct rows of each label.

    Ids and hashes alone are joined with the labels; the chosen ones, as many as ``fit_rows``
    allows however large the tables are, are broadcast to the texts.
    """
    rows = docs.where(train).select("doc_id", "text", *row_keys("doc_id", "text"))
    chosen = drawn(rows.drop("text").join(known_labels(labels), "doc_id"), "y", fit_rows)
    return rows.join(F.broadcast(chosen), ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"]).select("text", "y")


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """``text`` and ``y`` of all distinct labelled rows."""
    rows = docs.where(train).select("doc_id", "text", *row_keys("doc_id", "text"))
    # by the id as well: the join deals rows by it already
    return rows.join(known_labels(labels), "doc_id").dropDuplicates(["doc_id", "_h1", "_h2"]).select("text", "y")


def fit_all(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """The model of all labelled rows; their features are held on the executors' disks."""
    tasks = max(FIT_TASKS, docs.sparkSession.sparkContext.defaultParallelism)
    return fit(labelled(docs, labels, train), StorageLevel.DISK_ONLY, tasks)


def fit(sample: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, tasks: int = FIT_TASKS) -> Model:
    """Counts features by label, then fits weights and scale, all on the executors."""
    apart = F.pmod(F.xxhash64("text"), F.lit(APART)) == 0
    sample = checkpointed(sample.select("text", "y", apart.alias("apart")).repartition(tasks))  # in turn: equal texts may be many
    of = {(r["apart"], r["y"] > 0): r["count"] for r in sample.groupBy("apart", "y").count().collect()}
    scaled = all(of.get((True, y), 0) >= LEAST_APART and of.get((False, y), 0) for y in (False, True))
    if not scaled:
        sample = sample.withColumn("apart", F.lit(False))
    texts_of = [of.get((False, y), 0) + (0 if scaled else of.get((True, y), 0)) for y in (False, True)]
    if not all(texts_of):
        return Model(np.zeros(1 << BITS, "f4"), -1e9)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), "i8")
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                y = np.array(batch.column(1).slice(start, stop - start).to_pylist()) > 0
                row, h = features([x or "" for x in batch.column(0).slice(start, stop - start).to_pylist()])
                for label in (0, 1):
                    total[label] += np.bincount(h[y[row] == bool(label)], minlength=1 << BITS)
        yield vector(0, total.ravel().astype("<u4"))

    # 2 * 2 ** BITS counts a task, whatever the texts; packed, those of a few tasks need no shuffle
    counted = sample.where("not apart").select("text", "y").mapInArrow(count, VECTOR_SQL)
    total = added(counted, 2 << BITS, "<u4", tasks)[1].reshape(2, -1)
    cells = np.flatnonzero(total.sum(axis=0) >= LEAST_TEXTS).astype("i4")
    n0, n1 = total[:, cells].astype("i8")
    ratio = np.log((n1 + 1) / (texts_of[1] + 2)) - np.log((n0 + 1) / (texts_of[0] + 2))
    scale = ratio / max(1e-9, np.abs(ratio).max(initial=0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, "i4")
        place[cells] = np.arange(len(cells), dtype="i4")
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                texts, y, aside = (batch.column(c).slice(start, stop - start).to_pylist() for c in range(3))
                for part in (False, True):
                    of_part = [k for k, x in enumerate(aside) if x == part]
                    if of_part:
                        row, h = features([texts[k] or "" for k in of_part], place >= 0)
                        lengths = np.bincount(row, minlength=len(of_part))
                        near, far = packed(place[h])
                        made = [[part], [[y[k] > 0 for k in of_part]], [lengths], [near], [far]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, BLOCK.types, strict=True)], schema=BLOCK)

    # by the executors, not in the shared folder: what is lost is made again from the written texts
    held = sample.mapInArrow(rows, BLOCK_SQL).persist(level)
    inside = held.where("not apart").drop("apart")
    weighs = 0.5 / np.array(texts_of)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = pass_over(inside, x[:-1] * scale, x[-1], weighs, tasks)
        gradient[:-1] = gradient[:-1] * scale + PENALTY * x[:-1]
        return value + PENALTY / 2 * (x[:-1] @ x[:-1]), gradient

    x = minimised(objective, np.zeros(len(cells) + 1), ROUNDS)
    weights, intercept = x[:-1] * scale, x[-1]
    if scaled:
        n = np.array([of[True, y] for y in (False, True)])
        slope, shift = platt_over(sums(held.where("apart").drop("apart"), weights, intercept), n)
        weights, intercept = weights * slope, intercept * slope + shift
    held.unpersist()
    full = np.zeros(1 << BITS, "f4")
    full[cells] = weights
    return Model(full, float(intercept))


def packed(places: np.ndarray) -> tuple[bytes, bytes]:
    """Steps from one place to the next in two bytes, compressed, and those that need more, each after its position.

    The places of a text rise, so only the step to the next text, and few others, need more.
    """
    steps = np.diff(places, prepend=0).astype("i8")
    far = np.flatnonzero((steps < 0) | (steps > 0xFFFF))
    return pa.compress(steps.astype("<u2").tobytes(), codec="zstd", asbytes=True), np.stack([far, steps[far]]).astype("<i8").tobytes()


def unpacked(near: pa.Buffer | bytes, far: pa.Buffer | bytes, size: int) -> np.ndarray:
    """The ``size`` places that ``packed`` was given."""
    steps = np.frombuffer(pa.decompress(near, 2 * size, codec="zstd"), "<u2").astype("i8")
    at, step = np.frombuffer(far, "<i8").reshape(2, -1)
    steps[at] = step
    return np.cumsum(steps, out=steps)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, places of features and the row of each, of every block."""
    for k in range(len(batch)):
        y, lengths, near, far = (batch.column(c)[k] for c in range(4))
        lengths = lengths.values.to_numpy()
        places = unpacked(near.as_buffer(), far.as_buffer(), int(lengths.sum()))
        yield y.values.to_numpy(zero_copy_only=False), places, np.repeat(np.arange(len(lengths)), lengths)


def vector(value: float, numbers: np.ndarray) -> pa.RecordBatch:
    """What a task adds to a sum: its part of ``GRADIENTS``, a number, and numbers of four bytes, compressed."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % GRADIENTS
    made = [[part], [float(value)], [pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, VECTOR.types, strict=True)], schema=VECTOR)


def added(rows: DataFrame, size: int, kind: str, tasks: int) -> tuple[float, np.ndarray]:
    """Sums of what the tasks return, ``size`` numbers; what many return is added up by part on the executors first."""

    def numbers(x: pa.BinaryScalar) -> np.ndarray:
        return np.frombuffer(pa.decompress(x.as_buffer(), 4 * size, codec="zstd"), kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, total = 0.0, np.zeros(size, "f8" if kind == "<f4" else kind)
        for batch in batches:
            value += sum(batch.column(1).to_pylist())
            for x in batch.column(2):
                total += numbers(x)
        yield vector(value, total.astype(kind))

    if tasks > GRADIENTS:
        rows = rows.repartition(GRADIENTS, "part").mapInArrow(add, VECTOR_SQL)
    parts = rows.toArrow()
    total = np.zeros(size, "f8" if kind == "<f4" else kind)
    for x in parts["vector"]:
        total += numbers(x)
    return sum(parts["value"].to_pylist()), total


def pass_over(held: DataFrame, weights: np.ndarray, intercept: float, weighs: np.ndarray, tasks: int) -> tuple[float, np.ndarray]:
    """Logistic loss of the rows and its gradient by weights and intercept; the labels weigh alike."""
    # one of these a round: removed after it, here and on the executors
    sent = held.sparkSession.sparkContext.broadcast(weights.astype("f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        loss, total = 0.0, np.zeros(len(weights) + 1)
        for batch in batches:
            for y, places, row in blocks(batch):
                z = np.bincount(row, weights[places], len(y)) + intercept
                weigh = weighs[y.astype(int)]
                loss += weigh @ np.logaddexp(0, np.where(y, -z, z))
                g = weigh * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
                total[:-1] += np.bincount(places, g[row], len(weights))
                total[-1] += g.sum()
        yield vector(loss, total.astype("<f4"))

    loss, gradient = added(held.mapInArrow(run, VECTOR_SQL), len(weights) + 1, "<f4", tasks)
    sent.destroy()
    return loss, gradient


def sums(held: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """Labels ``y`` and weighted sums ``z`` of the rows."""
    weights = weights.astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, places, row in blocks(batch):
                z = np.bincount(row, weights[places], len(y)) + intercept
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(z)], names=["y", "z"])

    return held.mapInArrow(run, "y boolean, z double")


def misfit(y: np.ndarray, z: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Loss of the scores by slope and shift ``x``, and its gradient; ``n`` rows of each label, which weigh alike."""
    weigh = (0.5 / n)[y.astype(int)]
    target = np.where(y, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    s = x[0] * z + x[1]
    g = weigh * (1 / (1 + np.exp(-np.clip(s, -50, 50))) - target)
    return np.array([weigh @ (np.logaddexp(0, s) - target * s), g @ z, g.sum()])


def platt(y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift that make a score of ``z``; the labels weigh alike."""
    n = np.array([np.sum(~y), np.sum(y)])
    return least_misfit(lambda x: misfit(y, z, x, n))


def platt_over(scores: DataFrame, n: np.ndarray) -> tuple[float, float]:
    """``platt`` of rows that stay on the executors."""
    scores = scores.persist()

    def total(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value = np.zeros(3)
            for batch in batches:
                value += misfit(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), x, n)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in value], names=["loss", "slope", "shift"])

        parts = scores.mapInArrow(run, "loss double, slope double, shift double").toArrow()
        return np.array([sum(parts[c].to_pylist()) for c in range(3)])

    slope, shift = least_misfit(total)
    scores.unpersist()
    return slope, shift


def least_misfit(misfit_of) -> tuple[float, float]:
    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        found = misfit_of(x)
        return float(found[0]), found[1:]

    slope, shift = minimised(objective, np.array([1.0, 0.0]), 200, 1e-9)
    return max(0.0, slope), shift


def minimised(objective, x: np.ndarray, rounds: int, least_gain: float = 1e-4, memory: int = 4) -> np.ndarray:
    """The least point of a smooth convex function by limited-memory BFGS; ends when a round gains little."""
    # steps and their changes of the gradient, in half the width: the driver holds them all
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    value, gradient = objective(x)
    for _ in range(rounds):
        way, factors = -gradient, []
        for s, d in reversed(steps):
            factors.append(float(s @ way) / float(s @ d))
            way -= np.float32(factors[-1]) * d
        way *= float(steps[-1][0] @ steps[-1][1]) / float(steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(gradient))
        for (s, d), factor in zip(steps, reversed(factors), strict=True):
            way += np.float32(factor - float(d @ way) / float(s @ d)) * s
        length, slope = 1.0, float(gradient @ way)
        if slope >= 0:
            break
        new = objective(x + way)
        while new[0] > value + 1e-4 * length * slope and length > 1e-6:
            length /= 2
            new = objective(x + length * way)
        if new[0] >= value:
            break
        way *= length
        x = x + way
        gradient -= new[1]
        s, d = way.astype("f4"), (-gradient).astype("f4")
        if s @ d > 1e-12:
            steps = [*steps[1 - memory:], (s, d)]
        gain, (value, gradient) = value - new[0], new
        del way, s, d, new
        if gain < least_gain * value:
            break
    return x


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and ``score``, 0 to 1."""
    wanted = model.weights != 0
    cells = np.flatnonzero(wanted).astype("i4")
    values = model.weights[cells]
    intercept = model.intercept

    def score(texts: list[str]) -> dict[str, list]:
        weights = np.zeros(1 << BITS, "f4")
        weights[cells] = values
        known, z, start = weights != 0, np.full(len(texts), intercept), 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= SLICE:
                size += len(texts[stop])
                stop += 1
            row, h = features(texts[start:stop], known)
            z[start:stop] += np.bincount(row, weights[h], stop - start)
            start = stop
        return {"score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))}

    return map_texts(docs.select(*keep, F.col("text").alias("_text")), "_text", "score double", score)
