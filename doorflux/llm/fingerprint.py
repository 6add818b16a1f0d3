"""Document fingerprints: improbable byte windows kept in a chain of Bloom filters.

Every window of 32 bytes has an entropy. The rarity of an entropy is its share of all
windows of all documents: one pass counts the entropies, and the rarest come first
(windows that are nearly one repeated byte are ranked last, as they say little). In
each run of 32 windows the one that ranks first gains a point; windows with enough
points are the document's features. Features are hashed into Bloom filters of 2,048
bits; a full filter is followed by a new one. Likeness is the overlap of filters,
above the overlap expected by chance, as a share of the largest possible overlap.

* null and empty texts have an empty fingerprint; two empty ones have likeness 1,
  an empty and another one 0
* a text shorter than a window is one window, filled up with zero bytes
* equal texts have equal fingerprints within one run
* rows with equal ``doc_id`` are ordered by text; null ids come after all others;
  a table of one row is followed by itself
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorflux.llm.common import slices

WINDOW = 32
NEIGHBOURS = 32
#: Points that make a window a feature, or the most points in the document if less.
POINTS = 8
#: A Bloom filter: bits, bits set for each feature, features at most.
FILTER_BITS, FILTER_HASHES, FILTER_FEATURES = 2048, 5, 160
#: Entropies are counted in steps of 1/64 bit, from 0 to 5 bits.
LEVELS = 5 * 64 + 1
#: Windows of less than a bit of entropy are ranked last.
LOW_ENTROPY = 64
#: Share of the range between chance and full overlap that still counts as chance.
MARGIN = 0.1

_C_LOG_C = np.round(np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)]) * 2**20).astype("i8")
_STEP = np.diff(_C_LOG_C)  # what the c-th equal byte adds
_CHUNK = 1 << 16


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level of the entropy of each window of a byte array, by sliding sums.

    A window changes by the byte that leaves and the one that enters; what that does
    to the sum of ``c log c`` depends on how often the byte occurs within 31 bytes.
    """
    n = len(data)
    after, before = np.zeros(n, "u1"), np.zeros(n, "u1")
    for start in range(0, n, _CHUNK):  # pieces that stay in the processor's cache
        piece = data[start:start + _CHUNK]
        for k in range(1, WINDOW):
            other = data[start + k:start + k + len(piece)]
            equal = (piece[:len(other)] == other).view("u1")
            after[start:start + len(other)] += equal
            before[start + k:start + k + len(other)] += equal
    gained = np.cumsum(_STEP[before])
    lost = np.cumsum(_STEP[after[:n - WINDOW]])
    total = gained[WINDOW - 1:].copy()
    total[1:] -= lost
    entropy = np.log2(WINDOW) - total / (WINDOW * 2.0**20)
    return np.clip(np.rint(entropy * 64), 0, LEVELS - 1).astype("i2")


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text filled up to a window; starts; numbers of windows."""
    padded = [x if len(x) >= WINDOW else x.ljust(WINDOW, b"\0") for x in texts]
    lengths = np.array([len(x) for x in padded])
    return np.frombuffer(b"".join(padded), "u1"), np.cumsum(lengths) - lengths, lengths - WINDOW + 1


def _valid(size: int, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows lie in one text."""
    edge = np.zeros(size + 1, "i4")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows, -1)
    return np.cumsum(edge[:size]) > 0


def count_levels(texts: list[bytes]) -> np.ndarray:
    texts = [x for x in texts if x]
    if not texts:
        return np.zeros(LEVELS, "i8")
    data, starts, windows = _joined(texts)
    levels = entropy_levels(data)
    return np.bincount(levels[_valid(len(levels), starts, windows)], minlength=LEVELS)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, the rarest first; ties go to the lower level."""
    order = np.lexsort((np.arange(LEVELS), counts, np.arange(LEVELS) < LOW_ENTROPY))
    out = np.empty(LEVELS, "i4")
    out[order] = np.arange(LEVELS)
    return out


def digests(texts: list[bytes], rank: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each text its chain of filters, as (features, 256 bytes)."""
    out: list[list] = [[] for _ in texts]
    rows = [k for k, x in enumerate(texts) if x]
    if not rows:
        return out
    data, starts, windows = _joined([texts[k] for k in rows])
    valid = _valid(len(data) - WINDOW + 1, starts, windows)
    places = np.arange(len(valid), dtype="i8")
    # rank, then place: the least of a run is the leftmost of those that rank first
    lowest = np.where(valid, rank[entropy_levels(data)].astype("i8") << 40 | places, np.iinfo("i8").max)
    lowest = np.concatenate([lowest, np.full(NEIGHBOURS - 1, np.iinfo("i8").max)])
    width = 1
    while width < NEIGHBOURS:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    chosen = lowest[:len(valid)][valid] & (1 << 40) - 1
    points = np.bincount(chosen, minlength=len(data)).astype("i4")
    owner_most = np.maximum.reduceat(points, starts)
    features = np.flatnonzero(points)
    owner = np.searchsorted(starts, features, "right") - 1
    keep = points[features] >= np.minimum(POINTS, owner_most[owner])
    features, owner = features[keep], owner[keep]
    spots = _hashed(data, features)
    first = np.searchsorted(owner, np.arange(len(rows)))
    number = np.arange(len(owner)) - first[owner]
    link = number // FILTER_FEATURES
    # one row of bits for each filter of each text
    fresh = np.flatnonzero((number % FILTER_FEATURES) == 0)
    filter_row = np.cumsum((number % FILTER_FEATURES) == 0) - 1
    bits = np.zeros((len(fresh), FILTER_BITS), bool)
    for spot in spots.T:
        bits[filter_row, spot] = True
    packed = np.packbits(bits, axis=1)
    sizes = np.bincount(filter_row, minlength=len(fresh))
    for r, f in enumerate(fresh):
        assert link[f] == len(out[rows[owner[f]]])
        out[rows[owner[f]]].append((int(sizes[r]), packed[r]))
    return out


def _hashed(data: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Five places in a filter for each feature, from two mixed 64-bit sums of its bytes."""
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    out = np.empty((len(features), FILTER_HASHES), "i8")
    odd = np.random.default_rng(64).integers(1, 2**63, (2, WINDOW // 8), "u8") * 2 + 1
    for start in range(0, len(features), 50_000):
        words = np.ascontiguousarray(windows[features[start:start + 50_000]]).view("u8")
        sums = []
        for factors in odd:
            x = words * factors
            x ^= x >> np.uint64(29)
            x = (x * np.uint64(0xBF58476D1CE4E5B9)).sum(axis=1, dtype="u8")
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            sums.append(x ^ x >> np.uint64(31))
        for k in range(FILTER_HASHES):
            out[start:start + len(words), k] = (sums[0] + np.uint64(k) * (sums[1] | np.uint64(1))) >> np.uint64(53)
    return out


def written(digest: list[tuple[int, np.ndarray]]) -> str:
    """Features and bits of each filter in base 64, filters joined by a point."""
    return ".".join(f"{n}:{base64.b64encode(bits.tobytes()).decode()}" for n, bits in digest)


def read(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    parts = [x.split(":") for x in fingerprint.split(".") if x]
    return [(int(n), np.frombuffer(base64.b64decode(bits), "u1")) for n, bits in parts]


def likeness(one: list[tuple[int, np.ndarray]], two: list[tuple[int, np.ndarray]]) -> float:
    """0 to 1: for each filter of the shorter chain its best match, weighted by features."""
    if not one or not two:
        return float(not one and not two)
    if len(one) == len(two):
        return (_directed(one, two) + _directed(two, one)) / 2
    return _directed(*sorted((one, two), key=len))


def _directed(short: list, long: list) -> float:
    sizes = [np.array([n for n, _ in x], float) for x in (short, long)]
    bits = [np.array([b for _, b in x]).view("u8") for x in (short, long)]
    counts = [np.bitwise_count(b).sum(axis=1, dtype="i8") for b in bits]
    total = 0.0
    for k, n in enumerate(sizes[0]):
        both = np.bitwise_count(bits[0][k] & bits[1]).sum(axis=1, dtype="i8")
        most = np.minimum(counts[0][k], counts[1])
        none = 1 - 1 / FILTER_BITS
        sets = FILTER_HASHES * np.array([n * np.ones(len(both)), sizes[1], n + sizes[1]])
        chance = FILTER_BITS * (1 - none**sets[0] - none**sets[1] + none**sets[2])
        floor = np.minimum(chance + MARGIN * np.maximum(most - chance, 0), most)
        share = np.where(both >= most, 1.0, np.clip((both - floor) / np.maximum(most - floor, 1), 0, 1))
        total += n * share.max()
    return float(total / sizes[0].sum())


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the document that follows."""
    tail = len(text) // 3
    return text[:len(text) - tail] + following[:tail]


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Counts the entropies of all windows of all documents; 321 numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, "i8")
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                total += count_levels([(x or "").encode("utf-8", "surrogatepass") for x in batch.column(0).slice(start, stop - start).to_pylist()])
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype("i4")), pa.array(total[level])], names=["level", "n"])

    sums = docs.select("text").mapInArrow(count, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS, "i8")
    for row in sums.collect():
        counts[row["level"]] = row["n"]
    return ranks(counts)


def neighbours(spark: SparkSession, docs: DataFrame, ranges: int) -> DataFrame:
    """Rows in ranges of ``doc_id``, each range led by the last row before it (``guest``).

    Range ends are ids that occur, so a range's last row is known without a look at
    it. The last row of all leads the first range. Only ids decide; one shuffle moves
    each text once.
    """
    ids = docs.select("doc_id")
    shares = [k / ranges for k in range(1, ranges)] + [1.0]
    row = ids.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("ends"), F.max("doc_id").alias("last")).first()
    ends = sorted({*(row["ends"] or []), *([row["last"]] if row["last"] is not None else [])})

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), "i4")
        out[known] = np.searchsorted(np.array(ends, "i8"), ids[known].to_numpy().astype("i8"))
        return pd.Series(out)

    own = docs.select("doc_id", "text", range_of("doc_id").alias("range"))
    last = F.lit(ends[-1]) if ends else F.lit(None)
    if ends:
        is_end = F.col("doc_id").isin(ends) if len(ends) <= 64 else F.array_contains(F.lit(ends), F.col("doc_id"))
        lead = F.coalesce(is_end, F.lit(False))
        to = (F.col("range") + 1) % len(ends)
    else:
        lead, to = F.col("doc_id").eqNullSafe(last), F.lit(0)
    places = F.when(lead, F.array(F.struct(F.lit(False).alias("guest"), F.col("range")), F.struct(F.lit(True).alias("guest"), to.alias("range")))).otherwise(
        F.array(F.struct(F.lit(False).alias("guest"), F.col("range")))
    )
    return own.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.guest", "p.range")


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    rank = corpus_ranks(docs)
    placed = neighbours(spark, docs, ranges or 8 * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, list] | None = None
        place = None
        for batch in batches:
            for start, stop in slices(batch.column(1), 1_000_000):
                piece = batch.slice(start, stop - start)
                ids, texts, guests, places = (c.to_pylist() for c in piece.columns)
                texts = [x or "" for x in texts]
                own = digests([x.encode("utf-8", "surrogatepass") for x in texts], rank)
                kept, follow = [], []
                for k, text in enumerate(texts):
                    if places[k] != place:
                        place, before = places[k], None
                    if not guests[k]:
                        kept.append(k)
                        follow.append(before or (text, own[k]))
                    before = (text, own[k])
                changed = [edited(texts[k], f[0]) for k, f in zip(kept, follow, strict=True)]
                raw = [x.encode("utf-8", "surrogatepass") for x in changed]
                new = digests(raw, rank)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in kept], pa.int64()),
                    pa.array([len(texts[k]) for k in kept], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([written(own[k]) for k in kept], pa.string()),
                    pa.array([written(x) for x in new], pa.string()),
                    pa.array([likeness(own[k], x) for k, x in zip(kept, new, strict=True)], pa.float64()),
                    pa.array([likeness(own[k], f[1]) for k, f in zip(kept, follow, strict=True)], pa.float64()),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return (
        placed.repartition(parts, "range")
        .sortWithinPartitions("range", F.desc("guest"), "doc_id", "text")
        .mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
