"""Near-duplicates by SimHash: fingerprints of word shingles, compared exactly, tile by tile.

A fingerprint is compared with every other one whose population counts allow the
distance: a tile holds the fingerprints with the same counts of bits in each of four
16-bit parts, and a pair of tiles is skipped when these counts differ by more than
the radius in sum, as then the distance is larger too. What is left is compared by
exclusive-or and bit counts in numpy.

* null and empty texts, and texts without a word, have fingerprint zero and link like others
* repeated rows each get a row; their component is the same
* a null ``doc_id`` takes part with its text but is never the smallest id
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import checkpointed, components, free_name, map_texts

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42
#: Parts whose bits are counted apart, and their width.
PARTS, PART_BITS = 4, 16
#: Fingerprints in a block of a tile, about.
BLOCK = 4096


def fingerprint_texts(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprints of whole texts, as unsigned numbers."""
    out = np.zeros(len(texts), "u8")
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    starts, rows = [], []

    def finish() -> None:
        if not rows:
            return
        bits = np.unpackbits(np.array(hashes, "u8").astype(">u8").view("u1").reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype="i4")
        totals = np.diff([*starts, len(hashes)])
        packed = np.packbits(2 * ones > totals[:, None], axis=1)
        out[rows] = packed.view(">u8").ravel()
        hashes.clear(), starts.clear(), rows.clear()

    for row, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII letters and white space only
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            continue
        starts.append(len(hashes))
        rows.append(row)
        if len(tokens) <= words:
            shingles = [b" ".join(tokens)]
        else:
            shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        hashes.extend([digest(s, HASH_SEED) for s in shingles])
        if len(hashes) > 200_000:
            finish()
    finish()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long, of every row."""
    return map_texts(
        docs.select(*keep, F.col("text").alias("_text")), "_text", "fp bigint",
        lambda texts: {"fp": fingerprint_texts(texts, words).view("i8")},
    )


def roots(known: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``fp`` and ``root``, the same for all distinct fingerprints that links connect."""
    distinct = known.select("fp").distinct()
    members = components(linked(distinct, distance))
    return distinct.join(members, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row."""
    known = checkpointed(fingerprints(docs, words))
    first = known.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(roots(known, distance), "fp")
    smallest = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpointed(first.join(smallest, "root").select("fp", "component_id"))
    return known.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id.

    Of repeated rows one stays; a row without an id stays only if its whole group has none.
    """
    key = free_name(docs, "__key")
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias(key))
    known = checkpointed(fingerprints(keyed, words, ("doc_id", key)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(key).alias("key"))
    first = known.groupBy("fp").agg(F.min(order).alias("first")).join(roots(known, distance), "fp")
    chosen = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)


def linked(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between distinct ``fp`` that connect whatever is within ``distance``.

    Of the links found in a pair of blocks only a spanning forest is returned, so a
    dense group gives as many rows as it has members in each pair of blocks.
    """
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND((1 << PART_BITS) - 1)).cast("int")
        for i in range(PARTS)
    ]
    base = PART_BITS + 1
    key = sum((c * base**i for i, c in enumerate(counts)), F.lit(0)).alias("tile")
    keyed = distinct.select("fp", key)
    # at most 17 ** 4 tiles, whatever the number of fingerprints
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocks = checkpointed(
        keyed.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    # a step and its opposite describe the same pairs of tiles
    steps = [s for s in product(range(-distance, distance + 1), repeat=PARTS) if sum(map(abs, s)) <= distance and s >= (0,) * PARTS]
    part = [F.floor(F.col("tile") / base**i) % base for i in range(PARTS)]
    target = F.explode(F.filter(
        F.array(*(
            F.when(
                _all(((part[i] + s[i]).between(0, PART_BITS) for i in range(PARTS) if s[i])),
                F.col("tile") + sum(s[i] * base**i for i in range(PARTS)),
            )
            for s in steps
        )),
        lambda x: x.isNotNull(),
    ))
    left = blocks.select(F.col("tile").alias("own"), F.col("block").alias("own_block"), F.col("fps").alias("left"), target.alias("tile"))
    left = left.join(F.broadcast(sizes.select("tile")), "tile", "left_semi")
    pairs = left.join(blocks, "tile").where("own <> tile or own_block <= block")
    return pairs.select("left", F.col("fps").alias("right"), F.expr("own = tile and own_block = block").alias("same")).mapInArrow(
        lambda batches: _compare(batches, distance), "a bigint, b bigint"
    )


def _all(conditions):
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, same = batch.columns
        found_a, found_b = [], []
        lv, lo = left.values.to_numpy(), left.offsets.to_numpy()
        rv, ro = right.values.to_numpy(), right.offsets.to_numpy()
        for k, own in enumerate(same.to_pylist()):
            a, b = lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]
            i, j = tile_links(a, b, distance)
            if own:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                nodes = np.concatenate([a, b])
                ends, roots = _forest(i, j if own else j + len(a), len(nodes))
                found_a.append(nodes[ends])
                found_b.append(nodes[roots])
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_a, found_b)], names=["a", "b"])


def tile_links(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two blocks that differ in ``distance`` bits at most."""
    rows, columns = [], []
    step = max(1, 1_000_000 // max(1, len(b)))
    for start in range(0, len(a), step):
        near = np.bitwise_count((a[start:start + step, None] ^ b[None, :]).view("u8")) <= distance
        i, j = np.nonzero(near)
        rows.append(i + start)
        columns.append(j)
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(columns or [np.zeros(0, int)])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As many links as needed to connect what the links ``(i, j)`` connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            ends = np.flatnonzero(label != np.arange(n))
            return ends, label[ends]
