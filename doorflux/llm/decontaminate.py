"""Benchmark decontamination by latent semantic retrieval.

1. Every document is reduced to the words that occur in the benchmark: term numbers
   and the distances between them, a few bytes a word. Only these are kept.
2. Terms are weighted by inverse document frequency over all documents. A passage is a
   run of words twice as long as the items of a class of lengths (powers of two); passages
   overlap by half, so each place of a document is in two of each class.
3. A randomised SVD of the TF-IDF vectors of the passages of all documents: two passes add up
   ``A'A X`` for a thin ``X`` on the executors; the driver sees only matrices of terms by dimensions.
4. Cosine search: all passages of all documents against all items in the latent space. A pair is
   a candidate from a cosine of ``COSINE``; one that shares 0.8 of the item's words is a candidate
   without. Tests hold the paraphrases found against a full search: 0.9 at least.
5. Candidates must share 0.6 of the item's words, each as often as both have it, as a common
   subsequence of that length cannot do with fewer. Their windows with
   as many are checked by the longest common subsequence of words: verbatim from 0.8 of the item's words;
   a paraphrase from 0.6, if the item's last words (its answer) are there in order as well.

The benchmark is a query set held whole: a worker has a row of ``DIMENSIONS`` numbers for each of its
distinct words (26 MB for 100,000 words); search a larger one in parts.

* null and empty texts, and items without a word or without an id, match nothing
* items of fewer than eight words match only whole, word after word; scripts without
  spaces have a word for each character
* repeated rows are searched each; a pair of document and item is returned once
* repeated items are items of their own; ties are all returned
* an empty benchmark or table gives an empty result; other columns are ignored
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import checkpointed, slices

VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: The answer of an item is its last words, at least, or a quarter of it.
ANSWER_WORDS = 4
DIMENSIONS, OVERSAMPLE = 64, 16
#: A match is at most twice as many times as long as its own item.
STRETCH = 1.5
#: Shorter items must be there whole, their words next to each other.
SHORT = 8
#: The least cosine of a passage and an item that proposes the pair.
COSINE = 0.2
#: Half a passage of the least class of lengths, a power of two; the others are sums of such halves.
LEAST_HALF = 16
#: Halves whose words are added to their terms at a time.
HALF_BLOCK = 4096
#: A term that occurs more often in so many halves is added up by a table of counts.
OFTEN = 128
#: Items compared with passages at a time.
ITEM_BLOCK = 2048
#: Pairs of a block's word and an item that holds it, counted at a time.
MOST_PAIRS = 2_000_000
#: Numbers of blocks or passages by items that a worker holds at a time.
MOST_CELLS = 4_000_000
#: Distances of words are kept up to this; it is longer than any passage can be.
FAR = 65535

_SIGNS = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
#: Thai to Tibetan, Burmese, Khmer, kana and Chinese characters; their signs.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WIDE_SIGNS = re.compile("[\u3000-\u3003\u3008-\u301f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str) -> list[bytes]:
    """Words in lower case, signs and white space left out; characters of scripts without spaces are words."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _WIDE_SIGNS.sub(" ", text))
    return text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


@dataclass(frozen=True)
class Benchmark:
    """The query set: item ids, their words as term numbers, and the vocabulary."""

    ids: list[int]
    items: list[np.ndarray]
    terms: dict[bytes, int]


def load_benchmark(items: DataFrame) -> Benchmark:
    """Brings the benchmark to the driver: a curated query set, compared with all rows in blocks."""
    ids, found, terms = [], [], {}
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        words = words_of(row["text"])
        if words:
            ids.append(row["item_id"])
            found.append(np.array([terms.setdefault(w, len(terms)) for w in words], "i4"))
    return Benchmark(ids, found, terms)


def encode(docs: DataFrame, key: str, benchmark: Benchmark) -> DataFrame:
    """``key``, ``ids`` and ``gaps``: a document's benchmark words, as packed numbers."""
    terms = benchmark.terms
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.get
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                piece = batch.slice(start, stop - start)
                ids, gaps = [], []
                for text in piece.column(1).to_pylist():
                    found = np.array([get(w, -1) for w in words_of(text or "")], "i4")
                    at = np.flatnonzero(found >= 0)
                    ids.append(found[at].astype("<i4").tobytes() if len(terms) > 32767 else found[at].astype("<i2").tobytes())
                    gaps.append(np.minimum(np.diff(at, prepend=0), FAR).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array(gaps, pa.binary())], names=[key, "ids", "gaps"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids binary, gaps binary")


def _decoded(batch: pa.RecordBatch, start: int, stop: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, places and starts of a slice of encoded documents; documents lie far apart."""
    ids = [np.frombuffer(x, "<i4" if wide else "<i2") for x in batch.column("ids").slice(start, stop - start).to_pylist()]
    gaps = [np.frombuffer(x, "<u2") for x in batch.column("gaps").slice(start, stop - start).to_pylist()]
    starts = np.cumsum([0, *map(len, ids)])
    step = np.concatenate(gaps or [np.zeros(0, "u2")]).astype("i8")
    heads = starts[:-1][starts[:-1] < starts[1:]]
    step[heads] += FAR
    return np.concatenate(ids or [np.zeros(0, "i2")]).astype("i4"), np.cumsum(step), starts


@dataclass(frozen=True)
class Space:
    """Weights of terms, and classes of item lengths."""

    weight: np.ndarray
    #: (words of half a passage, longest match in words, positions of items)
    classes: list[tuple[int, int, np.ndarray]]
    wide: bool


def term_space(encoded: DataFrame, benchmark: Benchmark) -> Space:
    """Document frequencies over all documents; as many numbers as the benchmark has terms."""
    n_terms = len(benchmark.terms)
    wide = n_terms > 32767

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(n_terms, "i8"), 0
        for batch in batches:
            docs += batch.num_rows
            for x in batch.column("ids").to_pylist():
                total[np.unique(np.frombuffer(x, "<i4" if wide else "<i2"))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1])), pa.array(np.append(total[at], [docs]))], names=["term", "n"])

    counted = encoded.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(n_terms + 1)
    frequency[counted["term"].to_numpy()] = counted["n"].to_numpy()
    docs, frequency = max(1.0, frequency[-1]), frequency[:-1]
    weight = np.log((docs + 1) / (frequency + 1)) + 0.1
    lengths = np.array([len(x) for x in benchmark.items])
    kinds = np.maximum(np.log2(LEAST_HALF), np.ceil(np.log2(np.maximum(lengths, 1)))).astype(int)
    classes = []
    for kind in np.unique(kinds):
        members = np.flatnonzero(kinds == kind)
        classes.append((1 << int(kind), 2 * int(np.ceil(STRETCH * lengths[members].max())), members))
    return Space(weight.astype("f4"), classes, wide)


def _halves(places: np.ndarray, starts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of passages that hold words: their first words, documents and numbers within the document."""
    if not len(places):
        return (np.zeros(0, "i8"),) * 3
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    number = (places - places[starts[owner]]) // half
    first = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(owner) != 0)])
    return first, owner[first], number[first]


def _passages(sums: np.ndarray, owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Sums over passages from those over halves: each half with the one after it, if that holds words."""
    out = sums.copy()
    if len(sums) > 1:
        next_ = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1] + 1)
        out[:-1][next_] += sums[1:][next_]
    return out


@dataclass(frozen=True)
class Postings:
    """The items that hold each term, and how often; a term's are ``heads[term]`` to ``heads[term + 1]``."""

    n_items: int
    heads: np.ndarray
    items: np.ndarray
    times: np.ndarray


def postings(items: list[np.ndarray], n_terms: int) -> Postings:
    counted = [np.unique(x, return_counts=True) for x in items]
    terms = np.concatenate([t for t, _ in counted])
    order = np.argsort(terms, kind="stable")
    owner = np.repeat(np.arange(len(items)), [len(t) for t, _ in counted])
    heads = np.searchsorted(terms[order], np.arange(n_terms + 1))
    return Postings(len(items), heads, owner[order], np.concatenate([n for _, n in counted])[order])


def _blocks(places: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, middle and last word of blocks of twice ``span`` words, half over half.

    A window of ``span`` words is within the block in whose first half it begins.
    """
    if not len(places):
        return (np.zeros(0, "i8"),) * 3
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    number = (places - places[starts[owner]]) // span
    first = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(owner) != 0)])
    doc = owner[first]
    begin, end = places[starts[doc]] + number[first] * span, starts[doc + 1]
    return first, np.minimum(np.searchsorted(places, begin + span), end), np.minimum(np.searchsorted(places, begin + 2 * span), end)


def _sharing(
    terms: np.ndarray, first: np.ndarray, last: np.ndarray, posted: Postings, least: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks and items that share ``least`` words of the item or more, and how many; repeated words as often as both have them."""
    n_terms = len(posted.heads) - 1
    length = last - first
    block = np.repeat(np.arange(len(first)), length)
    words = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - first, length)
    pairs, times = np.unique(block * n_terms + terms[words], return_counts=True)
    block, term = np.divmod(pairs, n_terms)
    n = posted.heads[term + 1] - posted.heads[term]
    bounds = np.searchsorted(block, np.arange(len(first) + 1))
    total = np.r_[0, np.cumsum(n)][bounds]
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + MOST_PAIRS, "right")) - 1)
        stop = min(stop, at + max(1, MOST_CELLS // posted.n_items), len(first))
        some = slice(bounds[at], bounds[stop])
        here = np.repeat(np.arange(some.start, some.stop), n[some])
        place = np.arange(len(here)) + np.repeat(posted.heads[term[some]] - np.cumsum(n[some]) + n[some], n[some])
        both = np.minimum(times[here], posted.times[place])
        held = np.bincount((block[here] - at) * posted.n_items + posted.items[place], both, (stop - at) * posted.n_items)
        held = held.reshape(stop - at, posted.n_items)
        b, i = np.nonzero(held >= least)
        yield b + at, i, held[b, i]
        at = stop


def _word_sums(vectors: np.ndarray, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the words of each half: the first words of all halves, then the second ones, and so on."""
    length = np.diff(np.r_[first, len(terms)])
    order = np.argsort(-length, kind="stable")
    heads, out = first[order], np.empty((len(first), vectors.shape[1]), vectors.dtype)
    sums = vectors[terms[heads]]
    for k in range(1, length.max(initial=0)):
        some = heads[:np.searchsorted(-length[order], -k)]
        sums[:len(some)] += vectors[terms[some + k]]
    out[order] = sums
    return out


def _spread(total: np.ndarray, terms: np.ndarray, first: np.ndarray, values: np.ndarray) -> None:
    """Adds the values of each half to the rows of its words in ``total``, a word as often as it occurs."""
    ends = np.r_[first, len(terms)]
    for at in range(0, len(first), HALF_BLOCK):
        bounds, value = ends[at:at + HALF_BLOCK + 1], values[at:at + HALF_BLOCK]
        half = np.repeat(np.arange(len(value)), np.diff(bounds))
        some = terms[bounds[0]:bounds[-1]]
        order = np.argsort(some.astype(np.min_scalar_type(len(total))), kind="stable")
        found, of = some[order], half[order]
        heads = np.flatnonzero(np.r_[True, np.diff(found) > 0])
        times = np.diff(np.r_[heads, len(found)])
        often = found[heads[times > OFTEN]]
        if len(often):
            rank = np.full(len(total), -1)
            rank[often] = np.arange(len(often))
            column = rank[some]
            cells = (half * len(often) + column)[column >= 0]
            counts = np.bincount(cells, minlength=len(value) * len(often)).reshape(len(value), -1).astype("f4")
            total[often] += counts.T @ value
        heads, times = heads[times <= OFTEN], times[times <= OFTEN]
        by_times = np.argsort(-times, kind="stable")
        heads, times = heads[by_times], times[by_times]
        sums = value[of[heads]]
        for k in range(1, times.max(initial=0)):
            again = heads[:np.searchsorted(-times, -k)]
            sums[:len(again)] += value[of[again + k]]
        total[found[heads]] += sums


def _half_sums(
    vectors: np.ndarray, terms: np.ndarray, places: np.ndarray, starts: np.ndarray, halves: list[int]
) -> dict[int, tuple[np.ndarray, ...]]:
    """First words, documents, numbers and sums of the vectors of the words of the halves of passages of each size.

    Sizes are powers of two: those of the larger ones are sums of two of the size before.
    """
    first, owner, number = _halves(places, starts, LEAST_HALF)
    out, size = {}, LEAST_HALF
    sums = _word_sums(vectors, terms, first)
    while True:
        if size in halves:
            out[size] = first, owner, number, sums
        if size >= max(halves):
            return out
        size, number = 2 * size, number >> 1
        heads = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(owner) != 0)]) if len(first) else first
        if len(heads):
            sums = np.add.reduceat(sums, heads, axis=0)
        first, owner, number = first[heads], owner[heads], number[heads]


def _proposed(half: tuple[np.ndarray, ...], latent: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Blocks by items: whether a passage that begins in the block has a cosine of ``COSINE`` or more with the item.

    ``blocks`` are the blocks' first words; a block reaches over the one after it.
    """
    first, owner, number, sums = half
    near = np.zeros((len(blocks), len(latent)), bool)
    passages = _passages(sums, owner, number)
    passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)
    block = np.searchsorted(blocks, first, "right") - 1
    step = max(1, MOST_CELLS // max(1, len(latent)))
    for at in range(0, len(first), step):
        high = passages[at:at + step] @ latent.T >= COSINE
        own = block[at:at + step]
        heads = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        near[own[heads]] |= np.logical_or.reduceat(high, heads, axis=0)
    near[:-1] |= near[1:].copy()
    return near


def _gram(encoded: DataFrame, space: Space, x: np.ndarray) -> np.ndarray:
    """``A'A x`` over the TF-IDF vectors of the passages of each length class, each of length 1 or so.

    Tasks add up their rows by term; sums are combined in two rounds.
    """
    n_terms, width = x.shape
    # the last column adds up to the squared length of a passage
    weighted = np.column_stack([space.weight[:, None] * x, space.weight ** 2]).astype("f4")
    sizes = [half for half, _, _ in space.classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((n_terms, width))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                terms, places, starts = _decoded(batch, start, min(start + 200, batch.num_rows), space.wide)
                if not len(terms):
                    continue
                halves = _half_sums(weighted, terms, places, starts, [LEAST_HALF, *sizes])
                least = halves[LEAST_HALF][0]
                values = np.zeros((len(least), width), "f4")
                for half in sizes:
                    first, owner, number, sums = halves[half]
                    y = _passages(sums, owner, number)
                    y = y[:, :-1] / y[:, -1:]
                    # a word is in the passage of its half and in that of the half before
                    back = y.copy()
                    if len(y) > 1:
                        before = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1] + 1)
                        back[1:][before] += y[:-1][before]
                    values += back[np.searchsorted(first, least, "right") - 1]
                _spread(total, terms, least, values)
        at = np.flatnonzero(total.any(axis=1))
        task = TaskContext.get().partitionId()
        rows = [r.astype("<f8").tobytes() for r in total[at]]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(np.full(len(at), task % 64, "i4")), pa.array(rows, pa.binary())], names=["term", "part", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for term, part, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.frombuffer(row, "<f8")
                found[term, part] = found[term, part] + value if (term, part) in found else value
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([found[k].tobytes() for k in keys], pa.binary())], names=["term", "part", "row"])

    schema = "term int, part int, row binary"
    # a task keeps a sum for each term it sees: the terms are the benchmark's, not the corpus'
    partial = encoded.select("ids", "gaps").mapInArrow(run, schema).repartition("term", "part").mapInArrow(add, schema)
    summed = partial.repartition("term").mapInArrow(add, schema).toArrow()
    out = np.zeros((n_terms, width))
    for term, row in zip(summed["term"].to_pylist(), summed["row"].to_pylist(), strict=True):
        out[term] = space.weight[term] * np.frombuffer(row, "<f8")
    return out


def latent_terms(encoded: DataFrame, space: Space, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors of the passages of all documents, one row for each term."""
    n_terms = len(space.weight)
    width = min(n_terms, dimensions + OVERSAMPLE)
    start = np.random.default_rng(4).standard_normal((n_terms, width))
    basis = np.linalg.qr(_gram(encoded, space, start))[0]
    small = basis.T @ _gram(encoded, space, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:dimensions]]


def lcs_length(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    masks: dict[int, int] = {}
    for k, term in enumerate(item.tolist()):
        masks[term] = masks.get(term, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for term in passage.tolist():
        if hit := masks.get(term):
            both = row & hit
            row = (row + both | row - both) & full
    return len(item) - row.bit_count()


def least_shared(words: int) -> int:
    """The fewest words of an item of so many that a match has in common with it."""
    if words < SHORT:
        return words
    return next(n for n in range(int(PARAPHRASE * words), words + 1) if n / words >= PARAPHRASE)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs ``(key, item_id)`` with ``cosine``, ``lcs_share``, ``answer`` and ``kind``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id bigint, cosine double, lcs_share double, answer boolean, kind string"
    benchmark = load_benchmark(items)
    if not benchmark.items:
        return docs.sparkSession.createDataFrame([], schema)
    encoded = checkpointed(encode(docs, key, benchmark))
    space = term_space(encoded, benchmark)
    vectors = (space.weight[:, None] * latent_terms(encoded, space)).astype("f4")
    latent = np.array([vectors[x].sum(axis=0) for x in benchmark.items])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    answers = [x[-max(ANSWER_WORDS, len(x) // 4):] for x in benchmark.items]
    held, wide, n_terms = benchmark.items, space.wide, len(benchmark.terms)
    least = np.array([least_shared(len(x)) for x in held])
    spans = [len(x) if len(x) < SHORT else 2 * int(np.ceil(STRETCH * len(x))) for x in held]
    parts = []
    for half, span, members in space.classes:
        for block in range(0, len(members), ITEM_BLOCK):
            some = members[block:block + ITEM_BLOCK]
            parts.append((half, span, some, postings([held[k] for k in some], n_terms)))
    lengths = np.array([len(x) for x in held])
    shared_data = docs.sparkSession.sparkContext.broadcast((vectors, latent.astype("f4"), parts))

    def check(item: int, passage: np.ndarray) -> tuple[float, bool] | None:
        share = lcs_length(held[item], passage) / len(held[item])
        if share < PARAPHRASE or share < 1 and len(held[item]) < SHORT:
            return None
        answer = lcs_length(answers[item], passage) >= ANSWER * len(answers[item])
        return (share, answer) if share >= VERBATIM or answer else None

    def matches(item: int, terms: np.ndarray, places: np.ndarray, middle: int) -> tuple | None:
        """The best match that begins in a block's first half: share, answer, first and last word."""
        mine = np.flatnonzero(np.isin(terms, held[item]))
        where = places[mine]
        last = np.searchsorted(where, where + spans[item])
        begins = np.flatnonzero((last - np.arange(len(mine)) >= least[item]) & (mine < middle))
        if not len(begins) or lcs_length(held[item], terms[mine[begins[0]:last[begins[-1]]]]) < least[item]:
            return None
        best = None
        for k in begins.tolist():
            if best and (best[:2] == (1.0, True) or last[k] - k < best[0] * len(held[item])):
                continue
            found = check(item, terms[mine[k:last[k]]])
            if found and (not best or found > best[:2]):
                best = *found, mine[k], mine[last[k] - 1] + 1
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, latent, parts = shared_data.value
        for batch in batches:
            rows: list[tuple] = []
            for start in range(0, batch.num_rows, 200):
                stop = min(start + 200, batch.num_rows)
                terms, places, starts = _decoded(batch, start, stop, wide)
                best: dict[tuple[int, int], tuple] = {}
                halves = _half_sums(vectors, terms, places, starts, [half for half, *_ in parts])
                for half, span, some, posted in parts:
                    first, middle, last = _blocks(places, starts, span)
                    docs_of = np.searchsorted(starts, first, "right") - 1
                    near = _proposed(halves[half], latent[some], first)
                    for b, i, n in _sharing(terms, first, last, posted, least[some]):
                        candidate = near[b, i] | (n >= VERBATIM * lengths[some[i]])
                        for w, k in zip(b[candidate].tolist(), i[candidate].tolist(), strict=True):
                            doc, item, low, high = int(docs_of[w]), int(some[k]), first[w], last[w]
                            known = best.get((doc, item))
                            if known and known[1:] == (1.0, True):
                                continue
                            found = matches(item, terms[low:high], places[low:high], middle[w] - low)
                            if found and (not known or found[:2] > known[1:]):
                                passage = vectors[terms[low + found[2]:low + found[3]]].sum(axis=0)
                                cosine = float(passage @ latent[item] / max(np.linalg.norm(passage), 1e-12))
                                best[doc, item] = (cosine, *found[:2])
                rows += [(start + doc, benchmark.ids[item], *v) for (doc, item), v in sorted(best.items())]
            if rows:
                docs_at, ids, cosines, shares, found_answers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(docs_at)), pa.array(ids, pa.int64()), pa.array(cosines, pa.float64()),
                    pa.array(shares, pa.float64()), pa.array(found_answers, pa.bool_()),
                    pa.array(["verbatim" if s >= VERBATIM else "paraphrase" for s in shares]),
                ], names=[key, "item_id", "cosine", "lcs_share", "answer", "kind"])

    best = F.max(F.struct("lcs_share", "answer", "cosine", "kind")).alias("best")
    return encoded.mapInArrow(run, schema).groupBy(key, "item_id").agg(best).select(
        key, "item_id", "best.cosine", "best.lcs_share", "best.answer", "best.kind"
    )
