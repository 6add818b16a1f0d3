"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a classifier of hashed character
n-grams (1 to 3 long) tells the languages with a 1 from those with a 0: its output is
the mean log ratio of the n-gram's shares in the two sets of languages. Decoding sums the
loss of each bit, weighted by how well that bit's classifier did for each language, and
takes the nearest codeword; a text is ambiguous if two codewords are about as near.

The fit takes a bounded sample of the labelled rows, at most ``FIT_ROWS`` distinct ones of each
language, chosen by hashes of id and text. Prediction covers every text whole.

* ``und`` with score 0 where the text is null or has no letter, or nothing was learned
* one language only: every text with letters is predicted as it, with score 1
* ties go to the language that comes first in the alphabet
* repeated rows are predicted each; an empty table gives an empty result
* other columns are ignored, also such as bear the names of new ones
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.llm import ngrams
from doorflux.llm.common import checkpointed, drawn, map_texts, row_keys, slices

SIZES, BITS = (1, 2, 3), 16
#: Labelled rows of each language that a fit takes at most.
FIT_ROWS = 4000
#: Score differences below this are ambiguous.
CLOSE = 0.1
UNKNOWN = "und"
SLICE = 300_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of 1 and -1
    ratios: np.ndarray  # hashed n-grams x bits
    scale: np.ndarray  # typical size of each bit's output
    trust: np.ndarray  # languages x bits, adds up to 1 for a language


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes for few languages, otherwise random ones of ``10 log2 n`` bits."""
    if n < 2:
        return np.ones((n, 0), "i1")
    if n <= 6:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, "i1").T
    random, columns = np.random.default_rng(n), set()
    width = int(np.ceil(10 * np.log2(n)))
    while len(columns) < width:
        column = random.choice([1, -1], n)
        column = tuple((column * column[0]).tolist())
        if -1 in column:
            columns.add(column)
    return np.array(sorted(columns), "i1").T


def sample(docs: DataFrame, train: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``lang`` of at most ``fit_rows`` distinct rows of each language."""
    rows = docs.where(train & F.col("lang").isNotNull()).select("lang", "text", *row_keys("doc_id", "text"))
    chosen = drawn(rows, "lang", fit_rows)
    keys = ["lang", "_h1", "_h2"]
    # as many rows as the limit allows, on every executor
    return rows.join(F.broadcast(chosen), keys).dropDuplicates(keys).select("text", "lang")


def fit(rows: DataFrame) -> Model:
    rows = checkpointed(rows)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1 << BITS, 0), "f4"), np.ones(0), np.ones((len(languages), 0)))
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), "i8")
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                own = np.array([place[x] for x in batch.column(1).slice(start, stop - start).to_pylist()])
                codes, owner = ngrams.letter_codes([x or "" for x in batch.column(0).slice(start, stop - start).to_pylist()])
                for size in SIZES:
                    h, row = ngrams.hashed(codes, owner, size, BITS)
                    total += np.bincount(own[row] << BITS | h, minlength=total.size).reshape(total.shape)
        lang, h = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype("i4")), pa.array(h.astype("i4")), pa.array(total[lang, h])], names=["k", "h", "n"])

    # at most languages x 2 ** 16 rows
    counted = rows.mapInArrow(count, "k int, h int, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()
    share = np.zeros((len(languages), 1 << BITS))
    share[counted["k"].to_numpy(), counted["h"].to_numpy()] = counted["n"].to_numpy()
    share = (share + 0.5) / (share.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))  # languages count alike
    side = [np.log((share.T @ (code == s)) / (code == s).sum(axis=0)) for s in (1, -1)]
    ratios = (side[0] - side[1]).astype("f4")

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, size = np.zeros((len(languages), code.shape[1])), np.zeros((len(languages), code.shape[1]))
        rows_of = np.zeros(len(languages))
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                own = np.array([place[x] for x in batch.column(1).slice(start, stop - start).to_pylist()])
                output, grams = outputs([x or "" for x in batch.column(0).slice(start, stop - start).to_pylist()], ratios)
                own, output = own[grams > 0], output[grams > 0]
                np.add.at(right, own, output * code[own] > 0)
                np.add.at(size, own, np.abs(output))
                np.add.at(rows_of, own, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages), dtype="i4")), pa.array(rows_of), *(pa.array(list(x), pa.list_(pa.float64())) for x in (right, size))], names=["k", "n", "right", "size"])

    sums = rows.mapInArrow(margins, "k int, n double, right array<double>, size array<double>")
    bits = range(code.shape[1])
    sums = sums.groupBy("k").agg(F.sum("n").alias("n"), *(F.sum(F.col(c)[b]).alias(f"{c}{b}") for c in ("right", "size") for b in bits))
    right, size, n = np.zeros(code.shape), np.zeros(code.shape[1]), 0.0
    for r in sums.collect():
        right[r["k"]] = [r[f"right{b}"] / max(1.0, r["n"]) for b in bits]
        size += [r[f"size{b}"] for b in bits]
        n += r["n"]
    trust = np.maximum(right, 1e-3)
    return Model(languages, code, ratios, np.maximum(size / max(1.0, n), 1e-9), trust / trust.sum(axis=1, keepdims=True))


def outputs(texts: list[str], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean log ratio for each bit, and its number of n-grams with a letter."""
    codes, owner = ngrams.letter_codes(texts)
    total, grams = np.zeros((len(texts), ratios.shape[1])), np.zeros(len(texts))
    for size in SIZES:
        h, row = ngrams.hashed(codes, owner, size, BITS)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        if len(starts):
            total[row[starts]] += np.add.reduceat(ratios[h], starts, axis=0, dtype="f8")
            grams += np.bincount(row, minlength=len(texts))
    letters = np.bincount(owner[codes != ngrams.SPACE], minlength=len(texts))
    return total / np.maximum(grams, 1)[:, None], np.where(letters > 0, grams, 0)


def decode(output: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score and whether another one is about as near."""
    margin = np.clip(output / model.scale, -4, 4)
    loss = np.stack([(np.exp(-margin * word) * trust).sum(axis=1) for word, trust in zip(model.code, model.trust, strict=True)], axis=1)
    share = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ordered = np.sort(share, axis=1)
    return best, share[np.arange(len(best)), best], ordered[:, -1] - ordered[:, -2] < CLOSE


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred``, ``score`` and ``ambiguous``."""

    def predict(texts: list[str]) -> dict[str, list]:
        if len(model.languages) < 2:
            codes, owner = ngrams.letter_codes(texts)
            known = (np.bincount(owner[codes != ngrams.SPACE], minlength=len(texts)) > 0) & bool(model.languages)
            best, score, close = np.zeros(len(texts), int), known * 1.0, np.zeros(len(texts), bool)
        else:
            parts = [outputs(texts[k:k + 200], model.ratios) for k in range(0, len(texts), 200)]
            output, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
            best, score, close = decode(output, model)
            known = grams > 0
        return {
            "lang_pred": [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)],
            "score": np.where(known, score, 0.0),
            "ambiguous": close & known,
        }

    return map_texts(docs.select(*keep, F.col("text").alias("_text")), "_text", "lang_pred string, score double, ambiguous boolean", predict)
