"""Packing: documents as sequences of 2,048 tokens, by first-fit decreasing.

A document is cut at multiples of the sequence length; its full pieces are sequences
of their own, what is left over is packed. Pieces fall into random groups by a hash of
their row's number, and each group is packed on its own: pieces in order of size go to the first
bin with room, which a tournament tree of the bins' room finds in logarithmic time.

* null and empty texts have the end token alone
* repeated rows are packed each; pieces of equal length are ordered by doc_id
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import checkpointed, slices

CAPACITY = 2048
END_TOKEN = 1
GROUP_PIECES = 4000
#: Words and word parts whose ids a worker remembers.
REMEMBERED = 300_000


class WordTokenizer:
    """Ids of whole texts by a public tokenizer, which sees each word once.

    The tokenizer cuts at white space whatever it does later, so a text's ids are
    its words' ids one after another. Words of Latin letters, digits and signs are cut
    into their parts here; all others go through the whole tokenizer. Memory is
    bounded: two generations of remembered words, the older one given up when the
    younger is full.
    """

    def __init__(self, path: str, end_token: int = END_TOKEN):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        # Fixed value: the public tokenizer's own rule for parts of a word.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.end = array("I", [end_token]).tobytes()
        self.words: tuple[dict, dict] = ({}, {})
        self.pieces: tuple[dict, dict] = ({}, {})

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers in this machine's order, end token included."""
        words = text.encode("utf-8", "replace").split()
        young, old = self.words
        missing = {w for w in words if w not in young}
        if missing:
            if len(young) + len(missing) > REMEMBERED:
                young, old = self.words = ({}, young)
                missing = set(words)
            new = set()
            for word in missing:
                known = old.get(word)
                if known is None:
                    new.add(word)
                else:
                    young[word] = known
            if new:
                self._learn(new)
        return b"".join([*map(young.__getitem__, words), self.end])

    def _learn(self, words: set[bytes]) -> None:
        cuts, parts = {}, set()
        young, old = self.pieces
        for word in words:
            text = word.decode()
            if self.plain(text) and "<|" not in text:
                cuts[word] = found = self.cut(text.lower())
                parts.update(p for p in found if p not in young)
            else:
                self.words[0][word] = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(young) + len(parts) > REMEMBERED:
            young, old = self.pieces = ({}, young)
            parts = {p for found in cuts.values() for p in found}
        unknown = []
        for part in parts:
            if (known := old.get(part)) is None:
                unknown.append(part)
            else:
                young[part] = known
        for start in range(0, len(unknown), 1000):
            some = unknown[start:start + 1000]
            ids = np.array(self.parts.encode(" ".join(some), add_special_tokens=False).ids, "u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a part of a word has no end mark")
            raw, at = ids.tobytes(), 0
            for part, end in zip(some, ends.tolist(), strict=True):
                young[part] = raw[4 * at:4 * end]
                at = end
        for word, found in cuts.items():
            self.words[0][word] = b"".join([young[p] for p in found])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            for first, stop in slices(batch.column(1)):
                piece = batch.slice(first, stop - first)
                rows: list[list] = [[] for _ in names]
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    raw = encode(text or "")
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        ids = raw[4 * start:4 * (start + capacity)]
                        for column, value in zip(rows, (doc, start, len(ids) // 4, zlib.crc32(ids), total), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ``lengths`` in descending order.

    The tree's leaves are the bins' room, each inner node the larger of its two
    children; the first bin with room is found from the root down.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, "i8"), np.zeros(n, "i8")
    for k, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - tree[node]
        tree[node] -= length
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece of a document: where it is in which sequence."""
    # numbers are written with the pieces, so they stay; equal rows have numbers of their own
    pieces = checkpointed(token_pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / group_pieces))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    group = F.pmod(F.xxhash64("row"), F.lit(groups))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["bucket", "row"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return pieces.withColumn("bucket", group).groupBy("bucket").applyInPandas(fill, schema)
