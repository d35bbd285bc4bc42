"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups.

Documents are tokenised, end with an end id, and are cut at multiples of the sequence length. The pieces
are dealt to groups at random (a hash of the reading task and the row's place in it), so that a group
has about ``group_pieces`` pieces whatever the documents are. In a group the pieces go, longest first,
to the first sequence with room; a tournament tree of the free room finds it in log time.

A null or empty text is the end id alone. Null and repeated ids and repeated rows are packed like any
other. Pieces of one length are ordered by their random place. An empty table gives no rows; columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, mix, trimmed
from vitrine.session import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)


#: A control character that stands between the words of one call to the tokenizer.
MARK = b"\x01"


class WordEncoder:
    """Token ids of texts, word by word, for a tokenizer that drops white space.

    Such a tokenizer treats each word by itself, so every distinct word is encoded once. About
    ``most_bytes`` of words are remembered; beyond that those go that one call only has met since the last time,
    then the rarest, until half is free.
    """

    #: Bytes of a remembered word beside its letters and ids: dictionary entry, objects, places.
    EACH = 200

    def __init__(self, path: str, most_bytes: int = 96_000_000):
        # A pool of threads in every worker would hold more memory than the words.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes = Tokenizer.from_file(path), most_bytes
        self.mark_ids = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.n, self.used, self.held = 0, 0, 0
        self.start, self.width = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)

    def compact(self) -> None:
        """Forget the words that one call has met, and of the others the rarest beyond half the bytes."""
        words, n = list(self.place), self.n
        size = np.fromiter(map(len, words), np.int64, n) + 4 * self.width[:n] + self.EACH
        often = np.flatnonzero(self.hits[:n] > 1)
        often = often[np.argsort(-self.hits[often], kind="stable")]
        often = np.sort(often[np.cumsum(size[often]) <= self.most_bytes // 2])
        width = self.width[often]
        edges = np.concatenate([[0], np.cumsum(width)])
        flat = self.flat[np.repeat(self.start[often] - edges[:-1], width) + np.arange(edges[-1])]
        self.clear()
        self.place = {words[i]: k for k, i in enumerate(often.tolist())}
        self.n, self.used, self.held = len(often), len(flat), int(size[often].sum())
        self.start, self.width = self._room(self.start, self.n), self._room(self.width, self.n)
        self.hits, self.flat = self._room(self.hits, self.n), self._room(self.flat, self.used)
        self.start[: self.n], self.width[: self.n], self.flat[: self.used] = edges[:-1], width, flat

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(len(a), need - len(a)), a.dtype)])

    def _separate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of them in each, one word at a time."""
        ids, counts = [], []
        for w in words:
            got = self.tokenizer.encode(w.decode(), add_special_tokens=False).ids
            ids += got
            counts.append(len(got))
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same in one call: the words stand between marks that none of them holds."""
        if len(self.mark_ids) != 1 or MARK in b" ".join(words):
            return self._separate(words)
        text = f" {MARK.decode()} ".join([w.decode() for w in words])
        # The fast form leaves out the places in the text.
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_ids[0])
        if len(marks) != len(words) - 1:
            return self._separate(words)
        counts = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        return np.delete(ids, marks), counts

    def learn(self, words: list[bytes]) -> None:
        ids, counts = self._together(words)
        n, m = self.n + len(words), self.used + len(ids)
        self.start, self.width, self.flat = self._room(self.start, n), self._room(self.width, n), self._room(self.flat, m)
        self.hits = self._room(self.hits, n)
        self.held += sum(map(len, words)) + 4 * len(ids) + self.EACH * len(words)
        self.start[self.n : n] = self.used + np.cumsum(counts) - counts
        self.width[self.n : n] = counts
        self.flat[self.used : m] = ids
        self.place.update(zip(words, range(self.n, n)))
        self.n, self.used = n, m

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.held > self.most_bytes:
            self.compact()
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += t.split()
            ends.append(len(words))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            for i in range(0, len(new), 256):
                self.learn(new[i : i + 256])
            at[unknown] = [self.place[words[i]] for i in unknown]
        self.hits[at] += 1  # once a call, however often the word stands in it
        width = self.width[at]
        edges = np.concatenate([[0], np.cumsum(width)])
        flat = self.flat[np.repeat(self.start[at] - edges[:-1], width) + np.arange(edges[-1])]
        cuts = edges[np.array([0, *ends])].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def encoder_for(path: str) -> WordEncoder:
    """One encoder per worker process; tasks that follow each other share its words."""
    return WordEncoder(path)


def _pieces(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                ids = some.column(0).to_pylist()
                texts = [t or b"" for t in some.column(1).to_pylist()]
                cols: list[list] = [[] for _ in range(5)]
                for doc, tokens in zip(ids, encoder.encode(texts)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(tokens), length):
                        piece = tokens[at : at + length]
                        for c, x in zip(cols, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(tokens))):
                            c.append(x)
                place = (np.arange(row, row + len(cols[0])) + (part << 40)).astype(U64)
                row += len(cols[0])
                slot = (mix(place + U64(0x9E3779B97F4A7C15)) >> U64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols] + [pa.array(slot)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"],
                )

    return run


def first_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the order given; every size is at most ``length``."""
    leaves = 1 << max(0, (len(sizes) - 1)).bit_length()
    best = [length] * (2 * leaves)  # best[i]: the most free room below node i of the tournament
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if best[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(length - best[node])
        best[node] -= size
        while node > 1:
            node //= 2
            most = max(best[2 * node], best[2 * node + 1])
            if best[node] == most:
                break
            best[node] = most
    return bins, offsets


def _fill(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "slot"], ascending=[False, True])
        bins, offsets = first_fit(group["length"].tolist(), length)
        first = int(group["bucket"].iloc[0])
        group = group.assign(sequence_id=[(first << 32) + b for b in bins], offset=offsets)
        group["sequence_tokens"] = group.groupby("sequence_id")["length"].transform("sum")
        return group[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, group_pieces: int = 4096
) -> DataFrame:
    """One row per piece: its document, place and checksum, and its sequence and offset there."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    pieces = materialize(texts.mapInArrow(trimmed(_pieces(tokenizer, end_id, length)), PIECES), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("bucket", F.col("slot") % groups)
    return dealt.groupBy("bucket").applyInPandas(_fill(length), PACKED)
