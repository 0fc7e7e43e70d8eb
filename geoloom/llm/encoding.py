"""Encoding of a corpus by a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern; each piece is merged by a priority queue of merge ranks over
a doubly linked list of symbols, where entries whose symbols have changed since are skipped as stale. Pieces seen
before come from a table. A null or empty text has the defined encoding of no ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that byte_bpe_50k cuts texts by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in each worker's table; beyond that it starts anew.
TABLE = 400_000


class ByteBPE:
    def __init__(self, file: str, pattern: str = PATTERN) -> None:
        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cut = regex.compile(pattern)
        self.table: dict[str, tuple[int, ...]] = {}
        self.vocabulary: dict[int, bytes] | None = None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # symbol i is piece[i:end[i]]; end 0: merged into its left neighbour
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, middle, stop = heapq.heappop(queue)
            if end[i] != middle or right[i] != middle or end[middle] != stop:
                continue  # stale
            end[i], end[middle] = stop, 0
            after = right[middle]
            right[i] = after
            if after < n:
                left[after] = i
                if (r := ranks.get(piece[i : end[after]])) is not None:
                    heapq.heappush(queue, (r, i, stop, end[after]))
            if (before := left[i]) >= 0 and (r := ranks.get(piece[before:stop])) is not None:
                heapq.heappush(queue, (r, before, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        table = self.table
        for piece in self.cut.findall(text):
            ids = table.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(table) >= TABLE:
                    table.clear()
                if len(piece) <= 64:
                    table[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if self.vocabulary is None:
            self.vocabulary = {i: b for b, i in self.ranks.items()}
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(file: str, pattern: str = PATTERN) -> ByteBPE:
    """One encoder a worker process and file."""
    return ByteBPE(file, pattern)


def vocabulary_file(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> str:
    return f"{folder}/{name}"


def encode(df: DataFrame, id_column: str, text: str, file: str | None = None, out: str = "ids") -> DataFrame:
    """id_column and the ids of each row's text: an empty list for a null or empty text, no special tokens.

    Texts are encoded whole, however long; strings of special tokens are ordinary text. Repeated rows are encoded
    row by row; an empty table gives an empty table. Only the two columns are read, so other names cannot clash.
    """
    file = file or vocabulary_file()
    narrow = df.select(F.col(id_column), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_column, out])

    return narrow.mapInArrow(run, f"`{id_column}` {narrow.schema[0].dataType.simpleString()}, `{out}` array<int>")


def decode(df: DataFrame, id_column: str, ids: str, file: str | None = None, out: str = "text") -> DataFrame:
    """id_column and the text of each row's ids; a null list gives a null text, an empty one an empty text."""
    file = file or vocabulary_file()
    narrow = df.select(F.col(id_column), F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_column, out])

    return narrow.mapInArrow(run, f"`{id_column}` {narrow.schema[0].dataType.simpleString()}, `{out}` string")


def token_counts(df: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = (), file: str | None = None) -> DataFrame:
    """id_column, the columns to keep, and size: number of ids of the text."""
    file = file or vocabulary_file()
    narrow = df.select(F.col(id_column), *keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            n = len(b.schema.names) - 1
            sizes = [len(bpe.encode(t.as_py())) for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sizes, pa.int32())], names=[*b.schema.names[:n], "size"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    return narrow.mapInArrow(run, f"{fields}, size int")
