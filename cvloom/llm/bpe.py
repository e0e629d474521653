"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.llm.worker import Shared

#: Folder of the public tokenizers; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how this family of tokenizers cuts a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to so many bytes use the rank array, whose scan is quadratic; longer ones a heap, with the same result.
SHORT = 128
#: Words of which the ids are remembered per Python worker; when full, the memory is emptied.
REMEMBER = 200_000
NONE = 1 << 30


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-pair encoding of single words, by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = regex.compile(PATTERN)
        self._seen: dict[str, tuple[int, ...]] = {}

    @classmethod
    def parse(cls, raw: bytes) -> "Encoder":
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})

    def short(self, word: bytes) -> list[int]:
        """Contiguous rank array: `start` has the part boundaries, `rank` the rank of each part joined with its right
        neighbour. The least rank is found by scanning, its boundary deleted, and the two ranks beside it refreshed."""
        get = self.ranks.get
        start = list(range(len(word) + 1))
        rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while rank:
            least = min(rank)
            if least == NONE:
                break
            i = rank.index(least)
            del start[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(word[start[i] : start[i + 2]], NONE)
            if i:
                rank[i - 1] = get(word[start[i - 1] : start[i + 1]], NONE)
        return [self.ranks[word[a:b]] for a, b in zip(start, start[1:])]

    def long(self, word: bytes) -> list[int]:
        """The same merges with a heap of (rank, position) over linked parts, for words without blanks of any length."""
        get, n = self.ranks.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # a part of this pair has changed since
            gone = end[i]
            alive[gone] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(word[p:stop], NONE)) != NONE:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; their names in the text are ordinary text."""
        seen, out = self._seen, []
        for word in self.words.findall(text):
            ids = seen.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = tuple(self.short(raw) if len(raw) <= SHORT else self.long(raw))
                if len(raw) <= SHORT:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen[word] = ids
            out.extend(ids)
        return out


def _share(spark: SparkSession, name: str, folder: str) -> Shared:
    """The vocabulary file, read on the driver and broadcast: its size (under 1 MB) does not depend on the data."""
    return Shared(spark, "encoder", read_ranks(f"{folder}/{name}.tiktoken"), Encoder.parse)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): the token ids of every row. Empty and null texts both have the empty list.

    Narrow: one pass over the two columns in Arrow batches, no shuffle. Repeated rows are encoded like any other; a null
    id is kept. Other columns are left out. Texts are never cut.
    """
    shared = _share(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.get()
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                if text:
                    flat.extend(enc.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) of every row; 0 for empty and null texts. The lists themselves never leave the worker."""
    shared = _share(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.get()
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
