"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; each piece is merged pair by pair, lowest rank first and of
equals the leftmost.  A segment tree over the byte positions of the piece holds at every node the leftmost minimum of
the pair ranks below it; a merge changes the ranks of two live neighbours and removes one place, three point updates of
logarithmic cost, so a piece of n bytes takes O(n log n) also when it is very long.

The vocabulary is a file of a public tokenizer (text lines: base64 of the bytes, rank); its path is a parameter.
Null and empty texts give an empty list.  No special tokens are made; their spelling in a text is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Published pattern of the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 40
_CACHE_SIZE = 400_000


class Vocabulary:
    """Ranks of byte strings and an encoder with a cache of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split, self.cache = ranks, regex.compile(pattern), {}

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not text.isascii():
            text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        out, cache = [], self.cache
        for piece in self.split.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(cache) >= _CACHE_SIZE:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        # leaf i: rank of the pair whose left part begins at byte i; a node holds the least of its leaves
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(raw[i : i + 2], _NONE)
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a <= b else b
        end = list(range(1, n + 1))  # end of the part that begins at i
        before = list(range(-1, n - 1))  # begin of the part to the left

        def put(i: int, rank: int) -> None:
            v = size + i
            tree[v] = rank
            while v > 1:
                v >>= 1
                a, b = tree[2 * v], tree[2 * v + 1]
                least = a if a <= b else b
                if tree[v] == least:
                    break
                tree[v] = least

        while tree[1] != _NONE:
            least, v = tree[1], 1
            while v < size:
                v *= 2
                if tree[v] != least:
                    v += 1
            i = v - size
            j = end[i]
            k = end[j]
            end[i] = k
            put(j, _NONE)
            put(i, ranks.get(raw[i : end[k]], _NONE) if k < n else _NONE)
            if k < n:
                before[k] = i
            h = before[i]
            if h >= 0:
                put(h, ranks.get(raw[h:k], _NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """key and ids (array<int>) of every row; rows keep their number, repeated ids included.

    The vocabulary is read where the driver has it and shipped to the workers as a file of the job."""
    df.sparkSession.sparkContext.addFile(vocab_path)
    name = vocab_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocabulary(SparkFiles.get(name)).encode
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "ids": pdf["t"].map(lambda t: encode(t if isinstance(t, str) else None))})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")
