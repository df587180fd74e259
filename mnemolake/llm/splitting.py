"""Splitting long texts at natural boundaries, by range-maximum queries over boundary strengths.

Every position of a text gets a strength: 6 after a blank line, 5 after a line end, 4 after a sentence, 3 after a
clause, 2 after white space, 1 elsewhere, 0 where a cut would part a base from its combining mark or "\\r" from "\\n".
A sparse table over the strengths answers in constant time which cut of a permissible length window is strongest; of
equals the rightmost is taken.  The next piece starts up to `overlap` characters before the cut, at the strongest
boundary there.

Nulls and texts within the limit come out as one piece with the text as it was; whole texts are cut, never prefixes.
Rows repeated under one id count once.  Pieces are numbered anew within the record in two steps (blocks of ords, then
offsets), so a record with very many chunks does not end in one task.  Empty tables give no pieces.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.session import once_per_id

LIMIT, OVERLAP = 1200, 120
BLOCK = 1024
PIECE_TYPE = "array<struct<no:int,start:int,end:int,text:string>>"
_SPACE = np.array([c.isspace() for c in map(chr, range(0x3001))])


def strengths(text: str) -> np.ndarray:
    """strengths[i]: how well a cut before character i fits; 0 <= i <= len(text)."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    out = np.ones(n + 1, np.int8)
    out[n] = 7
    if n < 2:
        return out
    low = np.minimum(a, 0x3000)
    space = _SPACE[low] & (a <= 0x3000)
    left, right = a[:-1], a[1:]
    sp, nsp = space[:-1], ~space[1:]
    mid = out[1:n]
    mid[sp & nsp] = 2
    two = np.zeros(n - 1, np.uint32)
    two[1:] = a[:-2]
    after = sp & nsp
    mid[after & np.isin(two, _codes(",;:)]—–"))] = 3
    mid[after & np.isin(two, _codes(".!?…。"))] = 4
    mid[np.isin(left, _codes(".!?…。！？")) & nsp & (right > 0x2E7F)] = 4
    line = np.isin(left, _codes("\n\r  "))
    mid[line & ~np.isin(right, _codes("\n\r"))] = 5
    # a blank line lies before: only white space with two line ends
    ends = np.cumsum(np.isin(a, _codes("\n")))
    last_ink = np.maximum.accumulate(np.where(~space, np.arange(n), -1))
    base = np.where(last_ink >= 0, ends[np.maximum(last_ink, 0)], 0)
    blank = (ends - base)[:-1] >= 2
    mid[blank & line & nsp] = 6
    mid[(left == 13) & (right == 10)] = 0
    for i in np.flatnonzero(right >= 0x300):
        if unicodedata.combining(chr(right[i])) or 0xFE00 <= right[i] <= 0xFE0F or right[i] == 0x200D or left[i] == 0x200D:
            mid[i] = 0
    return out


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


class RangeMax:
    """Sparse table: the rightmost greatest of any range of at most `width` places."""

    def __init__(self, values: np.ndarray, width: int):
        keyed = values.astype(np.int64) * (len(values) + 1) + np.arange(len(values))
        self.levels, self.n, step = [keyed], len(values), 1
        while step * 2 <= min(width, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(place, value) of the greatest in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        v = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return v % (self.n + 1), v // (self.n + 1)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces, in characters."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    table = RangeMax(strengths(text), limit + 1)
    out, start = [], 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        end, strength = table.best(start + limit // 2, start + limit)
        if strength < 2:
            end, strength = table.best(start + overlap + 1, start + limit)
        out.append((start, end))
        if not overlap:
            start = end
            continue
        at, strength = table.best(end - overlap, end - 1)
        if strength < 2:
            at = end - overlap
            while at < end and table.levels[0][at] < table.n + 1:
                at += 1
        start = at


def _cut(text: str | None, limit: int, overlap: int) -> list[dict]:
    if text is None:
        return [{"no": 0, "start": 0, "end": 0, "text": None}]
    return [{"no": k, "start": a, "end": z, "text": text[a:z]} for k, (a, z) in enumerate(cut_points(text, limit, overlap))]


def split_texts(
    df: DataFrame, key: str = "id", record: str = "record_id", ord_col: str = "ord", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces: id, record_id, ord (renewed), chunk_ord, piece, n_pieces, start, end, text."""

    @F.pandas_udf(PIECE_TYPE)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cut(t, limit, overlap))

    d = once_per_id(df, key, record, ord_col, text).select(
        F.col(key).alias("id"), F.col(record).alias("record_id"), F.col(ord_col).cast("bigint").alias("chunk_ord"), F.col(text).alias("text")
    )
    # only long texts pass through Python
    long = F.length("text") > limit
    one = F.array(F.struct(F.lit(0).alias("no"), F.lit(0).alias("start"), F.coalesce(F.length("text"), F.lit(0)).alias("end"), F.col("text").alias("text")))
    short = d.filter(~F.coalesce(long, F.lit(False))).withColumn("_p", one.cast(PIECE_TYPE))
    cut_up = d.filter(long).withColumn("_p", cut("text"))
    p = short.unionByName(cut_up).drop("text").withColumn("n_pieces", F.size("_p"))
    p = p.withColumn("_b", F.coalesce(F.floor(F.col("chunk_ord") / BLOCK), F.lit(9_007_199_254_740_991)).cast("bigint"))
    inside = Window.partitionBy("record_id", "_b").orderBy(F.col("chunk_ord").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = p.groupBy("record_id", "_b").agg(F.sum("n_pieces").alias("_n"))
    before = Window.partitionBy("record_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("record_id").alias("_rec"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    p = p.withColumn("_in", F.coalesce(F.sum("n_pieces").over(inside), F.lit(0)))
    p = p.join(blocks, p["record_id"].eqNullSafe(blocks["_rec"]) & (p["_b"] == blocks["_bb"]))
    p = p.select("id", "record_id", "chunk_ord", "n_pieces", "_in", "_base", F.explode("_p").alias("_x"))
    return p.select(
        "id", "record_id", (F.col("_base") + F.col("_in") + F.col("_x.no")).cast("bigint").alias("ord"), "chunk_ord",
        F.col("_x.no").cast("bigint").alias("piece"), F.col("n_pieces").cast("bigint").alias("n_pieces"),
        F.col("_x.start").cast("bigint").alias("start"), F.col("_x.end").cast("bigint").alias("end"), F.col("_x.text").alias("text"),
    )
