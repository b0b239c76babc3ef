"""Splitting oversized texts at natural boundaries by pointer doubling.

Every position of a text where a piece may end is a boundary: the end of a paragraph, a sentence, a word, or, where
nothing better lies in reach, any character. Each boundary e is joined to its farthest legal successor: the piece
after e starts at e - overlap and holds at most `limit` characters, so its end lies in (e, e - overlap + limit]; the
best kind of boundary in the last two thirds of that reach wins, and of one kind the farthest. The table of successors
is then squared again and again; after k squarings the set of reached boundaries holds the first 2^k greedy cuts, so
all cuts of all texts of a batch are found in log2(pieces) vectorised steps.

Cases: null texts and texts without a limit or within it come out as one whole piece (an empty text as one empty
piece, a null text as none); an overlap of the limit or more counts as one character less than the limit, so that pieces
go on, a negative or null one as 0, a limit below 1 as 1; repeated rows are split each by itself; pieces are exact substrings, so dropping the
overlaps gives back the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}")
LINE = re.compile(r"\r?\n")
SENTENCE = re.compile(r"[.!?。！？…]+[\"'”’)\]]*(?=\s)\s*")
BLANK = re.compile(r"\s+")
PIECES = "piece_no int, start_char int, end_char int, piece string"


def boundary_rank(text: str) -> np.ndarray:
    """For each position 0..len: 4 after a paragraph, 3 after a line, 2 after a sentence, 1 after a word, else 0."""
    rank = np.zeros(len(text) + 1, np.int8)
    for value, pattern in ((1, BLANK), (2, SENTENCE), (3, LINE), (4, PARAGRAPH)):
        at = [m.end() for m in pattern.finditer(text)]
        rank[at] = value
    rank[-1] = 5
    return rank


def successors(rank: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Farthest legal successor of every position as the end of a piece; position 0 starts the first piece."""
    n = len(rank) - 1
    at = np.arange(n + 1)
    start = np.where(at == 0, 0, np.maximum(at - overlap, 0))
    far = np.minimum(start + limit, n)
    near = np.minimum(np.maximum(at + 1, start + limit // 3), far)
    succ = far.copy()  # a cut between any two characters
    done = far == n
    for value in (4, 3, 2, 1):
        marks = np.where(rank >= value, at, -1)
        last = np.maximum.accumulate(marks)[far]  # the last boundary of this kind up to the reach
        good = ~done & (last >= near) & (last > at)
        succ[good] = last[good]
        done |= good
    succ[n] = n
    return succ


def doubled(succ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All nodes on the paths from starts, by squaring the table."""
    reached = np.zeros(len(succ), bool)
    front, reached[starts] = starts, True
    while True:
        fresh = succ[front]
        fresh = fresh[~reached[fresh]]
        if not len(fresh):
            return np.flatnonzero(reached)
        reached[fresh] = True
        front, succ = np.flatnonzero(reached), succ[succ]


def cuts(texts: list[str], limits: list[int], overlaps: list[int]) -> list[np.ndarray]:
    """Ends of the pieces of each text, the last being its length."""
    tables, base, starts = [], 0, []
    for text, limit, overlap in zip(texts, limits, overlaps):
        tables.append(successors(boundary_rank(text), limit, overlap) + base)
        starts.append(base)
        base += len(text) + 1
    nodes = doubled(np.concatenate(tables), np.array(starts))
    bounds = np.searchsorted(nodes, np.array([*starts, base]))
    return [nodes[lo + 1 : hi] - s for lo, hi, s in zip(bounds[:-1], bounds[1:], starts)]


AT_ONCE = 4_000_000  # characters whose tables are squared together; a longer text goes alone


def _groups(sizes: list[int]):
    """Slices of neighbours of at most AT_ONCE characters."""
    lo = held = 0
    for k, n in enumerate(sizes):
        if k > lo and held + n > AT_ONCE:
            yield slice(lo, k)
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def _split(batches):
    for b in batches:
        ids, texts = b.column("row").to_pylist(), b.column("text").to_pylist()
        limits = [max(1, x) for x in b.column("max_chars").to_pylist()]
        overlaps = [min(max(0, o or 0), x - 1) for o, x in zip(b.column("overlap_chars").to_pylist(), limits)]
        out: list[list] = [[], [], [], [], []]
        for part in _groups([len(t) for t in texts]):
            for i, text, overlap, ends in zip(ids[part], texts[part], overlaps[part], cuts(texts[part], limits[part], overlaps[part])):
                begin = np.r_[0, np.maximum(ends[:-1] - overlap, 0)]
                for k, (s, e) in enumerate(zip(begin.tolist(), ends.tolist())):
                    for column, value in zip(out, (i, k + 1, s, e, text[s:e])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["row", "piece_no", "start_char", "end_char", "piece"])


def _exceeds(text_col: str) -> Column:
    return F.col("max_chars").isNotNull() & (F.length(text_col) > F.greatest(F.col("max_chars"), F.lit(1)))


def oversized_pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, piece_no, start_char, end_char, piece) of the rows whose text exceeds max_chars.

    df has the columns max_chars and overlap_chars (null: no limit).
    """
    big = df.filter(_exceeds(text_col))  # before Python: most texts are small
    return big.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"), "max_chars", "overlap_chars").mapInArrow(_split, "row long, " + PIECES)


def pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As oversized_pieces, with each text within its limit as one whole piece."""
    whole = df.filter(F.col(text_col).isNotNull() & ~F.coalesce(_exceeds(text_col), F.lit(False)))
    one = whole.select(F.col(id_col).cast("long").alias("row"), F.lit(1).alias("piece_no"), F.lit(0).alias("start_char"), F.length(text_col).alias("end_char"), F.col(text_col).alias("piece"))
    return oversized_pieces(df, id_col, text_col).unionByName(one)


def with_limits(docs: DataFrame, limits: DataFrame, key: str = "source_type") -> DataFrame:
    """docs with max_chars and overlap_chars of their key; limits has one row per key (checked: the least wins)."""
    one = limits.groupBy(key).agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    return docs.drop("max_chars", "overlap_chars").join(one, key, "left")
