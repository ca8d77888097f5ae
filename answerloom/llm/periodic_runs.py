"""Stretches of words that repeat one block at least four times, found by uniting suffix classes by common prefix.

The suffixes of a text fall into classes by the words they begin with. Two neighbours in suffix order join their classes
at the length of their common prefix; taken from the longest prefix down, the classes grow as ordered sets of positions
(a Kruskal pass with union-find). Where two positions become neighbours in such a set at a distance p that is short
against the common prefix, the words from the first one on repeat with period p, and no smaller one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import SPACE, flat, slices, spans_of
from answerloom.session import ship

#: Fewest words of a run, and how often its block must fit in.
MIN_LENGTH, MIN_EXPONENT = 6, 4
SPACES = "[\x20\x09-\x0d]+"
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"id long, n_words long, runs array<{RUN}>, top {RUN}, collapsed string"


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts, byte starts and ends of its words, a number for each distinct word, and the first
    word of each text and the count. Numbers are given by the words' bytes, not by a digest of them."""
    data, offsets = flat(column)
    starts, ends = spans_of(~SPACE[data], offsets)
    body = data[~SPACE[data]]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(body)])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return data, starts, ends, numbers, np.searchsorted(starts, offsets)


def _group_starts(new: np.ndarray) -> np.ndarray:
    """Place of the first member of each one's group, groups beginning where `new` is true."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _contested(new: np.ndarray) -> np.ndarray:
    """Members of groups of two or more."""
    alone = new & np.append(new[1:], True)
    return ~alone


def suffix_ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols until no two are equal, and the positions, in rank
    order, that share their rank with another at each step.

    Prefix doubling: only positions that still share a rank are sorted again, by their rank and that of the suffix as
    many symbols further on as are ranked already. A rank is the place of the first of its group, so it holds once alone.
    """
    by = np.argsort(symbols, kind="stable")
    new = np.ones(len(by), dtype=bool)
    new[1:] = symbols[by[1:]] != symbols[by[:-1]]
    rank = np.empty(len(by), dtype=np.int32)
    rank[by] = _group_starts(new)
    levels, shared = [rank], [by[_contested(new)]]
    width = 1
    while len(shared[-1]):
        at = shared[-1]
        old = rank[at].astype(np.int64)
        key = old * len(rank) + rank[at + width]
        order = np.argsort(key, kind="stable")
        at, old, key = at[order], old[order], key[order]
        new, first = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
        new[1:], first[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        rank = rank.copy()
        rank[at] = old + _group_starts(new) - _group_starts(first)
        levels.append(rank)
        shared.append(at[_contested(new)])
        width *= 2
    return levels, shared


def close_suffixes(levels: list[np.ndarray], shared: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share `least` symbols or more, with the number they share, longest first."""
    step = max(0, min(int(least).bit_length() - 1, len(levels) - 1))  # those that share 2^step symbols; least is beyond
    at = shared[step]
    at = at[np.argsort(levels[-1][at], kind="stable")]
    a, b = at[:-1], at[1:]
    near = levels[step][a] == levels[step][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + common] == levels[k][b + common]
        common += same.astype(np.int64) << k
    enough = common >= least
    a, b, common = a[enough], b[enough], common[enough]
    by = np.argsort(-common, kind="stable")
    return a[by], b[by], common[by]


def seeds(a: np.ndarray, b: np.ndarray, common: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """Positions that become neighbours in a class, at a distance p of at most common / `reach`: (first, p, common).

    Classes unite in the order given; the smaller one's positions go into the larger one's ordered list.
    """
    places = np.unique(np.concatenate([a, b]))
    left, right = np.searchsorted(places, a).tolist(), np.searchsorted(places, b).tolist()
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[p] for p in places.tolist()]
    found = []
    for x, y, shared in zip(left, right, common.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        parent[y] = x
        large, small = members[x], members[y]
        members[y] = None
        widest = shared // reach
        if len(small) == 1:
            place = small[0]
            i = bisect_left(large, place)
            if i and place - large[i - 1] <= widest:
                found.append((large[i - 1], place - large[i - 1], shared))
            if i < len(large) and large[i] - place <= widest:
                found.append((place, large[i] - place, shared))
            large.insert(i, place)
            continue
        for place in small:
            insort(large, place)
        for j, place in enumerate(small):
            i = bisect_left(large, place)
            before = large[i - 1] if i else None
            if before is not None and place - before <= widest and not (j and small[j - 1] == before):
                found.append((before, place - before, shared))
            after = large[i + 1] if i + 1 < len(large) else None
            if after is not None and after - place <= widest and not (j + 1 < len(small) and small[j + 1] == after):
                found.append((place, after - place, shared))
    return found


def slice_runs(numbers: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text of a slice, by start and period."""
    n_texts = len(first) - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    text = np.repeat(np.arange(n_texts), np.diff(first))
    # One symbol that occurs nowhere else stands before, between and after the texts, so nothing matches across it;
    # words of different texts are different symbols.
    symbols = np.empty(len(numbers) + n_texts + 1, dtype=np.int64)
    ends = np.concatenate([first[:-1] + np.arange(n_texts), [len(symbols) - 1]])
    symbols[ends] = np.arange(n_texts + 1)
    distinct = int(numbers.max()) + 1 if len(numbers) else 1
    at = np.arange(len(numbers)) + text + 1
    symbols[at] = n_texts + 1 + text * distinct + numbers
    levels, shared = suffix_ranks(symbols)
    reach = min_exponent - 1
    # a run of period p shares length - p words with itself p further on: least is min_length - p, or reach times p
    least = max(1, min(max(reach * p, min_length - p) for p in range(1, min_length + 1)))
    for u, period, common in seeds(*close_suffixes(levels, shared, least), reach):
        if period + common >= min_length and symbols[u - 1] != symbols[u + period - 1]:
            t = int(np.searchsorted(ends, u, side="right")) - 1
            runs[t].append((u - int(ends[t]) - 1, period + common, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(kept)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    more = np.append(text[1:] == text[:-1], False) if len(at) else np.zeros(0, dtype=bool)
    out = data.copy()
    out[ends[at][more]] = 32  # a byte of white space: a later word of the text follows
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts[at]] += 1
    inside[ends[at] + more] -= 1
    sizes = np.bincount(text, weights=(ends - starts)[at] + more, minlength=len(first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    body = out[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))


def _rows(column: pa.Array, min_length: int, min_exponent: int) -> list[pa.Array]:
    data, starts, ends, numbers, first = word_numbers(column)
    found = slice_runs(numbers, first, min_length, min_exponent)
    kept = np.ones(len(starts), dtype=bool)
    for t, runs in enumerate(found):
        for start, length, period in runs:
            kept[first[t] + start + period : first[t] + start + length] = False
    named = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
    top = [max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if runs else None for runs in named]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return [pa.array(np.diff(first)), pa.array(named, pa.list_(run)), pa.array(top, run), collapsed(data, starts, ends, first, kept)]


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Periodic runs of every text: id, n_words, runs (start, length, period; by start, then period), top, collapsed.

    Words are parted by ASCII white space. A run is a stretch of words with smallest period p, at least `min_length`
    words and `min_exponent` periods long, which no neighbouring word extends; start is a word number from 0. `top` is
    the run with the greatest length / period (ties: smallest start, then period; null without runs). `collapsed` has the
    words that stay when every run keeps its first period only, joined by one space.

    Each text is looked at by itself and in its row: nothing is shuffled, and a task holds one slice of texts (or one
    longer text) at a time, with 4 bytes for each word and each doubling of the longest repeat.

    Nulls: a null text has no words; null ids stay null. Empty texts have no run and an empty `collapsed`. Repeated rows
    give equal rows. Extra columns are ignored. An empty table gives an empty result. Texts are read whole.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be at least 2 and min_length positive.")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = _rows(batch.column(1), min_length, min_exponent)
            yield pa.record_batch([batch.column(0), *columns], names=["id", "n_words", "runs", "top", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which about a tenth repeat a block to their end, as a digest of the id says: doc_id, text.

    With h = crc32 of the id as text and n words, texts with h % 10 = 0 become their first a = (h div 10) % n words and
    then the p = 1 + (n - a) div (3 + (h div 10) % 8) words from there on, over and over, up to n words. Rows without an
    id or without words stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.array_remove(F.split("text", SPACES), "")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS int) END"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS int)"))
    head = F.slice("w", F.lit(1), F.col("a"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    over = F.flatten(F.array_repeat(block, F.expr("CAST((n - a + p - 1) div p AS int)")))
    tail = F.slice(over, F.lit(1), F.col("n") - F.col("a"))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """The digest columns of `periodic_runs`."""
    line: Column = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    every = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return runs.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *("top.start", "top.length", "top.period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
