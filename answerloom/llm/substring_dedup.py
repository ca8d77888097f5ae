"""Removal of repeated word sequences by recompression of the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import flat, mix, pair, stretch_names, window_names, words
from answerloom.llm.repeats import Runs, counts_of, given_id, merged, repeated_spans, row_keyed, unpacked, with_spans

#: Consecutive words from which a repeated sequence goes, and rounds of recompression.
MIN_WORDS, ROUNDS = 20, 2


@dataclass
class Symbols:
    """Symbols of the texts of a slice in order: name, text, first word, and the words that settle it (low to high).

    A symbol whose settling words lie in a window is the same wherever the window occurs. At the edge of a text they
    reach one word beyond it, for a window can't tell the edge of a text. Neither bound ever decreases.
    """

    name: np.ndarray
    text: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _merge(s: Symbols, joins: np.ndarray, name: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Symbols after each symbol i with joins[i] is merged into the one before; `name` names the results.

    What settles a result are its parts and both neighbours.
    """
    head = np.flatnonzero(~joins)
    last = np.append(head[1:], len(joins)) - 1
    before = np.maximum(head - 1, 0)
    after = np.minimum(last + 1, len(joins) - 1)
    inner = (head > 0) & (s.text[before] == s.text[head])
    low = np.where(inner, s.low[before], offsets[s.text[head]] - 1)
    inner = (last + 1 < len(joins)) & (s.text[after] == s.text[head])
    high = np.where(inner, s.high[after], offsets[s.text[head] + 1] + 1)
    return Symbols(name, s.text[head], s.start[head], low, high)


def recompress(s: Symbols, number: int, offsets: np.ndarray) -> Symbols:
    """One round: runs of a symbol get a name, then each pair of a left and a right symbol.

    A symbol is left or right by a digest of what it repeats, not of how often, so that a neighbour's side shows in
    its first symbol. A left symbol before a right one is merged with it, so merged pairs never overlap.
    """
    if not len(s.name):
        return s
    same = np.zeros(len(s.name), dtype=bool)
    same[1:] = (s.name[1:] == s.name[:-1]) & (s.text[1:] == s.text[:-1])
    head = np.flatnonzero(~same)
    count = np.diff(np.append(head, len(same))).astype(np.uint64)
    base = s.name[head]
    blocks = _merge(s, same, np.where(count > 1, pair(base, count), base), offsets)
    left = (mix(base + np.uint64(number)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(base), dtype=bool)
    joins[1:] = left[:-1] & ~left[1:] & (blocks.text[1:] == blocks.text[:-1])
    head = np.flatnonzero(~joins)
    two = np.append(joins[1:], False)[head]
    following = blocks.name[np.minimum(head + 1, len(joins) - 1)]
    name = np.where(two, pair(blocks.name[head], following), blocks.name[head])
    return _merge(blocks, joins, name, offsets)


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position of the leftmost least name in each non-empty range."""
    tables = [np.arange(len(names), dtype=np.int64)]
    size = int((high - low).max(initial=1))
    while (1 << len(tables)) <= size:
        half = 1 << (len(tables) - 1)
        a, b = tables[-1][:-half], tables[-1][half:]
        tables.append(np.where(names[b] < names[a], b, a))
    level = np.floor(np.log2(high - low)).astype(np.int64)
    out = np.empty(len(low), dtype=np.int64)
    for k, table in enumerate(tables):
        at = np.flatnonzero(level == k)
        a, b = table[low[at]], table[high[at] - (1 << k)]
        out[at] = np.where(names[b] < names[a], b, a)
    return out


def recompressed_runs(width: int, rounds: int):
    """Anchor of a window: of its settled symbols of the highest level that has any, the leftmost of least name.

    The key of an anchor is the name of the words that settle the symbol, all of which lie in the window. A window
    without a settled symbol (inside a long run, say) is its own anchor.
    """
    length = max(d for d in range(1, 6) if width % d == 0)

    def runs_of(column: pa.Array) -> tuple[np.ndarray, Runs]:
        data, starts, ends, names, offsets = words(column)

        def cut(texts: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
            at = offsets[texts]
            return [data[a:b].tobytes() for a, b in zip(starts[at + first], ends[at + last - 1], strict=True)]

        n = len(names)
        grams = window_names(names, length)
        if n < width:
            none = np.zeros(0, dtype=np.int64)
            return offsets, Runs(none, none, none, grams, length, cut)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        valid = np.zeros(n, dtype=bool)
        valid[: n - width + 1] = text[: n - width + 1] == text[width - 1 :]
        position = np.arange(n)
        levels = [Symbols(names, text, position, position, position + 1)]
        for number in range(rounds):
            levels.append(recompress(levels[-1], number, offsets))
        windows = np.flatnonzero(valid)
        level, symbol = np.zeros(len(windows), dtype=np.int64), windows.copy()
        open_ = np.arange(len(windows))
        for number, s in reversed(list(enumerate(levels[1:], 1))):
            p = windows[open_]
            low = np.searchsorted(s.low, p, side="left")
            high = np.searchsorted(s.high, p + width, side="right")
            some = high > low
            level[open_[some]], symbol[open_[some]] = number, _least(s.name, low[some], high[some])
            open_ = open_[~some]
        head = np.ones(len(windows), dtype=bool)
        head[1:] = (windows[1:] != windows[:-1] + 1) | (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.zeros(n, dtype=bool)
        at[windows[head]] = True
        windows, level, symbol = windows[head], level[head], symbol[head]
        anchor, low, high = windows.copy(), windows.copy(), windows + width
        for number, s in enumerate(levels[1:], 1):
            of = level == number
            anchor[of], low[of], high[of] = s.start[symbol[of]], s.low[symbol[of]], s.high[symbol[of]]
        key = stretch_names(window_names(names, 2), 2, low, high)[0] + level.astype(np.uint64)
        return offsets, Runs(windows, counts_of(at, valid), anchor, grams, length, cut, key)

    return runs_of


def repeated_word_spans(
    docs: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Word spans (id, own, start, end) covered by sequences of `min_words` words that also start earlier in the corpus.

    The texts are recompressed: round by round, runs of a symbol and pairs of a left and a right symbol get a new
    name. A name is a digest of what it stands for, so all texts agree on it without a dictionary, and equal word
    sequences have equal symbols except near their ends. Of each window of words the highest symbols that don't
    depend on anything outside reveal it: windows are brought together by them, then verified by their words.
    """
    return repeated_spans(row_keyed(docs, id_col, text_col), recompressed_runs(min_words, rounds), min_words)


KEPT_SCHEMA = "id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _erase(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            data, starts, ends, _, offsets = words(batch.column(1))
            raw = data.tobytes()
            out: list[list] = [[], [], [], [], []]
            for i, own in enumerate(batch.column(2)):
                a, b = offsets[i], offsets[i + 1]
                first, last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if own.is_valid:
                    first = own.values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                    last = own.values.field("end").to_numpy(zero_copy_only=False).astype(np.int64)
                    first, last = merged(np.minimum(first, b - a), np.minimum(last, b - a))
                    first, last = first[last > first], last[last > first]
                keep = np.ones(b - a, dtype=bool)
                for s, e in zip(first, last, strict=True):
                    keep[s:e] = False
                at = np.flatnonzero(keep) + a
                kept = b" ".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                out[0].append(b - a)
                out[1].append(b - a - len(at))
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept.decode() if with_text else None)
                out[4].append([{"start": int(s), "end": int(e)} for s, e in zip(first, last, strict=True)])
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), _SPANS)
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.record_batch(
                [batch.column(0), *columns], names=["id", "n_words", "n_removed", "kept_sha256", "kept", "spans"]
            )

    return run


def remove_repeated_words(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Each row's id with the words left of its text: id, n_words, n_removed, kept_sha256, kept, spans.

    A word goes if a sequence of `min_words` words that covers it also starts earlier: in a smaller id, or earlier in
    the same text. Sequences are judged on the input and never cross texts; the earliest occurrence stays. Words are
    runs without ASCII white space, compared as they are. `kept` has the words left, joined by a space (null without
    `with_text`); `spans` the removed ranges of words.

    Nulls: a null text has no words. Rows with a null id come before all others, each text being an id of its own. Empty texts give 0, 0. Repeated rows (same id,
    same text) are not copies of each other and give equal results; an id with several texts gets the spans of all of
    them, cut to each text. Extra columns are ignored. An empty table gives an empty result.
    """
    texts = row_keyed(docs, id_col, text_col)
    spans = repeated_word_spans(docs, min_words, rounds, id_col, text_col)
    return with_spans(texts, spans).select(given_id(), "packed", "spans").mapInArrow(_erase(with_text), KEPT_SCHEMA)


def substring_dedup_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The digest columns of `remove_repeated_words`, under doc_id."""
    out = remove_repeated_words(docs, min_words, with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
