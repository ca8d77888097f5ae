"""Repeated windows of a corpus, from runs of windows that share an anchor.

A caller chooses an anchor inside each window by the window's content alone, so equal windows have equal anchors at
equal places. Consecutive windows with the same anchor are a run, and a run is one row: for windows of 100 bytes a row
stands for about 38 of them. Runs of one anchor with equal content are copies, the earliest stays. Runs that share an
anchor with other content (at the edges of repeats) are compared window by window: those of an anchor with up to
CROWD contents travel as content and are compared where they meet, those of a more common anchor travel as windows,
so that no task has to hold an unbounded group.

Copies inside a slice of a task are found there, so that a passage that a third of all texts share sends one row for
each slice. Texts travel compressed, and only twice: to the contested runs, and to the spans that go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm.arrays import NULL_ID, SLICE_BYTES, as_long, flat, mix, pair, slices, stretch_names
from answerloom.session import ship, stage

#: Contents of one anchor that one task compares; the windows of more crowded anchors are rows of their own.
CROWD = 10_000
RUN_SCHEMA = "id long, own long, start int, n int, anchor long, content long, copy boolean"
#: A contested run with its text (w2 null), or one window of a crowded anchor by its two names (text null).
CONTEST_SCHEMA = "id long, own long, start int, key long, w2 long, text binary"
SPAN_SCHEMA = "id long, own long, start int, end int"
#: What tells rows apart: the id, and for rows without one (NULL_ID) a negative digest of the text (else 0).
ROW = ["id", "own"]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on."""
    best, done = values, 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[step:], best[:-step])
        done += step
    return best


@dataclass
class Runs:
    """Runs of windows of a slice: first window, number of windows and anchor position of each; a name for the
    `length` units from each position on; and the text of units: cut(texts, starts, ends) -> list of bytes."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    names: np.ndarray
    length: int
    cut: Callable
    keys: np.ndarray | None = None

    def key(self) -> np.ndarray:
        """Name of each run's anchor: as given, or of the units from the anchor on."""
        return self.names[self.anchor] if self.keys is None else self.keys

    def content(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of the units from start to end, each at least `length` long."""
        return stretch_names(self.names, self.length, start, end)


def counts_of(head: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Windows of each run, by the first window of each run and the windows that exist."""
    seen = np.append(0, np.cumsum(valid))
    return np.diff(np.append(seen[np.flatnonzero(head)], seen[-1]))


def minimum_runs(names: np.ndarray, valid: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, count and anchor of runs of windows by their leftmost position of least name among `width` positions from window start + `low` on.

    `valid` tells which windows exist. Consecutive windows keep their anchor until it leaves or a smaller name enters.
    """
    least = sliding_min(names[low:], width)
    valid = valid[: len(least)]
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (names[low : low + len(least) - 1] == least[:-1])
    start = np.flatnonzero(head)
    count = counts_of(head, valid)
    anchor = np.empty(len(start), dtype=np.int64)
    for i in range(0, len(start), 4096):
        around = start[i : i + 4096, None] + low + np.arange(width)
        anchor[i : i + 4096] = around[np.arange(len(around)), np.argmax(names[around] == least[start[i : i + 4096], None], axis=1)]
    return start, count, anchor


def _firsts(keys: list[np.ndarray], *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by key, then by `order`; and whether a row is the first of its key in that order."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    first = np.ones(len(by), dtype=bool)
    if len(by) > 1:
        first[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    return by, first


def _not_repeated(ids: np.ndarray, own: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """False for a row that only repeats the one before: a repeated row of an id is no copy of itself."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = first[1:] | (ids[1:] != ids[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1])
    return new


def run_rows(ids: np.ndarray, own: np.ndarray, offsets: np.ndarray, runs: Runs, width: int) -> pa.RecordBatch:
    """Rows of RUN_SCHEMA for the texts of a slice; those with an earlier copy in the slice are marked."""
    end = runs.start + runs.count - 1 + width
    text = np.searchsorted(offsets, runs.start, side="right") - 1
    rid, row, start, key = ids[text], own[text], runs.start - offsets[text], runs.key()
    content = pair(runs.content(runs.start, end)[0], (runs.anchor - runs.start).astype(np.uint64))
    by, first = _firsts([key, content], rid, row, start)
    new = _not_repeated(rid[by], row[by], start[by], first)
    by, copy = by[new], ~first[new]
    spread = mix(rid[by].astype(np.uint64) ^ row[by].astype(np.uint64) ^ (start[by].astype(np.uint64) << np.uint64(40)))
    return pa.record_batch(
        [
            pa.array(rid[by]),
            pa.array(row[by]),
            pa.array(start[by].astype(np.int32)),
            pa.array(runs.count[by].astype(np.int32)),
            as_long(np.where(copy, spread, key[by])),  # a known copy needs no company
            as_long(content[by]),
            pa.array(copy),
        ],
        names=["id", "own", "start", "n", "anchor", "content", "copy"],
    )


def _windows(owner: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of each window of runs."""
    first = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.repeat(owner, count), first + np.arange(count.sum())


def contest_rows(ids: np.ndarray, own: np.ndarray, column: pa.Array, contested: list, runs_of: Callable, width: int) -> pa.RecordBatch:
    """Rows of CONTEST_SCHEMA for the contested runs of the texts of a slice."""
    offsets, runs = runs_of(column)
    text = np.repeat(np.arange(len(contested)), [len(c) for c in contested])
    rows = [(r["start"], r["n"], r["anchor"], r["crowded"]) for c in contested for r in c]
    start, count, anchor, crowded = (np.array(x) for x in zip(*rows, strict=True))
    count = np.clip(np.minimum(count, np.diff(offsets)[text] - width + 1 - start), 0, None)  # ids may repeat
    owner, at = _windows(text[crowded], start[crowded], count[crowded])
    w1, w2 = runs.content(at + offsets[owner], at + offsets[owner] + width)
    few = np.flatnonzero(~crowded & (count > 0))
    parts = runs.cut(text[few], start[few], start[few] + count[few] - 1 + width)
    out = np.concatenate([owner, text[few]])
    out_start = np.concatenate([at, start[few]]).astype(np.int32)
    key = np.concatenate([w1.view(np.int64), anchor[few]])
    columns = [
        pa.array(ids[out]),
        pa.array(own[out]),
        pa.array(out_start),
        pa.array(key),
        pa.concat_arrays([as_long(w2), pa.nulls(len(few), pa.int64())]),
        pa.concat_arrays([pa.nulls(len(at), pa.binary()), pa.array(parts, pa.binary())]),
    ]
    return pa.record_batch(columns, names=["id", "own", "start", "key", "w2", "text"])


def _joined(ids: np.ndarray, own: np.ndarray, starts: np.ndarray, width: int) -> pa.RecordBatch:
    """Spans of windows; windows that overlap make one."""
    by = np.lexsort((starts, own, ids))
    ids, own, starts = ids[by], own[by], starts[by]
    head = np.ones(len(ids), dtype=bool)
    head[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + width)
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(ids)) - 1 if len(at) else at
    end = (starts[last] + width).astype(np.int32)
    columns = [pa.array(ids[at]), pa.array(own[at]), pa.array(starts[at].astype(np.int32)), pa.array(end)]
    return pa.record_batch(columns, names=["id", "own", "start", "end"])


def _settle_runs(rows: pa.RecordBatch, runs_of: Callable, width: int) -> pa.RecordBatch:
    """Spans of the later windows among runs of whole anchors."""
    ids, own, start, key = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    offsets, runs = runs_of(rows.column(5))
    owner, at = _windows(np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), np.diff(offsets) - width + 1)
    name = pair(runs.content(at + offsets[owner], at + offsets[owner] + width)[0], key[owner].view(np.uint64))
    rid, row, at = ids[owner], own[owner], at + start[owner]
    by, first = _firsts([name], rid, row, at)
    new = _not_repeated(rid[by], row[by], at[by], first) & ~first
    return _joined(rid[by][new], row[by][new], at[by][new], width)


def _settle(runs_of: Callable, width: int):
    """Rows of CONTEST_SCHEMA, sorted by (kind, key, w2, id, own, start), to the spans of the windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        before = None
        for batch in batches:
            kind = np.asarray(batch.column(4).is_valid())
            single = batch.filter(pa.array(kind))
            if single.num_rows:
                ids, own, start, key, w2 = (single.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                head = before if before is not None else (ids[0], own[0], -1, key[0] ^ 1, w2[0])
                same = (key == np.append(head[3], key[:-1])) & (w2 == np.append(head[4], w2[:-1]))
                same_row = same & (ids == np.append(head[0], ids[:-1])) & (own == np.append(head[1], own[:-1]))
                same_row &= start == np.append(head[2], start[:-1])
                # a repeated row of the earliest id is as early as the earliest
                block = np.cumsum(~same)
                lead = np.where(~same, np.arange(len(ids)), 0)
                lead = np.maximum.accumulate(lead)
                as_early = (ids == ids[lead]) & (own == own[lead]) & (start == start[lead]) & (block > 0)
                later = same & ~same_row & ~as_early
                yield _joined(ids[later], own[later], start[later], width)
                before = (ids[-1], own[-1], start[-1], key[-1], w2[-1])
            several = batch.filter(pa.array(~kind))
            if not several.num_rows:
                continue
            table = pa.Table.from_batches([several])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            keys = waiting.column(3).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
            if cut:
                for part in waiting.slice(0, cut).combine_chunks().to_batches():
                    yield _settle_runs(part, runs_of, width)
                waiting = waiting.slice(cut).combine_chunks()
        if waiting is not None and waiting.num_rows:
            for part in waiting.combine_chunks().to_batches():
                yield _settle_runs(part, runs_of, width)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that matter, under fixed names; a null id counts as one id before all others."""
    ship(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))


def row_keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Columns of ROW, the text, and more; rows without an id come before all others, in an order by their texts."""
    ship(docs.sparkSession)
    id_ = F.col(id_col).cast("long")
    own = F.when(id_.isNull(), F.xxhash64(text_col).bitwiseOR(F.lit(NULL_ID))).otherwise(F.lit(0))
    return docs.select(F.coalesce(id_, F.lit(NULL_ID)).alias("id"), own.alias("own"), F.col(text_col).alias("text"), *more)


def given_id() -> Column:
    """The id as it was given, from the columns of ROW: null again where it was null."""
    return F.when(F.col("own") == 0, F.col("id")).alias("id")


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for a shuffle; other columns stay."""
    fields = [T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            data, offsets = flat(batch.column(at))
            zs = [press.compress(data[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield batch.set_column(at, "packed", pa.array(zs, pa.binary()))

    return docs.mapInArrow(run, T.StructType(fields))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about one slice of text each, as expanded, with the text in the place of its packed form."""
    expand = zstandard.ZstdDecompressor()
    for whole in batches:
        at = whole.schema.get_field_index("packed")
        frames = whole.column(at).to_pylist()
        ends = np.cumsum([zstandard.frame_content_size(x) if x else 0 for x in frames])
        i = 0
        while i < len(frames):
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            texts = [expand.decompress(x) if x else b"" for x in frames[i:j]]
            yield whole.slice(i, j - i).set_column(at, "text", pa.array(texts, pa.large_binary()))
            i = j


def repeated_spans(docs: DataFrame, runs_of: Callable[[pa.Array], tuple[np.ndarray, Runs]], width: int) -> DataFrame:
    """Spans of units (id, own, start, end) that windows of `width` units with an earlier equal cover.

    `docs` is as from `row_keyed`. `runs_of(column)` gives the text offsets in units and the runs of a slice.
    """

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, runs = runs_of(batch.column(2))
            if len(runs.start):
                ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                yield run_rows(ids, own, offsets, runs, width)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield contest_rows(ids, own, batch.column(2), batch.column(3).to_pylist(), runs_of, width)

    by_content = Window.partitionBy("anchor", "content").orderBy(*ROW, "start")
    of_anchor = Window.partitionBy("anchor")
    # a row that repeats the earliest is as early as the earliest
    later = F.struct(*ROW, "start") != F.first(F.struct(*ROW, "start")).over(by_content)
    marked = stage(
        docs.mapInArrow(first_pass, RUN_SCHEMA)
        .select(
            *(*ROW, "start", "n", "anchor", "copy"),
            later.alias("later"),
            (F.min("content").over(of_anchor) != F.max("content").over(of_anchor)).alias("contested"),
            (F.count("*").over(of_anchor) > CROWD).alias("crowded"),
        )
        .select(*ROW, "start", "n", "anchor", (F.col("copy") | F.col("later")).alias("copy"), "contested", "crowded")
        .where("copy or contested")
    )
    contested = F.collect_list(F.struct("start", "n", "anchor", "crowded"))
    contests = (
        packed(docs)
        .join(marked.where("not copy").groupBy(*ROW).agg(contested.alias("contested")).hint("shuffle_hash"), ROW)
        .mapInArrow(second_pass, CONTEST_SCHEMA)
        .repartition("key")
        .sortWithinPartitions(F.col("w2").isNull(), "key", "w2", *ROW, "start")
    )
    copies = marked.where("copy").select(*ROW, "start", (F.col("start") + F.col("n") - 1 + width).cast("int").alias("end"))
    return copies.unionByName(contests.mapInArrow(_settle(runs_of, width), SPAN_SCHEMA))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as sorted ranges that neither overlap nor touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), dtype=bool)
    head[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each text, packed, with its spans (null: none)."""
    own = spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return packed(docs).join(own.hint("shuffle_hash"), ROW, "left")
