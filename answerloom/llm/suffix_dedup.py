"""Removal of repeated substrings by prefix doubling over text positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm.arrays import BYTE_NAMES, flat, pair
from answerloom.llm.repeats import Runs, given_id, merged, minimum_runs, repeated_spans, row_keyed, unpacked, with_spans
from answerloom.session import quoted

#: Length in bytes from which a repeated string goes.
MIN_BYTES = 100


def doubled_names(units: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of `length` units from each position on, by prefix doubling.

    The name of length 2h at p is the name of the pair of names of length h at p and at p + h; the last step takes
    the offset that is left. Positions whose string would pass the end get none.
    """
    names, done = units, 1
    while done < length:
        step = min(done, length - done)
        names = pair(names[:-step], names[step:])
        done += step
    return names


def doubling_runs(min_bytes: int):
    """Anchor of the window at p: of its strings of a quarter of the width, the leftmost with the least name."""
    quarter = max(1, min_bytes // 4)

    def runs_of(column: pa.Array) -> tuple[np.ndarray, Runs]:
        data, offsets = flat(column)

        def cut(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
            at = offsets[texts]
            return [data[a:b].tobytes() for a, b in zip(at + starts, at + ends, strict=True)]

        if len(data) < min_bytes:
            none = np.zeros(0, dtype=np.int64)
            return offsets, Runs(none, none, none, BYTE_NAMES[data], quarter, cut)
        names = doubled_names(BYTE_NAMES[data], quarter)
        left = np.minimum(np.diff(offsets), min_bytes - 1)
        valid = np.ones(len(data), dtype=bool)
        for end, size in zip(offsets[1:], left, strict=True):
            valid[end - size : end] = False
        return offsets, Runs(*minimum_runs(names, valid, 0, min_bytes - quarter + 1), names, quarter, cut)

    return runs_of


def repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans (id, own, start, end) covered by strings of `min_bytes` that also start earlier in the corpus.

    Prefix doubling ranks positions by ever longer prefixes. One row for each byte position doesn't fit any disk
    budget, so the ranks of a quarter of the length choose, inside each window, the position that stands for it (the
    one with the least rank), and only such positions are sorted: first by that rank, then by the rank of the run of
    windows around them. Positions whose rank is unique drop out after the first sort, those with equal runs are
    settled by it, and only the rest is paired up to the full length and sorted again.
    """
    return repeated_spans(row_keyed(docs, id_col, text_col), doubling_runs(min_bytes), min_bytes)


KEPT_SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"


def _own_spans(own: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of a text's spans, inside the text."""
    if not own.is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = own.values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    ends = own.values.field("end").to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = merged(np.minimum(starts, size), np.minimum(ends, size))
    return starts[ends > starts], ends[ends > starts]


def _left(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What lies between the spans."""
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _erase(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            rows = []
            ids = batch.column(0).to_pylist()
            data, offsets = flat(batch.column(1))
            for i, own in enumerate(batch.column(2)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                starts, ends = _own_spans(own, len(raw))
                kept = b"".join(_left(raw, starts, ends))
                spans = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                row = (ids[i], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept if with_text else None, spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS]
_NAMES = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]


def remove_repeats(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Each row's id with what is left of its text: id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    A byte goes if a string of `min_bytes` bytes that covers it also starts earlier: in a smaller id, or earlier in
    the same text. Strings are judged on the input and never cross texts. The earliest occurrence stays. `kept` may
    cut a character in two, so it is binary; it is null without `with_text`.

    Nulls: a null text is empty. Rows with a null id come before all others, each text being an id of its own. Empty texts give 0, 0, 0. Repeated rows (same id,
    same text) are not copies of each other and give equal results; an id with several texts gets the spans of all of
    them, cut to each text. Extra columns are ignored. An empty table gives an empty result.
    """
    texts = row_keyed(docs, id_col, text_col)
    spans = repeats(docs, min_bytes, id_col, text_col)
    return with_spans(texts, spans).select(given_id(), "packed", "spans").mapInArrow(_erase(with_text), KEPT_SCHEMA)


def suffix_dedup_digest(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The digest columns of `remove_repeats`, under doc_id."""
    out = remove_repeats(docs, min_bytes, with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with what is left of their text, and all their other columns; rows of which nothing is left go.

    A character that a removal cuts in two goes whole. A text that was null or empty before stays as it is.
    """
    rest = F.struct(*[quoted(c) for c in docs.columns if c != text_col]).alias("rest")
    texts = row_keyed(docs, id_col, text_col, rest)
    spans = repeats(docs, min_bytes, id_col, text_col)
    schema = T.StructType([T.StructField("kept", T.StringType()), T.StructField("gone", T.BooleanType()), texts.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            kept, gone = [], []
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            for i, own in enumerate(batch.column(batch.schema.get_field_index("spans"))):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                left = b"".join(_left(raw, *_own_spans(own, len(raw))))
                kept.append(left.decode(errors="ignore"))
                gone.append(bool(raw) and not kept[-1])
            at = batch.schema.get_field_index("rest")
            yield pa.record_batch([pa.array(kept), pa.array(gone), batch.column(at)], names=["kept", "gone", "rest"])

    left = with_spans(texts, spans).mapInArrow(run, schema).where("not gone")
    return left.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
