"""Finding passages of test questions in texts with one Aho-Corasick automaton over word windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import flat, slices
from answerloom.session import fresh, quoted, ship, stage

#: Consecutive words of an item that count as an occurrence; a shorter item counts as a whole.
WINDOW = 10
#: Windows in one automaton (about 100 MB); a larger test set is cut into parts, each scanned for in a pass of its own.
MAX_WINDOWS = 100_000
#: Bytes as the comparison sees them: A-Z in lower case, what belongs to no word as a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HIT_SCHEMA = "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split(b" ")


def item_windows(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    """Windows of an item's words; the whole item if it is shorter; none if it has no word."""
    words = [w for w in normal_words((text or "").encode()) if w]
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Automaton:
    """Windows of a part of the test set as an automaton over word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for words in item_windows(text, window):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
                owners.setdefault(key, set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.machine.add_word(key, (len(key), own))
        self.empty = not owners
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, ranges of words inside occurrences (sorted, apart from each other), and the items found."""
        words = [w for w in normal_words(text) if w]
        if self.empty or not words:
            return len(words), [], set()
        number = self.numbers.get
        found: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for last, (size, own) in self.machine.iter(tuple([number(w, 0) for w in words])):
            found |= own
            start = last + 1 - size
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, last + 1))
        return len(words), ranges, found


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges of the given text for ranges of its words."""
    inside = np.frombuffer(text.translate(NORMAL), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return [{"start": int(edges[2 * a]), "end": int(edges[2 * b - 1])} for a, b in ranges]


_BUILT: dict[str, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    """The automaton of the part in use; a worker process keeps one over its tasks. Parts have names of their own."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Automaton(shared.parts, window)
    return _BUILT[shared.id]


class _Part:
    def __init__(self, parts: list):
        self.id, self.parts = uuid.uuid4().hex, parts


def _scan(shared, window: int, hits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(shared.value, window)
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column(1))
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                n, ranges, found = own.scan(text)
                if found or not hits_only:
                    spans = original_spans(text, ranges) if ranges else []
                    rows.append((doc, n, sum(b - a for a, b in ranges), sorted(found), spans))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["id", "n_words", "n_hit", "items", "spans"]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans of several parts: hit words counted anew over the union."""
    for batch in slices(batches, "text"):
        data, offsets = flat(batch.column(1))
        rows = []
        for i, row in enumerate(batch.select(["id", "items", "spans"]).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            inside = np.frombuffer(text.translate(NORMAL), dtype=np.uint8) != 32
            edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
            hit = np.zeros(len(edges) // 2, dtype=bool)
            for span in row["spans"] or []:
                hit[np.searchsorted(edges[::2], span["start"]) : np.searchsorted(edges[1::2], span["end"]) + 1] = True
            turns = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()
            ranges = list(zip(turns[::2], turns[1::2], strict=True))
            spans = original_spans(text, ranges)
            rows.append((row["id"], len(hit), int(hit.sum()), sorted(set(row["items"] or [])), spans))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, max_windows: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in parts of at most `max_windows` words, one part after the other on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), text_col).distinct()
    part: list[tuple[str, str | None]] = []
    size = 0
    for item, text in items.toLocalIterator():
        n = len((text or "").encode().translate(NORMAL).split())
        if part and size + n > max_windows:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += n
    yield part


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """What each text shares with a test set: id, n_words, n_hit, items, spans.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A window is `window`
    consecutive words of an item (question and answer being one text); an item with fewer words is one window. n_hit
    counts the words inside occurrences of any window, `items` has the items they belong to (as text, sorted), and
    `spans` the occurrences as byte ranges of the text as given. Texts are scanned once by an automaton over all
    windows; a test set of more than `max_windows` words is scanned part by part, with the same result.

    Nulls: a null text has no words; null ids stay null; an item without an id counts as item 'null'. Empty texts and
    items hit nothing. Repeated rows give equal rows, repeated items count once. Extra columns are ignored. An empty
    test set hits nothing, an empty table gives an empty result. Any length of text is scanned whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    parts = parts_of(benchmark, item_col, item_text_col, max_windows)
    first, second = next(parts), next(parts, None)
    if second is None:
        return texts.mapInArrow(_scan(context.broadcast(_Part(first)), window, False), HIT_SCHEMA)
    # rows get a number of their own, written down, so that each one's hits come back to it whatever its id is
    numbered = stage(texts.withColumn("row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col("row").alias("id"), "text")
    hits = None
    for part in chain([first, second], parts):
        shared = context.broadcast(_Part(part))
        found = stage(rows.mapInArrow(_scan(shared, window, True), HIT_SCHEMA))
        hits = found if hits is None else hits.unionByName(found)
        shared.unpersist()
    by_row = hits.groupBy(F.col("id").alias("row")).agg(
        F.flatten(F.collect_set("items")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans")
    )
    joined = numbered.join(by_row, "row", "left").select("id", "text", "items", "spans")
    return joined.mapInArrow(_united, HIT_SCHEMA)


def decontamination_digest(hits: DataFrame) -> DataFrame:
    """The digest columns of `benchmark_hits`."""
    return hits.select(
        F.col("id").alias("doc_id"),
        *("n_words", "n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose text shares no window with the test set, with all their columns; rows with a null id stay."""
    hit = fresh("__hit", docs)
    found = stage(hits.where("n_hit > 0").select(F.col("id").alias(hit)).distinct())
    return docs.join(found, quoted(id_col).cast("long") == F.col(hit), "left_anti")
