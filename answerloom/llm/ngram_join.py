"""Near-duplicate groups by an exact Jaccard join of word shingles over an index of count vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.arrays import NULL_ID, SLICE_BYTES, as_long, mix, slices, window_names, words
from answerloom.llm.components import connected_components
from answerloom.llm.repeats import keyed, packed
from answerloom.session import fresh, quoted, stage, stage_buckets, unstage

#: Shingle length and Jaccard threshold in percent.
SHINGLE, PERCENT = 3, 90
#: Groups of a coordinate block in the index, and of the folded vector that bounds an overlap.
BLOCK_GROUPS, FOLDED = 1 << 32, 256
#: Points of one leaf of the index; a larger bucket is cut into leaves that are compared pair by pair.
LEAF = 2048
#: Bits of a cell's name. Cells that share a name by chance only bring together points that then are compared.
CELL_BITS = 48
POINT_SCHEMA = "id long, n int, f1 long, f2 long, vector binary"
CELL_SCHEMA = "f1 long, cell long"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text, sorted in it, and the offsets of the texts.

    Shorter texts have their whole sequence of words as the only shingle; texts without words have none.
    """
    _, _, _, names, offsets = words(column, lower=True)
    counts = np.diff(offsets)
    grams = window_names(names, k)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    at = np.concatenate([np.arange(a, a + max(n - k + 1, 0)) for a, n in zip(offsets[:-1], counts, strict=True)] or [np.zeros(0)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    rest = [window_names(names[offsets[i] : offsets[i + 1]], counts[i])[0] + np.uint64(counts[i]) for i in short]
    value = np.concatenate([grams[at.astype(np.int64)], np.array(rest, dtype=np.uint64)])
    text = np.concatenate([text, short]).astype(np.int64)
    by = np.lexsort((value, text))
    value, text = value[by], text[by]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


class SizeClasses:
    """Classes of set sizes such that linked sets lie in the same class or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]

    def of(self, n: np.ndarray) -> np.ndarray:
        while self.bounds[-1] <= n.max(initial=1):
            self.bounds.append(self.bounds[-1] * 100 // self.percent + 1)
        return np.searchsorted(np.array(self.bounds), n, side="right") - 1

    def blocks(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of coordinates for pairs whose smaller set is in class c, and how many of them are to spare.

        The differences of two linked sets touch some blocks at most; one more is equal in both. The spare blocks
        are about as many as may be empty by chance, so that empty blocks need no entry in general.
        """
        bounds = np.array([*self.bounds, self.bounds[-1] * 100 // self.percent + 1])
        largest = bounds[1:] - 1
        touched = (largest + largest * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        spare = np.full(len(touched), 2)
        for _ in range(8):
            count = touched + 1 + spare
            empty = count * np.exp(-bounds[:-1] / count)
            spare = np.minimum(np.ceil(empty + 4 * np.sqrt(empty) + 2), touched + 2).astype(np.int64)
        return np.where(touched > 0, touched + 1 + spare, 0)[c], spare[c]


def index_cells(value: np.ndarray, offsets: np.ndarray, classes: SizeClasses) -> list[np.ndarray]:
    """Cells of the index that the point of each set lies in.

    A set is a point: shingles are hashed into groups, its coordinates are their counts. By the sum of coordinate
    minima two linked points differ by at most d units, so of d + 1 blocks of coordinates one at least is equal in
    both. A cell is a block with its coordinates. A set enters the cells of its own class and, for smaller partners,
    of the class below. There are some blocks to spare; a set with no more empty ones than that leaves those out.
    """
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    own = classes.of(np.maximum(n, 1))
    out = []
    for c in (own, own - 1):
        blocks, spare = classes.blocks(np.maximum(c, 0))
        blocks = np.where((c >= 0) & (n > 0), blocks, 0)
        base = np.append(0, np.cumsum(blocks))
        inside = blocks[text] > 0
        t, v = text[inside], value[inside]
        block = base[t] + ((v >> np.uint64(32)) % blocks[t].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(sums, block, mix((v & np.uint64(BLOCK_GROUPS - 1)) + np.uint64(1)))
        empty = np.bincount(block, minlength=base[-1]) == 0
        owner = np.repeat(np.arange(len(n)), blocks)
        many = np.bincount(owner[empty], minlength=len(n)) > spare
        number = np.arange(base[-1]) - base[owner]
        cell = mix(sums + mix((c[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
        keep = ~empty | many[owner]
        out.append((owner[keep], cell[keep]))
    owner = np.concatenate([o for o, _ in out])
    cell = np.concatenate([c for _, c in out]) >> np.uint64(64 - CELL_BITS)
    by = np.argsort(owner, kind="stable")
    return np.split(cell[by], np.searchsorted(owner[by], np.arange(1, len(n))))


def folded_vectors(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of FOLDED groups of shingles for each set."""
    n = np.diff(offsets)
    at = np.repeat(np.arange(len(n)), n) * FOLDED + (value >> np.uint64(56)).astype(np.int64) % FOLDED
    return np.bincount(at, minlength=len(n) * FOLDED).reshape(len(n), FOLDED).astype(np.uint32)


def vector_bytes(vectors: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest numbers that hold its counts."""
    return [v.astype(np.min_scalar_type(v.max())).tobytes() for v in vectors]


def vectors_of(column: pa.Array) -> np.ndarray:
    """The vectors again, one row for each."""
    raw = [np.frombuffer(x, dtype=f"u{len(x) // FOLDED}") for x in column.to_pylist()]
    return np.array(raw, dtype=np.uint32).reshape(-1, FOLDED)


def _fingerprints(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of each set."""
    n = np.diff(offsets)
    at = np.repeat(np.arange(len(n)), n)
    f1, f2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    np.add.at(f1, at, mix(value))
    np.add.at(f2, at, mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    return f1, f2


def _points(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, offsets = shingle_sets(batch.column(1), k)
            columns = [batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), *map(as_long, _fingerprints(value, offsets))]
            vectors = pa.array(vector_bytes(folded_vectors(value, offsets)), pa.binary())
            yield pa.record_batch([*columns, vectors], names=["id", "n", "f1", "f2", "vector"])

    return run


def _cells(k: int, percent: int):
    """Rows of CELL_SCHEMA. They take more bytes than the texts, so they go to their shuffle without being written before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in slices(batches, "text"):
            value, offsets = shingle_sets(batch.column(1), k)
            f1, f2 = _fingerprints(value, offsets)
            cells = index_cells(value, offsets, classes)
            seen: set[tuple[int, int]] = set()
            for i, key in enumerate(zip(f1.tolist(), f2.tolist(), strict=True)):
                if key in seen:
                    cells[i] = cells[i][:0]  # the same point once for each slice
                seen.add(key)
            owner = np.repeat(f1, [len(c) for c in cells])
            yield pa.record_batch([as_long(owner), as_long(np.concatenate([*cells, np.zeros(0, np.uint64)]))], names=["f1", "cell"])

    return run


def _leaf_pairs(percent: int, best_only: bool):
    """Pairs of a leaf whose overlap bound reaches the threshold, between different components.

    Rows (lead, low, high, tile, node, component, n, vector) come sorted by (lead, low, high). With `best_only`, each
    point gives its best partner only.
    """

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        vectors, n, component, tile = rows["vector"], rows["n"], rows["component"], rows["tile"]
        across = rows["low"][0] != rows["high"][0]
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for i in range(len(n)):
            if across:
                if tile[i] != rows["low"][0]:
                    continue
                others = np.flatnonzero((tile == rows["high"][0]) & (component != component[i]))
            else:
                others = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
            if not len(others):
                continue
            bound = np.minimum(vectors[others], vectors[i]).sum(axis=1, dtype=np.int64)
            spare = (100 + percent) * bound - percent * (n[others] + n[i])
            if best_only:
                others, spare = others[[np.argmax(spare)]], spare[[np.argmax(spare)]]
            others = others[spare >= 0]
            left.append(np.full(len(others), rows["node"][i]))
            right.append(rows["node"][others])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([*left, none]), np.concatenate([*right, none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            plain = {c: table.column(c).to_numpy() for c in ("lead", "low", "high", "tile", "node", "component", "n")}
            plain["n"] = plain["n"].astype(np.int64)
            plain["vector"] = vectors_of(table.column("vector"))
            new = np.ones(len(table), dtype=bool)
            new[1:] = np.any([plain[c][1:] != plain[c][:-1] for c in ("lead", "low", "high")], axis=0)
            for rows in np.split(np.arange(len(table)), np.flatnonzero(new)[1:]):
                a, b = pairs({c: v[rows] for c, v in plain.items()})
                if len(a):
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
            keys = [waiting.column(c).to_numpy() for c in ("lead", "low", "high")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from settle(waiting.slice(0, cut))
                waiting = waiting.slice(cut)
        if waiting is not None and len(waiting):
            yield from settle(waiting)

    return run


def _verified(k: int, percent: int):
    """Of rows (a, b, and the packed texts of both) the pairs whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (2, 3))
            ends = np.cumsum([zstandard.frame_content_size(x) + zstandard.frame_content_size(y) for x, y in zip(left, right, strict=True)])
            i = 0
            while i < len(left):  # about one slice of text at once, as expanded
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                place: dict[bytes, int] = {}  # a text that several pairs have is cut into shingles once
                at = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for x, y in zip(left[i:j], right[i:j], strict=True)]
                texts = pa.array([expand.decompress(x) for x in place], pa.large_binary())
                value, offsets = shingle_sets(texts, k)
                sets = np.split(value, offsets[1:-1])
                shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in at])
                both = np.array([len(sets[x]) + len(sets[y]) for x, y in at])
                yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(shared * (100 + percent) >= both * percent))
                i = j

    return run


def _linked(pairs: DataFrame, kept: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the threshold. The texts lie in buckets of their ids, so only pairs move."""
    a = kept.select(F.col("id").alias("a"), F.col("packed").alias("ta"))
    b = kept.select(F.col("id").alias("b"), F.col("packed").alias("tb"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(_verified(shingle, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, representative (smallest id with the same set), component_id.

    A document's set has its distinct shingles of `shingle` words (ASCII white space parts words, A-Z in lower case);
    with fewer words the whole sequence is the only one. Two documents link when their Jaccard coefficient is at
    least `percent` / 100; component_id is the smallest id reachable by links, the own one included.

    Equal sets are one point of the index. Points meet in cells (`index_cells`), which loses no link. Similar points
    share many cells, so cells with the same smallest point (the lead) are compared together: a pair is looked at once
    for each lead, not for each cell. Points are compared by the sum of their coordinate minima, a bound on the overlap,
    and what passes is verified on whole sets: first each point with its leads and with the next point of a lead; then,
    of the cells that still hold several components, each point with its best partner; at last all pairs between
    components. Points of one component need no comparison, so a group of many copies costs a few comparisons for
    each, not one for each two.

    Nulls: a null text has no words; a null id counts as one id before all others. Documents without words link with
    nothing, whatever their number. Repeated rows are linked and give equal rows; an id with several texts joins what
    any of them joins. Extra columns are ignored. An empty table gives an empty result. Texts are read whole.
    """
    texts = keyed(docs, id_col, text_col)
    points = stage(texts.mapInArrow(_points(shingle), POINT_SCHEMA))
    same_set = ["n", "f1", "f2"]
    named = points.where("n > 0").groupBy(*same_set).agg(F.min("id").alias("representative"))
    named = stage(named)
    in_cell = Window.partitionBy("cell")
    by_cell = in_cell.orderBy("f1")
    entries = texts.mapInArrow(_cells(shingle, percent), CELL_SCHEMA)
    shared = (
        entries.withColumn("again", F.coalesce(F.lag("f1").over(by_cell) == F.col("f1"), F.lit(False)))
        .withColumn("several", F.min("f1").over(in_cell) != F.max("f1").over(in_cell))
        .where("several and not again")
        .select("cell", "f1")
    )
    nodes = named.select("f1", F.col("representative").alias("node"))
    cells = stage_buckets(shared.join(nodes, "f1").select("cell", "node").repartition("cell").distinct(), "cell")
    ids = stage(cells.select(F.col("node").alias("id")).distinct())
    kept = stage_buckets(packed(texts).join(ids, "id", "left_semi"), "id")
    of_ids = points.where("n > 0").select("id", "n", "vector").join(ids, "id", "left_semi")
    vectors = stage(of_ids.select(F.col("id").alias("node"), "n", "vector").distinct())
    unstage(ids)

    of_cell = Window.partitionBy("cell")
    by_lead = Window.partitionBy("lead").orderBy("node")
    first = cells.select(F.min("node").over(of_cell).alias("lead"), "node").distinct()
    first = first.select("lead", "node", F.lag("node").over(by_lead).alias("before"))
    first = first.select(F.explode(F.array_distinct(F.array("lead", "before"))).alias("a"), F.col("node").alias("b"))
    first = first.where("a < b").distinct()
    links = stage(_linked(_bounded(first, vectors, percent), kept, shingle, percent))
    for best_only in (True, False):
        component = connected_components(links)
        rows = cells.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.withColumn("mixed", F.min("component").over(of_cell) != F.max("component").over(of_cell))
        rows = rows.withColumn("lead", F.min("node").over(of_cell)).where("mixed").select("lead", "node", "component").distinct()
        of_lead = Window.partitionBy("lead")
        rows = rows.withColumn("size", F.count("*").over(of_lead))
        place = F.row_number().over(of_lead.orderBy("component", "node")) - 1
        rows = rows.withColumn("tile", F.floor(place / LEAF).cast("int"))
        last = F.floor((F.col("size") - 1) / LEAF).cast("int")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        leaves = (
            rows.select("lead", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "component")
            .join(vectors, "node")
            .repartition("lead", "low", "high")
            .sortWithinPartitions("lead", "low", "high")
        )
        more = leaves.mapInArrow(_leaf_pairs(percent, best_only), "a long, b long").distinct()
        former, links = links, stage(links.unionByName(_linked(more, kept, shingle, percent)))
        unstage(former, component)
    unstage(cells, kept, vectors)
    component = connected_components(links).withColumnRenamed("node", "representative")
    unstage(links)
    plain = points.select("id", *same_set).join(named, same_set, "left")
    return plain.join(component, "representative", "left").select(
        "id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("representative", "id").alias("representative"),
        F.coalesce("component", "representative", "id").alias("component_id"),
    )


def _bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes, and whose sums of coordinate minima, let them link; only their sets are looked at."""
    a = vectors.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    b = vectors.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            va, vb = (vectors_of(batch.column(i)) for i in (4, 5))
            shared = np.minimum(va, vb).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * shared >= percent * (na + nb)))

    rows = pairs.join(a, "a").join(b, "b").where(close).select("a", "b", "na", "nb", "va", "vb")
    return rows.mapInArrow(within, "a long, b long")


def join_digest(groups: DataFrame) -> DataFrame:
    """The digest columns of `near_duplicates`."""
    restore = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return groups.select(restore("id").alias("doc_id"), "n_shingles", restore("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is the smallest of its component, with all their columns; rows with a null id stay."""
    name = fresh("__gone", docs)
    gone = stage(groups.where("id <> component_id").select(F.col("id").alias(name)).distinct())
    return docs.join(gone, quoted(id_col).cast("long") == F.col(name), "left_anti")
