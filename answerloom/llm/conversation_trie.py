"""The trie of all conversations' beginnings: who shares which first turns, and what sharing them saves.

Conversations become sequences of turn digests, sorted by sequence, so each shard (a stretch of that order) is a piece of
the trie in depth-first order. A shard is encoded as balanced parentheses: a node opens before its subtree and closes
after it. Blocks of the running excess with their minima find the close of every node, ranks of openings number the nodes
of a subtree, ranks of leaf pairs count its leaves, and differences of cumulative arrays give members and savings.

Nodes on the first and the last path of a shard (its spines) may go on in the shards beside it. They leave the shard as
two paths that carry what hangs off each of their nodes, and the same encoding merges the paths of all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.session import ship, stage, unstage

#: Bytes of a turn's digest in a sequence.
DIGEST = 16
#: Turns that a shard holds as arrays, and that the last merge may hold; a longer conversation is a shard of its own.
SHARD_TURNS = 1 << 17
#: Ids in a row that travels where a sequence's members lie in several shards.
CHUNK_IDS = 4096
#: Paths that a shard of a merge takes at least; it leaves two, so each round has far fewer.
MERGED = 32
#: Rows of spine nodes up to which they are broadcast (about 60 bytes each).
BROADCAST_ROWS = 100_000
#: Entries of a block of parentheses.
BLOCK = 64
NO_ID = (1 << 63) - 1
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

NODE, SPINE, ENDS, CHUNK = range(4)
_LISTS = ("chars", "members", "leaves", "saved", "children", "least")
_NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
ROW_SCHEMA = (
    "kind int, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", path binary, parent_path binary, ends_sha256 string, key binary, ids binary, "
    + ", ".join(f"{c} array<long>" for c in _LISTS)
)
_TYPES = {"kind": pa.int32(), "ends_sha256": pa.string(), **{c: pa.int64() for c in _NUMBERS}}
_TYPES |= {c: pa.binary() for c in ("path", "parent_path", "key", "ids")} | {c: pa.list_(pa.int64()) for c in _LISTS}
_ORDER = ("kind", *_NUMBERS, "path", "parent_path", "ends_sha256", "key", "ids", *_LISTS)


class Parentheses:
    """A balanced sequence of +1 and -1 with its excess in blocks of known minimum."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        self.excess = np.cumsum(steps, dtype=np.int64)
        blocks = 1 << max(0, int(-(-len(steps) // BLOCK) - 1).bit_length())
        padded = np.full(blocks * BLOCK, -1, dtype=np.int64)  # below every excess but the last
        padded[: len(steps)] = self.excess
        self.cells = padded.reshape(blocks, BLOCK)
        self.least = [self.cells.min(axis=1)]  # minima of blocks, of pairs of blocks, ...
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Place of the closing of each opening: the first place further on with a smaller excess."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1, dtype=np.int64)
        block, place = at // BLOCK, at % BLOCK
        for j in range(1, BLOCK):  # inside the own block
            open_ = np.flatnonzero((out < 0) & (place < j))
            hit = open_[self.cells[block[open_], j] <= goal[open_]]
            out[hit] = block[hit] * BLOCK + j
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            return out
        node, want, level = block[rest].copy(), goal[rest], np.zeros(len(rest), dtype=np.int64)
        climbing = np.ones(len(rest), dtype=bool)
        for k, least in enumerate(self.least):  # up, until a block to the right holds the goal
            own = np.flatnonzero(climbing)
            right = node[own] + 1
            found = (node[own] % 2 == 0) & (right < len(least))
            found[found] = least[right[found]] <= want[own[found]]
            node[own[found]], level[own[found]] = right[found], k
            climbing[own[found]] = False
            node[own[~found]] //= 2
        for k in range(len(self.least) - 1, 0, -1):  # down, to the leftmost block that holds it
            own = np.flatnonzero(level == k)
            left = node[own] * 2
            here = self.least[k - 1][left] <= want[own]
            node[own], level[own] = np.where(here, left, left + 1), k - 1
        out[rest] = node * BLOCK + np.argmax(self.cells[node] <= want[:, None], axis=1)
        return out


@dataclass
class Paths:
    """Sequences in ascending order, each with what hangs off the nodes on its path: from the root (depth 0) on, the
    code points of a node's last text and the members, leaves, savings, children and the least id not on the path."""

    keys: list[bytes] = field(default_factory=list)
    lists: dict[str, list[np.ndarray]] = field(default_factory=lambda: {c: [] for c in _LISTS})
    ends: list[str | None] = field(default_factory=list)

    def add(self, key: bytes, lists: dict[str, np.ndarray], ends: str | None) -> None:
        self.keys.append(key)
        self.ends.append(ends)
        for c in _LISTS:
            self.lists[c].append(lists[c])


def shared_turns(keys: list[bytes], depth: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before; -1 for the first."""
    data = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum(depth)])
    common = np.minimum(depth[1:], depth[:-1])
    out = np.zeros(len(keys), dtype=np.int64)
    out[0] = -1
    at = np.concatenate([[0], np.cumsum(common)])
    step = np.arange(at[-1]) - np.repeat(at[:-1], common)
    same = (data[np.repeat(first[:-2], common) + step] == data[np.repeat(first[1:-1], common) + step]).all(axis=1)
    some = np.flatnonzero(common)
    if len(some):
        out[1 + some] = np.minimum.reduceat(np.where(same, np.repeat(common, common), step), at[some])
    return out


def _range_least(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least value of each range, from minima of ranges of 1, 2, 4, ... places."""
    out, level, width = values[start].copy(), values, 1
    while True:
        use = np.flatnonzero((size >= width) & (size < 2 * width))
        out[use] = np.minimum(level[start[use]], level[start[use] + size[use] - width])
        if width * 2 > len(values):
            return out
        level, width = np.minimum(level[:-width], level[width:]), width * 2


def _prefix_name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * DIGEST]).digest()[:DIGEST]


def shard_rows(paths: Paths, merged: bool = False, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of a shard: nodes that are complete, and its two spines; all nodes if it is the `last` and only one.

    The members that end at a node of `merged` spines are known elsewhere.
    """
    depth = np.array([len(k) // DIGEST for k in paths.keys], dtype=np.int64)
    shared = shared_turns(paths.keys, depth)
    opened = depth - shared
    n = int(opened.sum())
    closed = np.concatenate([[0], depth[:-1] - shared[1:]])
    counts = np.stack([closed, opened], axis=1).ravel()
    steps = np.repeat(np.tile(np.array([-1, 1], dtype=np.int64), len(depth)), counts)
    parens = Parentheses(np.concatenate([steps, np.full(depth[-1] + 1, -1, dtype=np.int64)]))

    at = np.flatnonzero(parens.steps > 0)
    close = parens.find_close(at)
    size = (close - at + 1) // 2  # nodes of the subtree, by the rank of openings
    upto = np.cumsum(opened)  # nodes opened by the end of each sequence
    owner = np.repeat(np.arange(len(depth)), opened)
    level = np.arange(n) - np.repeat(upto - opened, opened) + np.repeat(shared, opened) + 1
    order = np.argsort(level, kind="stable")
    ranks = level[order] * (n + 1) + order

    def node_of(at_level: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The latest node of a level among the first `before` nodes."""
        return order[np.searchsorted(ranks, at_level * (n + 1) + before) - 1]

    path_of = np.repeat(np.arange(len(depth)), depth + 1)
    path_level = np.arange(len(path_of)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    node = node_of(path_level, upto[path_of])
    given = {c: np.concatenate(paths.lists[c]) for c in _LISTS}
    own = {c: np.zeros(n, dtype=np.int64) for c in _LISTS}
    for c in ("members", "leaves", "saved", "children"):
        np.add.at(own[c], node, given[c])
    own["chars"][node] = given["chars"]
    own["least"][:] = NO_ID
    np.minimum.at(own["least"], node, given["least"])

    parent = np.full(n, -1, dtype=np.int64)
    if n > 1:
        parent[1:] = node_of(level[1:] - 1, np.arange(1, n))
    inside = lambda x: (total := np.concatenate([[0], np.cumsum(x)]))[np.arange(n) + size] - total[:-1]
    n_convs = inside(own["members"])
    n_children = np.bincount(parent[1:], minlength=n) + own["children"]
    least = _range_least(own["least"], np.arange(n), size)

    spine = np.zeros(n, dtype=bool)
    if not last:
        spine[: depth[0] + 1] = True
        spine[close >= len(parens.steps) - depth[-1] - 1] = True
    leaf_pairs = np.append(parens.steps[1:] < 0, True)[at]
    leaves = inside(own["leaves"] + (leaf_pairs & (own["children"] == 0) & ~spine))
    saved = inside(own["saved"] + np.where(spine, 0, (n_convs - 1) * own["chars"]))

    ends = np.full(n, None, dtype=object)
    ends_here = node_of(depth, upto)
    for i, found in zip(ends_here.tolist(), paths.ends, strict=True):
        ends[i] = found or ends[i] or ""
    named = {}  # digest of a node's path, where something is to be joined to it

    def name(i: int) -> bytes:
        if i not in named:
            named[i] = _prefix_name(paths.keys[owner[i]], int(level[i]))
        return named[i]

    done = np.flatnonzero(~spine)
    if len(done):
        up = parent[done]
        loose = (up >= 0) & spine[up]
        known = (up >= 0) & ~spine[up]
        # the empty string: no member ends here; a name: its members are in chunks, or in another shard
        text = [ends[i] for i in done.tolist()]
        path = [name(i) if merged or t == "" else None for i, t in zip(done.tolist(), text, strict=True)]
        yield _batch(
            len(done),
            kind=NODE,
            conv_id=least[done],
            depth=level[done],
            parent_conv_id=pa.array(np.where(known, least[up], 0), mask=~known),
            n_convs=n_convs[done],
            n_children=n_children[done],
            n_leaves=leaves[done],
            saved_tokens=saved[done],
            path=pa.array(path, pa.binary()),
            parent_path=pa.array([name(p) if s else None for p, s in zip(up.tolist(), loose.tolist(), strict=True)], pa.binary()),
            ends_sha256=pa.array([None if p else t or EMPTY_SHA256 for p, t in zip(path, text, strict=True)], pa.string()),
        )
    if last:
        return
    on_spine = np.flatnonzero(spine)
    has_ends = [i for i in on_spine.tolist() if ends[i]]
    if has_ends:
        yield _batch(len(has_ends), kind=ENDS, path=pa.array([name(i) for i in has_ends], pa.binary()), ends_sha256=pa.array([ends[i] for i in has_ends], pa.string()))
    # what hangs off each spine node, without what its children on the spine carry themselves
    hung = {"members": n_convs.copy(), "leaves": leaves.copy(), "saved": saved.copy(), "children": n_children.copy()}
    below = on_spine[parent[on_spine] >= 0]
    for c, x in (("members", n_convs), ("leaves", leaves), ("saved", saved)):
        np.subtract.at(hung[c], parent[below], x[below])
    np.subtract.at(hung["children"], parent[below], 1)
    left = np.arange(depth[0] + 1)
    spines = [(paths.keys[0], left, np.zeros(len(left), dtype=bool))]
    right = node_of(np.arange(depth[-1] + 1), np.full(depth[-1] + 1, n))
    if len(depth) > 1 and right[-1] > depth[0]:
        spines.append((paths.keys[-1], right, right <= depth[0]))
    columns: dict[str, list] = {c: [] for c in _LISTS}
    for _, nodes, told in spines:
        columns["chars"].append(own["chars"][nodes])
        columns["least"].append(least[nodes])
        for c in ("members", "leaves", "saved", "children"):
            columns[c].append(np.where(told, 0, hung[c][nodes]))
    yield _batch(
        len(spines),
        kind=SPINE,
        key=pa.array([k for k, _, _ in spines], pa.binary()),
        **{c: pa.array(v, pa.list_(pa.int64())) for c, v in columns.items()},
    )


def _batch(n: int, kind: int, **columns) -> pa.RecordBatch:
    """Rows of ROW_SCHEMA; columns that aren't given are null."""
    made = {"kind": np.full(n, kind, dtype=np.int32)} | columns
    arrays = []
    for c in _ORDER:
        x = made.get(c)
        arrays.append(pa.nulls(n, _TYPES[c]) if x is None else x if isinstance(x, pa.Array) else pa.array(x, _TYPES[c]))
    return pa.record_batch(arrays, names=list(_ORDER))


def _first_shards(shard_turns: int, chunk_ids: int):
    """Rows (key, conv_id, chars), sorted by key and id, to the rows of their shards.

    Members of a sequence that lies inside one shard are digested here. The first and the last sequence of a partition
    may go on in another one, and one with many members is long: their ids leave in chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, turns = Paths(), 0
        key: bytes | None = None
        waiting: list[int] = []
        chars, n, least, loose = np.zeros(0, dtype=np.int64), 0, NO_ID, True
        out: list[tuple[bytes, int, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                names, firsts, ids = zip(*out, strict=True)
                yield _batch(len(out), kind=CHUNK, path=pa.array(names, pa.binary()), conv_id=pa.array(firsts, pa.int64()), ids=pa.array(ids, pa.binary()))
                out.clear()

        def chunk() -> None:
            if waiting:
                out.append((_prefix_name(key, len(key) // DIGEST), waiting[0], ",".join(map(str, waiting)).encode()))
                waiting.clear()

        def finish() -> None:
            """Add the sequence that ended; '' stands for ends that are known elsewhere."""
            ends = ""
            if loose:
                chunk()
            else:
                ends = hashlib.sha256(",".join(map(str, waiting)).encode()).hexdigest()
                waiting.clear()
            zero = np.zeros(len(chars) + 1, dtype=np.int64)
            members, first = zero.copy(), np.full(len(chars) + 1, NO_ID, dtype=np.int64)
            members[-1], first[-1] = n, least
            known = {"chars": np.append(0, chars), "members": members, "least": first, "leaves": zero, "saved": zero, "children": zero}
            paths.add(key, known, ends)

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (k, conv) in enumerate(zip(keys, ids, strict=True)):
                if k != key:
                    if key is not None:
                        finish()
                        if turns >= shard_turns:
                            yield from shard_rows(paths)
                            paths, turns = Paths(), 0
                    loose = key is None
                    key, chars, n, least = k, values[offsets[i] : offsets[i + 1]], 0, conv
                    turns += len(chars) + 1
                n += 1
                waiting.append(conv)
                if len(waiting) >= chunk_ids:
                    loose = True
                    chunk()
            yield from flush()
        if key is not None:
            loose = True
            finish()
            yield from flush()
            yield from shard_rows(paths)

    return run


def _merge_shards(last: bool, shard_turns: int):
    """Spines, sorted by key, to the rows of their shards; of one shard if this is the last merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, turns = Paths(), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            lists = [(c, batch.column(j + 1)) for j, c in enumerate(_LISTS)]
            lists = {c: (x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for c, x in lists}
            for i, key in enumerate(keys):
                paths.add(key, {c: v[o[i] : o[i + 1]] for c, (o, v) in lists.items()}, "")
                turns += len(key) // DIGEST + 1
                if turns >= shard_turns and len(paths.keys) >= MERGED and not last:
                    yield from shard_rows(paths, merged=True)
                    paths, turns = Paths(), 0
        if paths.keys:
            yield from shard_rows(paths, merged=True, last=last)

    return run


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids (path, conv_id, ids), sorted, to the digest of all ids of each path."""
    path, digest = None, hashlib.sha256()
    for batch in batches:
        paths, shas = [], []
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if p == path:
                digest.update(b",")
            else:
                if path is not None:
                    paths.append(path)
                    shas.append(digest.hexdigest())
                path, digest = p, hashlib.sha256()
            digest.update(ids)
        yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(shas, pa.string())], names=["path", "ends"])
    if path is not None:
        yield pa.record_batch([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], names=["path", "ends"])


def turn_sequences(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Turns of each conversation in order: conv_id, turns (digest, n_chars).

    Turns are ordered by number, null first, and turns of one number by their digest. A null role or text counts as
    empty. Rows without an id belong to no conversation. A repeated row is a turn of its own. Only digests and lengths
    are shuffled, not texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST))
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("n_chars"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.n_chars.alias("n_chars")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def with_shared_heads(sequences: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin like others: the first h turns of each become those of the conversation whose id ends
    its block (id - id % `block`), all if that one has fewer and none if there is no such one; h is crc32(id as text)
    % `heads`. The own turns after the first h follow."""
    own = stage(sequences)
    donors = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(donors, "donor", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = rows.withColumn("h", h)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    begin = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(begin, rest).alias("turns"))


def conversation_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Nodes of the trie of all beginnings: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    `sequences` is as from `turn_sequences`. Each distinct sequence of first turns is a node, from the root (depth 0)
    on; (conv_id, depth) with the smallest member's id names it. Members begin with it, and ends_sha256 digests the
    ids of those that end there. n_leaves and saved_tokens are over the subtree: nodes without children, and the code
    points of a node's last text for each member after the first.

    Each conversation is shuffled once, by ranges of (sequence, id), so that copies of one, or conversations with one
    first turn, may fill many shards. A shard takes about `shard_turns` turns at a time. Spines are merged by further rounds as
    long as they are more than a shard holds.

    Nulls: rows with null turns count as without turns, those with a null id are left out. Conversations without turns
    end at the root. Repeated ids are members each. Extra columns are ignored. An empty table gives an empty result.
    """
    ship(sequences.sparkSession)
    turns = F.coalesce(F.col("turns"), F.slice(F.col("turns"), 1, 0))
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), "")
    rows = sequences.where("conv_id is not null").select(
        F.unhex(F.coalesce(hexes, F.lit(""))).alias("key"),
        "conv_id",
        F.coalesce(F.transform(turns, lambda t: t.n_chars.cast("int")), F.array().cast("array<int>")).alias("chars"),
    )
    # written first, as ranges are drawn from a sample of the rows
    rows = stage(rows)
    sorted_rows = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    tables = [stage(sorted_rows.mapInArrow(_first_shards(shard_turns, chunk_ids), ROW_SCHEMA))]
    unstage(rows)
    while True:
        spines = tables[-1].where(F.col("kind") == SPINE).select("key", *_LISTS)
        size = spines.agg(F.sum(F.size("chars")).alias("turns"), F.count("*").alias("n")).first()
        if not size["n"]:
            break
        if size["turns"] <= shard_turns or size["n"] <= MERGED:
            tables.append(stage(spines.coalesce(1).sortWithinPartitions("key").mapInArrow(_merge_shards(True, shard_turns), ROW_SCHEMA)))
            break
        parts = max(1, min(size["n"] // (4 * MERGED), -(-size["turns"] // shard_turns)))
        ranged = spines.repartitionByRange(parts, "key").sortWithinPartitions("key")
        tables.append(stage(ranged.mapInArrow(_merge_shards(False, shard_turns), ROW_SCHEMA)))
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    chunks = tables[0].where(F.col("kind") == CHUNK).select("path", "conv_id", "ids")
    chunks = chunks.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(_chunk_digests, "path binary, ends string")
    ends = stage(every.where(F.col("kind") == ENDS).select("path", F.col("ends_sha256").alias("ends")).unionByName(chunks))
    nodes = every.where(F.col("kind") == NODE).select(*_NUMBERS, "path", "parent_path", "ends_sha256")
    named = nodes.where("path is not null").join(ends, "path", "left")
    named = stage(named.withColumn("ends_sha256", F.coalesce("ends", "ends_sha256", F.lit(EMPTY_SHA256))).drop("ends"))
    parents = named.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("spine_id"))
    if named.count() <= BROADCAST_ROWS:
        parents = F.broadcast(parents)  # nodes on the spines and those whose members came in chunks
    whole = named.unionByName(nodes.where("path is null")).join(parents, "parent_path", "left")
    return whole.select(
        *("conv_id", "depth"),
        F.coalesce("parent_conv_id", "spine_id").alias("parent_conv_id"),
        *("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"),
    )


def with_last_turns(nodes: DataFrame, conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Nodes of plain conversations (as `turn_sequences` gives them, one row for each turn number) with the columns of
    their last turn; the root has none."""
    from pyspark.sql import Window

    of_conversation = Window.partitionBy(id_col).orderBy(F.col(turn_col).asc_nulls_first())
    turns = conversations.withColumn("depth", F.row_number().over(of_conversation).cast("long")).drop(turn_col)
    return nodes.join(turns.withColumnRenamed(id_col, "conv_id"), ["conv_id", "depth"], "left")
