"""The trie of conversation prefixes, built compressed: sorted conversations, Patricia points, then unary nodes by edge sums.

Every conversation becomes one row: the hashes of its turns in a row (16 bytes a turn) and the words of each. Rows are
range-sorted by those bytes and the id, so copies and conversations with one prefix stand side by side and a group of
copies, however large, spreads over tasks. Each task goes over its rows once with a stack of points: ends (a
conversation stops), branches (two part) and leaves. Aggregates are summed on these points alone; the nodes between
two points have the lower one's members, so they are written out from it with the sums of words along the edge.

A node that reaches over the border of a task is a prefix of the first or of the last row of each task that holds it.
Such nodes, at most two conversations' worth a task, are written as partial sums and added up by their hash; what a
task counts as new although the task before had it is taken off by the length that their border rows share.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.llm.text import SPACED_WORD
from planwright.session import bound_batches, materialize

#: Bytes of a turn's hash.
WIDTH = 16
#: Conversations that share the opening of the first of them.
BLOCK = 20
#: Rows of an output batch, and ids that travel as one piece of an unfinished digest.
ROWS, PIECE = 4096, 8192

_PARTS = "kind string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, part int, place bigint, on_first boolean, on_last boolean, before bigint, first_seq binary, first_words array<bigint>, last_seq binary, ids string"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _PARTS.split(", ")])
EMPTY = hashlib.sha256(b"").hexdigest()


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return F.pmod(F.crc32(F.encode(conv_id.cast("string"), "UTF-8")), F.lit(4)).cast("int")


def sequences(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """(conv_id, seq, words): the hashes of each conversation's turns, end to end, and the words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", role.alias("role"), F.substring(F.sha2(F.encode(marked, "UTF-8"), 256), 1, 2 * WIDTH).alias("h"), F.regexp_count(text, F.lit(SPACED_WORD)).cast("bigint").alias("w"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    if rebuild:
        base = F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))
        heads = own.where(F.pmod("conv_id", F.lit(BLOCK)) == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, 3).alias("head"))
        own = own.withColumns({"base": base, "n": opening(F.col("conv_id"))}).join(heads, "base", "left")
        rest = F.slice("t", F.col("n") + 1, F.greatest(F.size("t"), F.lit(1)))
        own = own.withColumn("t", F.concat(F.when(F.col("head").isNull(), F.slice("t", 1, 0)).otherwise(F.slice("head", 1, F.col("n"))), rest))
    return own.select("conv_id", F.unhex(F.array_join("t.h", "")).alias("seq"), F.col("t.w").alias("words"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that both sequences begin with."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_keys(seq: bytes) -> list[bytes]:
    """A key of each prefix, the empty one included."""
    state, out = hashlib.sha256(b"trie"), []
    for k in range(len(seq) // WIDTH + 1):
        out.append(state.copy().digest()[:WIDTH])
        state.update(seq[k * WIDTH : (k + 1) * WIDTH])
    return out


class Point:
    """An end, branch or leaf: sums over the members met so far; `waiting` are the closed edges below it."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "saved", "ids", "waiting")

    def __init__(self, depth: int):
        self.depth, self.n, self.least, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ids, self.waiting = None, []

    def end(self, conv_id: int) -> None:
        self.n += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        if self.ids is None:
            self.ids = array("q")
        self.ids.append(conv_id)

    def pieces(self) -> Iterator[str]:
        """The ids of the conversations that end here, comma-joined by the piece."""
        for k in range(0, len(self.ids or ()), PIECE):
            yield ",".join(map(str, self.ids[k : k + PIECE]))

    def digest(self) -> str:
        state = hashlib.sha256()
        for k, piece in enumerate(self.pieces()):
            state.update((("," if k else "") + piece).encode())
        return state.hexdigest()


class Builder:
    """Goes over the sorted rows of one task and gathers finished rows in `out`."""

    def __init__(self, part: int):
        self.part, self.out, self.stack = part, [], [Point(0)]
        self.first = self.seq = None
        self.sums, self.first_keys, self.near = [0], [], 0

    def emit(self, **values) -> None:
        self.out.append(values)

    def add(self, conv_id: int, seq: bytes, words: list[int]) -> None:
        shared = 0
        if self.first is None:
            self.first, self.first_keys, self.first_words, self.near = seq, prefix_keys(seq), words, len(seq) // WIDTH
        else:
            shared = shared_turns(self.seq, seq)
            self.close(shared)
            self.near = min(self.near, shared)
        depth = len(seq) // WIDTH
        del self.sums[shared + 1 :]
        for w in words[shared:]:
            self.sums.append(self.sums[-1] + w)
        self.seq = seq
        if depth > self.stack[-1].depth:
            self.stack.append(Point(depth))
        self.stack[-1].end(conv_id)

    def close(self, depth: int) -> None:
        """Takes all points deeper than `depth` off the stack; the deepest that stays is at `depth`."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            self.hang(point, self.stack[-1])

    def hang(self, point: Point, parent: Point) -> None:
        """Adds a finished point to its parent and writes, or keeps for the parent, the edge between them."""
        point.leaves += point.children == 0
        point.saved += (point.n - 1) * (self.sums[point.depth] - self.sums[point.depth - 1])
        top_saved = point.saved + (point.n - 1) * (self.sums[point.depth - 1] - self.sums[parent.depth])
        self.settle(point)
        cut = max(parent.depth, min(self.near, point.depth))  # nodes down to here are prefixes of the first row
        if cut < point.depth:
            edge = (point, cut, self.sums[cut : point.depth + 1])
            if parent.depth <= self.near:
                self.write(edge, None, self.first_keys[cut])
            else:
                parent.waiting.append(edge)
        self.partial(point, parent.depth, cut, self.first_keys, True, False)
        parent.n += point.n
        parent.least = point.least if parent.least is None else min(parent.least, point.least)
        parent.leaves, parent.children, parent.saved = parent.leaves + point.leaves, parent.children + 1, parent.saved + top_saved

    def settle(self, point: Point) -> None:
        """The edges below a point whose members are all known."""
        if point.depth > self.near:
            for edge in point.waiting:
                self.write(edge, point.least, None)
            point.waiting = []

    def write(self, edge: tuple, parent: int | None, parent_key: bytes | None) -> None:
        """The closed nodes of an edge, the lowest first; unary ones differ in depth, children and the sum of words below."""
        point, top, sums = edge
        for depth in range(point.depth, top, -1):
            lowest, above = depth == point.depth, depth == top + 1
            self.emit(
                kind="node", conv_id=point.least, depth=depth, parent_conv_id=parent if above else point.least, parent_key=parent_key if above else None,
                n_convs=point.n, n_children=point.children if lowest else 1, n_leaves=point.leaves,
                saved_tokens=point.saved + (point.n - 1) * (sums[point.depth - 1 - top] - sums[depth - 1 - top]),
                ends_sha256=point.digest() if lowest and point.ids else EMPTY)

    def partial(self, point: Point, above: int, down_to: int, keys: list[bytes], on_first: bool, on_last: bool) -> None:
        """The nodes of an edge, from `above` (not included) down to `down_to`, as this task's share of them."""
        for depth in range(above + 1, down_to + 1):
            lowest = depth == point.depth
            last = max(point.depth - 1, 0)
            self.emit(
                kind="open", conv_id=point.least, depth=depth, n_convs=point.n, n_children=point.children if lowest else 1, n_leaves=point.leaves,
                saved_tokens=point.saved + (point.n - 1) * (self.sums[last] - self.sums[max(depth - 1, 0)]), key=keys[depth], parent_key=keys[depth - 1] if depth else None,
                part=self.part, on_first=on_first, on_last=on_last, before=self.sums[max(depth - 1, 0)])
            if lowest:
                for k, piece in enumerate(point.pieces()):
                    self.emit(kind="ids", key=keys[depth], part=self.part, place=k, ids=piece)

    def finish(self) -> None:
        """What is still on the stack are the prefixes of the last row."""
        if self.first is None:
            return
        keys, near = prefix_keys(self.seq), self.near
        while True:
            point = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            point.leaves += point.children == 0
            if point.depth:
                point.saved += (point.n - 1) * (self.sums[point.depth] - self.sums[point.depth - 1])
            for edge in point.waiting:
                self.write(edge, None, keys[point.depth])
            start = above.depth if above else -1
            self.partial(point, start, min(near, point.depth), keys, True, True)
            self.partial(point, max(start, near), point.depth, keys, False, True)
            if above is None:
                break
            top_saved = point.saved + (point.n - 1) * (self.sums[point.depth - 1] - self.sums[above.depth])
            above.n += point.n
            above.least = point.least if above.least is None else min(above.least, point.least)
            above.leaves, above.children, above.saved = above.leaves + point.leaves, above.children + 1, above.saved + top_saved
        self.emit(kind="border", part=self.part, first_seq=self.first, first_words=self.first_words, last_seq=self.seq)


def _packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _SCHEMA.field(c).type) for c in _NAMES], schema=_SCHEMA)


def parts(ordered: DataFrame) -> DataFrame:
    """Closed nodes, shares of open ones, pieces of their ids and the border rows, of sorted sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(TaskContext.get().partitionId())
        for batch in batches:
            for conv_id, seq, words in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "seq", "words")], strict=True):
                builder.add(conv_id, seq, words)
                while len(builder.out) >= ROWS:
                    yield _packed(builder.out[:ROWS])
                    del builder.out[:ROWS]
        builder.finish()
        for k in range(0, len(builder.out), ROWS):
            yield _packed(builder.out[k : k + ROWS])

    return ordered.mapInArrow(run, _PARTS)


def borders(rows: DataFrame) -> DataFrame:
    """(part, shared, shared_words, goes_on) of each task: the turns its first row shares with the row before it, their
    words, and whether the row after its last one begins with all of that. One row of two sequences a task."""
    turned = rows.where("kind = 'border'").select("part", "first_seq", "first_words", "last_seq", F.lag("last_seq").over(Window.orderBy("part")).alias("prior"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, first, words, last, prior in zip(*[batch.column(c).to_pylist() for c in ("part", "first_seq", "first_words", "last_seq", "prior")], strict=True):
                shared = -1 if prior is None else shared_turns(prior, first)
                out.append((part, shared, sum(words[: max(shared, 0)]), len(last) // WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["part", "shared", "shared_words", "length"])

    met = turned.mapInArrow(run, "part bigint, shared bigint, shared_words bigint, length bigint")
    goes_on = F.coalesce(F.lead("shared").over(Window.orderBy("part")) >= F.col("length"), F.lit(False))
    return met.select(F.col("part").alias("_part"), "shared", "shared_words", goes_on.alias("goes_on"))


def digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest over the pieces of each node in order. They stream; none is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
        if key is not None:
            out.append((key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["key", "ends_sha256"])

    ordered = pieces.select("key", "part", "place", "ids").repartition("key").sortWithinPartitions("key", "part", "place")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per distinct prefix.

    Conversations are rebuilt first (their opening turns come from the first conversation of their block of 20) unless
    `rebuild` is False. conv_id is the smallest member of a node, parent_conv_id that of the node above. Defined
    results: a null role or text counts as empty; a null turn comes first; turns with equal numbers stand in order of
    role and then of their hash, and repeated rows are turns of their own; rows without a conv_id belong to no
    conversation; blocks of negative ids begin below them; other columns are not read; an empty table gives no rows,
    not even a root. One conversation's hashes (16 bytes a turn) are one row; texts are never gathered.
    """
    bound_batches(conversations.sparkSession)
    ordered = sequences(conversations, rebuild).repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = materialize(parts(ordered), "trie")
    shares = rows.where("kind = 'open'").join(borders(rows), F.col("part") == F.col("_part"))
    deeper = F.col("on_first") & (F.col("shared") >= F.col("depth"))
    children = F.col("n_children") - F.when(F.col("on_first") & (F.col("shared") > F.col("depth")), 1).otherwise(0)
    leaves = F.col("n_leaves") - F.when(F.col("on_last") & F.col("goes_on"), 1).otherwise(0)
    saved = F.col("saved_tokens") + F.when(deeper, F.col("shared_words") - F.col("before")).otherwise(0)
    whole = shares.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"),
        F.sum(children).alias("n_children"), F.sum(leaves).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    whole = materialize(whole.join(digests(rows.where("kind = 'ids'")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-open")
    above = whole.select(F.col("key").alias("_above"), F.col("conv_id").alias("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = rows.where("kind = 'node'")
    inner = nodes.where(F.col("parent_key").isNull()).select(*columns)
    hung = nodes.where(F.col("parent_key").isNotNull()).join(above, F.col("parent_key") == F.col("_above")).withColumn("parent_conv_id", F.col("parent")).select(*columns)
    opened = whole.join(above, F.col("parent_key") == F.col("_above"), "left").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    return inner.unionByName(hung).unionByName(opened)
