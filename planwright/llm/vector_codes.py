"""Product-quantised vectors: codebooks by Yinyang Lloyd rounds in exact integers, vectors as one entry number a part.

A table holds each vector's integers with, for every part, its entry, an upper bound of the distance to it and a lower
bound of the distances to the other entries of each group of entries. A round moves the bounds by how far entries
moved and computes distances only where a group's lower bound no longer clears the upper bound. Bounds are rounded
outwards and only ever rule entries out by a strict inequality; which entry is nearest, ties included, is decided on
integer distances. Sums are formed in each task before 16 entries a part are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.llm.text import unused
from planwright.session import bound_batches, discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Groups of entries with a lower bound each.
GROUPS = 4
#: Integers up to here have squared distances that fit in 64 bits at up to 1,024 components a part; larger ones are Python's.
SMALL = 1 << 25
#: Scaled components from here on cannot have an error of type long; their vectors get no code.
LARGE = float(1 << 62)

Books = list[list[list[int]]]


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(embedding: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def grouped(entries: list[list[int]], groups: int = GROUPS) -> list[int]:
    """A group for each entry: some rounds of k-means over the entries themselves, begun at evenly spaced ones."""
    points = np.array(entries, dtype=np.float64)
    k = min(groups, len(points))
    centres = points[[i * len(points) // k for i in range(k)]]
    for _ in range(5):
        near = ((points[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        for g in range(k):
            if (near == g).any():
                centres[g] = points[near == g].mean(0)
    return near.tolist()


def exact(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each entry, as integers."""
    out = np.empty((len(vectors), len(entries)), dtype=vectors.dtype)
    for j, e in enumerate(entries):
        diff = vectors - e
        out[:, j] = (diff * diff).sum(1) if vectors.shape[1] else 0
    return out


def _root(squared: np.ndarray, towards: float) -> np.ndarray:
    """Square roots moved past the rounding error, up or down."""
    root = np.sqrt(squared.astype(np.float64))
    return np.nextafter(np.nextafter(root, towards), towards)


class Part:
    """One part's codebook as a task sees it, with how far each entry moved since the bounds were kept."""

    def __init__(self, entries: list[list[int]], before: list[list[int]] | None, groups: list[int]):
        wide = max((abs(x) for e in entries for x in e), default=0) > SMALL
        self.entries = np.array(entries, dtype=object if wide else np.int64).reshape(len(entries), -1)
        self.wide, self.groups = wide, np.array(groups)
        self.n_groups = int(self.groups.max()) + 1
        moved = [0] * len(entries) if before is None else [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(entries, before, strict=True)]
        self.drift = np.where(np.array(moved, dtype=np.float64) > 0, _root(np.array(moved, dtype=np.float64), np.inf), 0.0)
        self.group_drift = np.array([self.drift[self.groups == g].max(initial=0.0) for g in range(self.n_groups)])

    def distances(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of `vectors` to the entries `which`."""
        small = not self.wide and (not vectors.size or max(abs(int(vectors.max())), abs(int(vectors.min()))) <= SMALL) and vectors.shape[1] <= 1024
        kind = np.int64 if small else object
        return exact(vectors.astype(kind), self.entries[which].astype(kind))

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper, lower) of vectors seen for the first time, and the distances computed."""
        d = self.distances(vectors, np.arange(len(self.entries)))
        at = d.argmin(1)  # the first of equal ones
        rows = np.arange(len(vectors))
        roots = _root(d, -np.inf)
        roots[rows, at] = np.inf
        lower = np.stack([roots[:, self.groups == g].min(1, initial=np.inf) for g in range(self.n_groups)], 1)
        return at, _root(d[rows, at], np.inf), lower, d.size

    def again(self, vectors: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries moved."""
        at = at.copy()
        upper = np.nextafter(upper + self.drift[at], np.inf)
        lower = np.nextafter(lower - self.group_drift, -np.inf)
        done = 0
        open_ = np.flatnonzero(lower.min(1) <= upper)
        if open_.size:  # a tight upper bound closes most of them
            own = np.empty(len(open_), dtype=object)
            for e in np.unique(at[open_]):
                mine = at[open_] == e
                own[mine] = self.distances(vectors[open_[mine]], np.array([e]))[:, 0]
            done += open_.size
            upper[open_] = _root(own, np.inf)
            left = lower[open_].min(1) <= upper[open_]
            open_, own = open_[left], own[left]
        if not open_.size:
            return at, upper, lower, done
        old, best, best_at = at[open_], own.copy(), at[open_].copy()
        new_lower = lower[open_]
        failing = new_lower <= upper[open_][:, None]
        scanned = []
        for g in range(self.n_groups):
            rows, which = np.flatnonzero(failing[:, g]), np.flatnonzero(self.groups == g)
            if not rows.size or not which.size:
                continue
            d = self.distances(vectors[open_[rows]], which)
            done += d.size
            scanned.append((g, rows, which, d))
            k = d.argmin(1)
            found, found_at = d[np.arange(len(rows)), k], which[k]
            better = (found < best[rows]) | ((found == best[rows]) & (found_at < best_at[rows]))
            best[rows[better]], best_at[rows[better]] = found[better], found_at[better]
        for g, rows, which, d in scanned:
            roots = _root(d, -np.inf)
            roots[which[None] == best_at[rows][:, None]] = np.inf
            new_lower[rows, g] = roots.min(1)
        left_behind = np.flatnonzero(best_at != old)  # the old entry is now one of the others of its group
        g = self.groups[old[left_behind]]
        new_lower[left_behind, g] = np.minimum(new_lower[left_behind, g], _root(own[left_behind], -np.inf))
        lower[open_], at[open_], upper[open_] = new_lower, best_at, _root(best, np.inf)
        return at, upper, lower, done


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _bytes(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, *shape)


def _rows(values: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(values)], pa.binary())


def assign(vectors: DataFrame, books: Books, before: Books | None, groups: list[list[int]], dim: int) -> DataFrame:
    """`vectors` (a column v among others) with at, upper and lower of each part; `before` are the books of the bounds it has."""
    kept, n_groups = [c for c in vectors.columns if c not in ("at", "upper", "lower")], [max(g) + 1 for g in groups]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name in kept] + [f"{c} binary" for c in ("at", "upper", "lower")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(books[p], before and before[p], groups[p]) for p in range(PARTS)]
        width = dim // PARTS
        for batch in batches:
            whole, found = _vectors(batch, dim), []
            if before is not None:
                at, upper = _bytes(batch.column("at"), "u1", PARTS), _bytes(batch.column("upper"), "f4", PARTS)
                lower = np.split(_bytes(batch.column("lower"), "f4", sum(n_groups)), np.cumsum(n_groups)[:-1], axis=1)
            for p, part in enumerate(parts):
                own = whole[:, p * width : (p + 1) * width]
                found.append((part.first(own) if before is None else part.again(own, at[:, p].astype(np.int64), upper[:, p].astype(np.float64), lower[p].astype(np.float64)))[:3])
            # Stored short, so rounded outwards once more.
            up = np.nextafter(np.stack([f[1] for f in found], 1).astype("f4"), np.float32(np.inf))
            low = np.nextafter(np.concatenate([f[2] for f in found], 1).astype("f4"), np.float32(-np.inf))
            state = [_rows(np.stack([f[0] for f in found], 1).astype("u1")), _rows(up), _rows(low)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *state], [*kept, "at", "upper", "lower"])

    return vectors.mapInArrow(run, schema)


def sums(state: DataFrame, n_entries: int, dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to (count, sums): at most PARTS * ENTRIES of them, summed in each task first."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((PARTS, n_entries, width), dtype=object), np.zeros((PARTS, n_entries), dtype=np.int64)
        for batch in batches:
            whole, at = _vectors(batch, dim), _bytes(batch.column("at"), "u1", PARTS)
            # A batch has far fewer than 2^37 rows, so small components add up in 64 bits.
            whole = whole if not whole.size or max(abs(int(whole.max())), abs(int(whole.min()))) <= SMALL else whole.astype(object)
            for p in range(PARTS):
                for e in range(n_entries):
                    mine = at[:, p] == e
                    n[p, e] += int(mine.sum())
                    total[p, e] += whole[mine, p * width : (p + 1) * width].sum(0).astype(object)
        cells = [(p, e) for p in range(PARTS) for e in range(n_entries) if n[p, e]]
        listed = pa.array([[Decimal(int(x)) for x in total[c]] for c in cells], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)] + [pa.array([int(n[c]) for c in cells], pa.int64()), listed], ["part", "entry", "n", "sums"])

    partial = state.select("v", "at").mapInArrow(run, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))
    return {(r.part, r.entry): (r.n, [int(x) for x in r.sums]) for r in added.collect()}


def train(vectors: DataFrame, dim: int, seeds: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """The vectors (a column v of `dim` integers) with their entries, and the books, after `rounds` rounds and a last assignment.

    Each round reads the table the one before it wrote; the books, of fixed size, are all that passes through the driver.
    """
    width = dim // PARTS
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(PARTS)]
    groups = [grouped(b) for b in books]
    state = materialize(assign(vectors, books, None, groups, dim), "vector-codes")
    for _ in range(rounds):
        found = sums(state, len(seeds), dim)
        new = [[[x // found[p, e][0] for x in found[p, e][1]] if (p, e) in found else entry for e, entry in enumerate(books[p])] for p in range(PARTS)]
        moved = materialize(assign(state, new, books, groups, dim), "vector-codes")
        discard(state)
        state, books = moved, new
    return state, books


def coded(state: DataFrame, books: Books, dim: int) -> DataFrame:
    """`state` with its code, two hex digits a part, and the exact error; an error beyond 64 bits is null."""
    kept, width = [c for c in state.columns if c not in ("v", "at", "upper", "lower")], dim // PARTS
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name in kept] + ["code string", "error bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = any(abs(x) > SMALL for b in books for e in b for x in e)
        entries = np.array(books, dtype=object if wide else np.int64)
        for batch in batches:
            whole, at = _vectors(batch, dim), _bytes(batch.column("at"), "u1", PARTS)
            small = not wide and width <= 128 and (not whole.size or max(abs(int(whole.max())), abs(int(whole.min()))) <= SMALL)
            error = np.zeros(len(whole), dtype=np.int64 if small else object)
            for p in range(PARTS):
                diff = whole[:, p * width : (p + 1) * width].astype(error.dtype) - entries[p][at[:, p]].astype(error.dtype)
                error = error + (diff * diff).sum(1)
            errors = [int(e) if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([a.tobytes().hex() for a in at], pa.string()), pa.array(errors, pa.int64())], [*kept, "code", "error"])

    return state.mapInArrow(run, schema)


def codebooks_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of every usable row of `embeddings`, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. Books begin with the 16 smallest
    vec_ids (nulls last, equal ones by their integers), with fewer entries if there are fewer vectors; ties of
    distance go to the lower entry; entries without vectors stay. The vectors' length is that of the smallest vec_id
    with a length that is a multiple of 8; vectors of any other length, and those with a component of 2^50 or more
    (whose error no long holds), come out with a null code and error. Repeated rows count as often as they stand;
    other columns are not read; an empty table gives no rows and no books.
    """
    bound_batches(embeddings.sparkSession)
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", "label", "embedding")
    fits = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall("embedding", lambda x: F.abs(x.cast("double")) * SCALE < LARGE)
    numbers = rows.where(fits).select("vec_id", "label", integers(F.col("embedding")).alias("v"))
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = numbers.orderBy(*order).select("v").head()
    if first is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), []
    dim = len(first.v)
    same = numbers.where(F.size("v") == dim)
    seeds = [list(r.v) for r in same.orderBy(*order).select("v").head(ENTRIES)]
    state, books = train(same, dim, seeds, rounds)
    others = rows.where(~(fits & (F.size("embedding") == dim)))
    return coded(state, books, dim).unionByName(others.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the errors summed over equal labels; rows without a label are one group."""
    total, name = unused("label_error", codes.columns), unused("label", ["label"])
    summed = codes.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias(total))
    return codes.join(summed, F.col("label").eqNullSafe(F.col(name)), "left").drop(name)
