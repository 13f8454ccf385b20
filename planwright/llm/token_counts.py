"""Edit-aware token counts: a segment tree of pre-token counts per document, re-encoded only where edits touch."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in a leaf when a tree is built.
LEAF = 64
#: Characters before an edit that can decide how text before it splits: a match looks at most this far past its end.
CONTEXT = 4
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 300_000

TREE = "leaf_chars array<int>, leaf_tokens array<int>, tree array<bigint>"


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


class Counter:
    """Splits text into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str):
        self.encode = _encoder(path, pattern).encode_ordinary
        self.pattern, self.known = regex.compile(pattern), {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n

    def leaves(self, pieces: list[str], size: int = LEAF) -> tuple[list[int], list[int]]:
        if not pieces:
            return [0], [0]
        starts = np.arange(0, len(pieces), size)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
        tokens = np.add.reduceat(np.fromiter(map(self.count, pieces), np.int64, len(pieces)), starts)
        return chars.tolist(), tokens.tolist()


def build(tokens: list[int]) -> list[int]:
    """Sums of a binary tree over the leaves: node k has children 2k and 2k + 1, leaves begin at len(tokens)."""
    n = len(tokens)
    tree = [0] * n + list(tokens)
    for k in range(n - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    tree[0] = sum(tokens) if n == 1 else tree[1]
    return tree


def apply_edit(counter: Counter, text: str, chars: list[int], tokens: list[int], tree: list[int], start: int, stop: int, new: str):
    """The text, leaves and tree after text[start:stop] became `new`, and the characters encoded for it.

    Encoding resumes at the last leaf that ends CONTEXT characters before the edit, and ends at the first old
    leaf border after it that is also a border of the new split: matching looks only ahead, so from there on
    nothing changes. The leaves between keep their number where they fit, and only their ancestors' sums change.
    """
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    after, delta = text[:start] + new + text[stop:], len(new) - (stop - start)
    ends = np.cumsum(chars)
    first = int(np.searchsorted(ends, start - CONTEXT, side="right"))
    first = min(first, len(chars) - 1)
    begin = int(ends[first - 1]) if first else 0
    borders = {int(e) + delta: k + 1 for k, e in enumerate(ends) if e >= stop}
    pieces, at, last = [], begin, len(chars)
    for match in counter.pattern.finditer(after, begin):
        if match.start() >= start + len(new) and match.start() in borders:
            last = borders[match.start()]
            break
        pieces.append(match.group())
        at = match.end()
    slots = last - first
    per_slot = max(1, -(-len(pieces) // max(1, slots)))
    new_chars, new_tokens = counter.leaves(pieces, per_slot)
    if slots and per_slot <= 2 * LEAF and len(new_chars) <= slots:
        pad = slots - len(new_chars)
        chars = chars[:first] + new_chars + [0] * pad + chars[last:]
        tokens = tokens[:first] + new_tokens + [0] * pad + tokens[last:]
        tree, n = list(tree), len(tokens)
        touched = set()
        for k in range(first, last):
            tree[n + k] = tokens[k]
            touched.add((n + k) // 2)
        while touched - {0}:
            for k in touched - {0}:
                tree[k] = tree[2 * k] + tree[2 * k + 1]
            touched = {k // 2 for k in touched - {0}}
        tree[0] = tree[1]
    else:
        new_chars, new_tokens = counter.leaves(pieces)
        chars, tokens = chars[:first] + new_chars + chars[last:], tokens[:first] + new_tokens + tokens[last:]
        tree = build(tokens)
    return after, chars, tokens, tree, at - begin


def with_trees(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, tree, n_tokens) of `docs`; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            leaves = [counter.leaves(counter.pattern.findall(t)) for t in texts]
            trees = [build(t) for _, t in leaves]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([c for c, _ in leaves], pa.list_(pa.int32())),
                 pa.array([t for _, t in leaves], pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int64())), pa.array([t[0] for t in trees], pa.int64())],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "tree", "n_tokens"])

    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, text string, {TREE}, n_tokens bigint")


def recount(trees: DataFrame, edits: DataFrame | None, vocabulary: str, pattern: str) -> DataFrame:
    """Counts after edits, from the stored trees.

    `edits` has (doc_id, seq, start, stop, new): text[start:stop], in code points of the text as it then is,
    becomes `new`, in order of seq; places past the end are cut to it, null places count as 0 and a null `new`
    as empty. With edits None, `trees` brings them itself in a column edits. Returns the columns of with_trees()
    after the edits, with n_encoded, the characters that were encoded again. Documents without edits keep their
    counts; edits of unknown documents do nothing; an empty table of trees gives no rows.
    """
    if edits is not None:
        listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
        listed = listed.withColumnRenamed("doc_id", "_id")
        trees = trees.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "tree", "n_tokens", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, pattern)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names[1:]}
            out = []
            for text, chars, tokens, tree, edits in zip(*[cols[c] for c in ("text", "leaf_chars", "leaf_tokens", "tree", "edits")], strict=True):
                encoded = 0
                for e in edits or []:
                    text, chars, tokens, tree, n = apply_edit(counter, text, chars, tokens, tree, e["start"] or 0, e["stop"] or 0, e["new"] or "")
                    encoded += n
                out.append((text, chars, tokens, tree, tree[0], encoded))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [*names[:6], "n_encoded"])

    id_type = trees.schema["doc_id"].dataType.simpleString()
    return trees.select(*names).mapInArrow(run, f"doc_id {id_type}, text string, {TREE}, n_tokens bigint, n_encoded bigint")
