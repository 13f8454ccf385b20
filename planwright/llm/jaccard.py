"""N-gram Jaccard self-join as a T-occurrence search with DivideSkip, down to connected components.

A set of n tokens and a partner that reaches the similarity share at least T = ceil(percent / 100 * n) tokens. The L
longest inverted lists of each set are put aside, L = T - SHARED, and the short ones are merged: a shuffle by token,
then a count by pair. Pairs counted T - L times or more are candidates; each is settled by merging the short parts
again and probing the long ones by binary search in the other set, which holds a token exactly if the token's list
holds the set: so lists with a third of all sets are probed without ever being built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.llm.text import SPACED_WORD, lower_ascii, words
from planwright.session import bound_batches, bucketed, discard, materialize

#: T - L: how often a candidate stands in the short lists of a set at least.
SHARED = 2
#: Lists longer than this, and than the LONG_LISTS-th part of all postings seen, are long.
LONG = 50
LONG_LISTS = 400_000
#: Tokens that a task counts together; those found once among them are left out of list lengths.
COUNTED = 2_000_000
#: Chosen ids are broadcast up to this many, else both sides shuffle.
BROADCAST_ROWS = 1_000_000
#: Members compared with one hub in one group.
HUB_MEMBERS = 500
#: A list with more components than this is crowded: its members are compared with hubs before all pairs are.
CROWD = 32
#: Whole sets that a bucket holds, and links that a task puts together at once, more or less.
BUCKET_SETS, TASK_LINKS = 4_000, 250_000
#: Hubs for each member of crowded lists in a round, and rounds at most; what they leave is compared pair by pair.
HUBS, HUB_ROUNDS = 8, 4
#: A sketch is the parity of the number of tokens in each of 64 * SKETCH parts of the hash space.
SKETCH = 16
#: Longs of a sketch with its parts put together, for rows of lists.
FOLDS = 8

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(hashes: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each list of word hashes, the sorted distinct hashes of its shingles; of all its words if they are fewer."""
    starts, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.full(len(flat), np.uint64(size))
        for k in range(size):
            nexts = np.zeros(len(flat), np.uint64)
            nexts[: max(0, len(flat) - k)] = flat[k:]
            rolled = _mix(rolled * _MIX[0] + nexts)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = np.full(1, np.uint64(b - a))
                for w in flat[a:b]:
                    short = _mix(short * _MIX[0] + w)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _class(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that sets share if, and as good as only if, they are equal."""
    with np.errstate(over="ignore"):
        sums = [np.sum(_mix(tokens ^ m)) + np.uint64(len(tokens)) for m in _MIX[:2]]
    return tuple(int(np.asarray(s, np.uint64).view(np.int64)) for s in sums)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(64 - (64 * SKETCH).bit_length() + 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("wh", F.transform(words(lower_ascii(F.col("text")), SPACED_WORD), lambda w: F.xxhash64(w))).drop("text")


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def needed(n: int, percent: int) -> int:
    """T: the tokens that a set of n shares with any partner that reaches the similarity."""
    return (percent * n + 99) // 100


def divide(s: np.ndarray, long: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(tokens of the short lists, known long ones that fill these up, the tokens put aside, T - L) of a set; one order for all sets, known long lists last."""
    t = needed(len(s), percent)
    shared = min(SHARED, t)
    take = len(s) - t + shared
    is_long = long[np.minimum(np.searchsorted(long, s), len(long) - 1)] == s if len(long) else np.zeros(len(s), bool)
    short, rest = s[~is_long], s[is_long]
    more = max(0, take - len(short))
    return short[:take], rest[:more], np.sort(np.concatenate([short[take:], rest[more:]])), shared


def long_lists(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens with long inverted lists, sorted; never more than LONG_LISTS of them.

    Every task counts the tokens of COUNTED at a time and passes on those found twice or more, so next to nothing
    moves. Lengths only set the order of lists: any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pack() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = count > 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column("wh"), size):
                held.append(s)
                n += len(s)
                if n >= COUNTED:
                    yield pack()
                    n = 0
        yield pack()

    seen = _hashed(docs.select("text")).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    seen = materialize(seen.where(F.col("n") > LONG), "long-lists")
    total = seen.agg(F.sum("n")).head()[0] or 0
    rows = seen.where(F.col("n") > max(LONG, total // LONG_LISTS)).select("token").toPandas()
    discard(seen)
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def index(docs: DataFrame, size: int, percent: int, long: Broadcast) -> DataFrame:
    """(doc_id, c1, c2, n, shared, short, long): the set of each row of `docs`, divided; of the long lists only those that fill up the short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("wh"), size))
            classes = [_class(s) for s in sets]
            parts = [divide(s, long.value, percent) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([c[k] for c in classes], pa.int64()) for k in (0, 1)], pa.array([len(s) for s in sets], pa.int64()), pa.array([p[3] for p in parts], pa.int32()),
                 _longs([p[0] for p in parts]), _longs([p[1] for p in parts])],
                ["doc_id", "c1", "c2", "n", "shared", "short", "long"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hashed(docs).mapInArrow(run, f"doc_id {kind}, c1 bigint, c2 bigint, n bigint, shared int, short array<bigint>, long array<bigint>")


def shared_lists(listed: DataFrame) -> DataFrame:
    """(token, c, n, shared, hub, hub_n) of the merged lists that two or more classes stand in; hub is the shortest set of the list.

    Lists that are not known to be long move once and are read by windows. Of known long ones, which only sets of
    little else are listed under, the ends are found with map-side combining and joined back by a broadcast of at
    most LONG_LISTS rows, so no task holds such a list.
    """
    posting = lambda column: listed.select(F.explode(column).alias("token"), F.col("c1").alias("c"), F.col("n").cast("int").alias("n"), "shared")
    whole = Window.partitionBy("token").orderBy("n", "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = posting("short").select("*", F.struct(F.first("n").over(whole).alias("n"), F.first("c").over(whole).alias("c")).alias("p"), F.last("c").over(whole).alias("last"))
    few = ended.where("p.c <> last").drop("last")
    ends = [F.min(F.struct("n", "c")).alias("p"), F.min("c").alias("low"), F.max("c").alias("high")]
    crowded = posting("long").groupBy("token").agg(*ends).where("low <> high").select("token", "p")
    many = posting("long").join(F.broadcast(crowded), "token")
    both = few.unionByName(many).select("token", "c", "n", "shared", F.col("p.c").alias("hub"), F.col("p.n").alias("hub_n"))
    return materialize(both.distinct(), "jaccard-lists")


def _may_link(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _sketches_allow(percent: int) -> Column:
    """Whether two sets can reach the similarity: a part with differing parity holds a token that only one of them has."""
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (c, hub) that the lengths and sketches (c, set_n, sketch) of both allow."""
    a = sketches.select("c", F.col("set_n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    b = sketches.select(F.col("c").alias("hub"), F.col("set_n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    both = pairs.join(a, "c").join(b, "hub")
    return both.where(_may_link(F.col("a_n"), F.col("b_n"), percent) & _sketches_allow(percent)).select("c", "hub")


def whole_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(c, set_n, sketch, tokens) of the documents that stand for the classes `reps`, bucketed by c."""
    ids = materialize(reps.select(F.col("doc_id").alias("_id"), F.col("c").alias("_c")), "jaccard-reps")
    n_sets = ids.count()
    few = n_sets <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(s, c) for s, c in zip(shingle_sets(batch.column("wh"), size), batch.column("_c").to_pylist(), strict=True) if len(s) and _class(s)[0] == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for _, c in sets], pa.int64()), pa.array([len(s) for s, _ in sets], pa.int32()), _longs([_sketch(s) for s, _ in sets]), _longs([s for s, _ in sets])],
                ["c", "set_n", "sketch", "tokens"])

    found = _hashed(chosen.select("text", "_c")).mapInArrow(run, "c bigint, set_n int, sketch array<bigint>, tokens array<bigint>")
    sets = bucketed(found, 1 + n_sets // BUCKET_SETS, "c", "jaccard-sets")
    discard(ids)
    return sets


def verified(sets: DataFrame, pairs: DataFrame, percent: int, long: Broadcast) -> DataFrame:
    """The pairs (c, hub) that link, by DivideSkip on the whole sets (c, tokens).

    Sets move once for each pair as a member, and once for each HUB_MEMBERS members as a hub; sets without a pair stay
    where they are, as the pairs come to the buckets of `sets`.
    """
    salt = F.pmod(F.xxhash64("c"), "parts").cast("int")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").select("c", "hub", salt.alias("part"))
    hubs = parts.select(F.col("hub").alias("c"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = dealt.withColumn("is_hub", F.lit(False)).unionByName(hubs.withColumn("is_hub", F.lit(True)))
    rows = sets.select("c", "tokens").join(wanted.hint("shuffle_hash"), "c").repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, t = None, None, 0
        for batch in batches:
            lists, out = batch.column("tokens"), []
            flat, starts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for k, (c, h, part, is_hub) in enumerate(zip(*[batch.column(x).to_pylist() for x in ("c", "hub", "part", "is_hub")], strict=True)):
                tokens = flat[starts[k] : starts[k + 1]]
                if is_hub:
                    at, hub = (h, part), tokens.copy()
                    short, more, rest, t = divide(hub, long.value, percent)
                    short = np.concatenate([short, more])
                    continue
                assert at == (h, part)
                both = len(np.intersect1d(short, tokens, assume_unique=True))
                if both >= min(t, needed(len(tokens), percent)):
                    both += int(np.count_nonzero(tokens[np.minimum(np.searchsorted(tokens, rest), len(tokens) - 1)] == rest))
                    if 100 * both >= percent * (len(hub) + len(tokens) - both):
                        out.append((c, h))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["c", "hub"])

    return materialize(rows.select("c", "hub", "part", "is_hub", "tokens").mapInArrow(run, "c bigint, hub bigint"), "jaccard-links")


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that the edges connect it with), where these differ."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = places[: len(u)], places[len(u) :], np.arange(len(nodes))
    while len(a):
        # Each root beside a smaller one is hung below it, so half of all roots go in a round.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _put_together(edges: DataFrame, n: int) -> DataFrame:
    """The `n` edges, replaced by stars with the same components, TASK_LINKS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy() for k in range(2)] for b in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _roots(*map(np.concatenate, zip(*held, strict=True)))], ["u", "v"])

    return edges.select("u", "v").repartition(1 + n // TASK_LINKS).mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of (u, v), the smallest node of each component.

    Tasks put together what links they hold; if these are more than one task holds, large-star and small-star rounds
    between them go on until the edges are stars.
    """
    canonical = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    edges = materialize(canonical(links), "components")
    before = None
    while (after := size(edges)) != before and after[0]:
        whole = after[0] < TASK_LINKS
        both = materialize(_put_together(edges, after[0]), "components")
        discard(edges)
        edges, before = both, after
        if whole:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(canonical(small), "components")
        discard(edges)
        edges = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(c, comp) after more links between classes: components of components, so that later rounds only see what changed."""
    a, b = (placed.select(F.col("c").alias(k), F.col("comp").alias(v)) for k, v in (("c", "u"), ("hub", "v")))
    moved = components(links.join(a, "c").join(b, "hub").select("u", "v")).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return materialize(placed.join(moved, "comp", "left").select("c", F.coalesce("to", "comp").alias("comp")), "jaccard-components")


def _mixed(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of `lists` in whose list more than one component stands, with comp, most (the one with most classes) and comps."""
    token = Window.partitionBy("token")
    at = lists.select("token", "c", "n", "shared").join(placed, "c")
    at = at.withColumn("place", F.dense_rank().over(token.orderBy("comp"))).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("token", "comp")))
    at = at.select("token", "c", "n", "shared", "comp", F.max(F.struct("count", "comp")).over(token)["comp"].alias("most"), F.max("place").over(token).cast("long").alias("comps"))
    return materialize(at.where("comps > 1"), "jaccard-mixed")


def hub_pairs(lists: DataFrame, degree: DataFrame, turn: int, percent: int) -> DataFrame:
    """(c, hub): classes of crowded lists, each with the drawn hubs of other components that it shares most lists with.

    Each list draws a hub of its own in each round, members with more links being likelier. So near copies that
    no single hub is close to still grow together at some comparisons each instead of one for each pair.
    """
    drawn = (F.pmod(F.xxhash64("token", "c", F.lit(turn)), F.lit(1 << 30)) + 1) / float(1 << 30)
    race = -F.log(drawn) / (1 + F.coalesce("degree", F.lit(0)))
    hubs = lists.join(degree, "c", "left").groupBy("token").agg(F.min(F.struct(race.alias("race"), "c", "n", "comp")).alias("h"))
    met = lists.join(hubs, "token").where((F.col("comp") != F.col("h.comp")) & _may_link(F.col("n"), F.col("h.n"), percent))
    met = met.groupBy("c", F.col("h.c").alias("hub")).count()
    best = met.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "hub")), False), 1, HUBS).alias("best"))
    return best.select("c", F.explode("best.hub").alias("hub"))


def linked(lists: DataFrame, sets: DataFrame, percent: int, long: Broadcast) -> DataFrame:
    """(c, comp) of all classes in `lists`, comp being the smallest class of the component."""
    sketches = sets.select("c", "set_n", "sketch")
    ordered = lambda df: df.select(F.least("c", "hub").alias("c"), F.greatest("c", "hub").alias("hub")).distinct()
    met = lists.where((F.col("c") != F.col("hub")) & _may_link(F.col("n"), F.col("hub_n"), percent)).groupBy("c", "hub").count()
    first = met.groupBy("c").agg(F.max(F.struct("count", "hub")).alias("best")).select("c", F.col("best.hub").alias("hub"))
    done = materialize(ordered(first), "jaccard-pairs")
    links = verified(sets, possible(done, sketches, percent), percent, long)
    placed = _merged(lists.select("c").distinct().withColumn("comp", F.col("c")), links)
    mixed = crowded = _mixed(lists, placed)
    for turn in range(HUB_ROUNDS):
        # Components only grow, so lists that are crowded later are so now.
        crowded = crowded.where(F.col("comps") > CROWD)
        if crowded.isEmpty():
            break
        degree = links.select(F.explode(F.array("c", "hub")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("degree"))
        pairs = materialize(ordered(hub_pairs(crowded, degree, turn, percent)).join(done, ["c", "hub"], "left_anti"), "jaccard-pairs")
        new = verified(sets, possible(pairs, sketches, percent), percent, long)
        links, done, before = links.unionByName(new), done.unionByName(pairs), placed
        placed = _merged(placed, new)
        discard(before)
        crowded = _mixed(crowded, placed)
    if crowded is not mixed:
        mixed = _mixed(mixed, placed)
    # Pairs of different components, counted over all lists in which both stand; a folded sketch travels with them.
    folds = [f"s{k}" for k in range(FOLDS)]
    folded = sets.select("c", *[reduce(Column.bitwiseXOR, [F.get("sketch", F.lit(i)) for i in range(k, SKETCH, FOLDS)]).alias(f) for k, f in enumerate(folds)])
    mixed = mixed.join(folded, "c")
    other = [F.col(x).alias(f"b_{x}") for x in ("c", "n", "shared", "comp", *folds)]
    met = mixed.where("comp <> most").join(mixed.select("token", *other), "token")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f).bitwiseXOR(F.col(f"b_{f}"))) for f in folds])
    near = differ * (100 + percent) <= (F.col("n") + F.col("b_n")) * (100 - percent)
    met = met.where((F.col("comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("most")) | (F.col("c") < F.col("b_c"))) & _may_link(F.col("n"), F.col("b_n"), percent) & near)
    counted = met.groupBy(F.least("c", "b_c").alias("c"), F.greatest("c", "b_c").alias("hub")).agg(F.count(F.lit(1)).alias("both"), F.min(F.least("shared", "b_shared")).alias("least"))
    pairs = counted.where("both >= least").select("c", "hub").join(done, ["c", "hub"], "left_anti")
    pairs = materialize(possible(pairs, sketches, percent), "jaccard-pairs")
    return _merged(placed, verified(sets, pairs, percent, long))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per row of `docs`.

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of shingles of `size` words
    (ASCII lower-cased; all words as one shingle if they are fewer). component_id is the smallest doc_id that
    links reach, the document's own included.

    Equal sets are one class, of which one document stands for all. Classes that meet in a short list are first
    compared with a hub, the smallest set of the list, that they share most lists with, and in crowded lists with
    drawn hubs; of classes that are not in one component after that, every pair that is counted T - L times and that
    the sketches of both do not rule out is compared. So a group of very many near copies costs some comparisons
    each, and no link is lost. Defined results: texts without words have 0 shingles and are alone; a null doc_id
    counts as the smallest; repeated rows are in one component; other columns are not read; an empty table gives no
    rows.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    bound_batches(spark, 4 << 20)
    long = spark.sparkContext.broadcast(long_lists(docs, size))
    listed = materialize(index(docs, size, percent, long), "jaccard-index")
    lists = shared_lists(listed.where("n > 0"))
    ids = listed.where("n > 0").groupBy(F.col("c1").alias("c")).agg(F.min(F.struct("doc_id")).alias("least"))
    reps = ids.join(lists.select("c").distinct(), "c", "left_semi").select("c", "least.doc_id")
    sets = whole_sets(docs, reps, size)
    placed = linked(lists, sets, percent, long)
    discard(lists, sets)
    nodes = ids.join(placed, "c", "left").select("c", "least", F.coalesce("comp", "c").alias("comp"))
    smallest = nodes.groupBy("comp").agg(F.min("least").alias("smallest"))
    classes = nodes.join(smallest, "comp").select(F.col("c").alias("k"), F.col("smallest.doc_id").alias("component_id"))
    out = listed.select("doc_id", "c1", "n").join(classes, F.col("c1") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
