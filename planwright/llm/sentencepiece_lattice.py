"""SentencePiece encoding and decoding over a relational lattice of pieces.

Distinct words of all texts are exploded into substrings of bounded length, substrings are joined with the piece
table on equality, edges are sorted by word, and a fold over the edges of a word, many words at once, picks its path. The
model at hand is a byte-pair model, for which the path of the best summed score is not the model's encoding: its
fold takes, step by step, the best-ranked edge that covers exactly two edges of the path so far, leftmost first on
a tie, as the model defines it. The fold for unigram models, by best sum (Viterbi), is `viterbi_words`.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.text import unused
from planwright.session import bound_batches, bucketed, discard, folder_of, materialize

SPACE = "▁"
#: Runs of spaces stay with the word after them; no piece reaches across the borders of these.
MARK = "\x1f"
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n+|{SPACE}+")
#: The places of a path are bits of one long; longer words are folded with a heap, one by one.
FOLDED = 60
#: Words that are frequent in the blocks of documents are sent to all tasks, this many at most; each block names so many.
FREQUENT, NAMED = 100_000, 20_000
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 2_000_000
#: Words whose edges are sorted together.
WORDS_PER_TASK = 100_000
#: Rounds in which ids go back to the blocks.
ROUNDS = 2
#: Edges that a task folds at once.
EDGES_HELD = 300_000


def piece_rows(model_file: str) -> list[tuple[int, str, float, bool]]:
    """(id, piece, score, is_byte) of the normal and byte pieces of a model file; as many as its vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = [(i, model.id_to_piece(i), model.get_score(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return [r for r in rows if not (model.is_control(r[0]) or model.is_unknown(r[0]))]


class PieceTable:
    """Normal pieces by rank, the best score first, and the ids of bytes."""

    def __init__(self, rows: list[tuple[int, str, float, bool]]):
        normal = sorted((r for r in rows if not r[3]), key=lambda r: (-r[2], r[0]))
        self.rank = {piece: k for k, (_, piece, _, _) in enumerate(normal)}
        self.ids = [r[0] for r in normal]
        self.byte_ids = [i for _, i in sorted((int(p[3:5], 16), i) for i, p, _, b in rows if b)]
        self.longest = max(map(len, self.rank), default=1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, rank): as large as the vocabulary, whatever the input."""
        return spark.createDataFrame(list(self.rank.items()), "piece string, rank int")


def merged(tables: list[pa.Table]) -> pa.Table:
    """(word, n) of all tables, a row per word."""
    both = pa.concat_tables(tables) if tables else pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    return both.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def frequent_words(docs: DataFrame, text: str) -> tuple[list[str], int]:
    """(the most frequent words of all blocks, FREQUENT at most; the sum of the blocks' distinct words).

    Each task names the NAMED most frequent words among HELD_WORDS distinct ones, and how many these are. The cut
    follows from a histogram of some dozens of steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pack() -> pa.RecordBatch:
            found = merged(held)
            held.clear()
            top = found.take(pc.select_k_unstable(found, min(NAMED, found.num_rows), [("n", "descending"), ("word", "ascending")])) if found.num_rows else found
            words, counts = [None, *top.column("word").to_pylist()], [found.num_rows, *top.column("n").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            counts = split_words(batch.column(text))[0].value_counts()
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            if sum(t.num_rows for t in held) > HELD_WORDS:
                held[:] = [merged(held)]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield pack()
        yield pack()

    counted = materialize(docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    n_words = counted.where("word IS NULL").agg(F.sum("n")).head()[0] or 0
    known = counted.where("word IS NOT NULL")
    steps = known.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    total, cut = 0, 2**62
    for r in sorted(steps.collect(), reverse=True):
        total += r["words"]
        if total > FREQUENT:
            break
        cut = r["least"]
    words = [r["word"] for r in known.where(F.col("n") >= cut).select("word").collect()]
    discard(counted)
    return words, n_words


def block_words(docs: DataFrame, text: str, block: str, known: Broadcast) -> DataFrame:
    """(block, word): the distinct words of each block of documents but the known ones, now and then one twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0

        def distinct() -> pa.Array:
            return pa.concat_arrays(held).unique() if held else pa.array([], pa.string())

        def pack() -> Iterator[pa.RecordBatch]:
            found = distinct()
            held.clear()
            found = found.filter(pc.invert(pc.is_in(found, value_set=known.value[0])))
            for k in range(0, len(found), 50_000):
                part = found.slice(k, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at, np.int32)), part], ["block", "word"])

        for batch in batches:
            if batch.num_rows:
                at = batch.column(block)[0].as_py()
            held.append(split_words(batch.column(text))[0].unique())
            if sum(map(len, held)) > HELD_WORDS:
                held[:] = [distinct()]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from pack()
        yield from pack()

    return docs.select(text, block).mapInArrow(run, "block int, word string")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, where the words of each text begin, and the end).

    A border mark is put before each space and around each line break, marks inside runs of these are taken out
    again, and texts are split at the rest. Texts that hold the mark themselves are split by WORD, one by one.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        found = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.to_pylist()]
        return pa.array([w for ws in found for w in ws], pa.string()), np.cumsum([0, *map(len, found)])
    some = pc.not_equal(texts, "")
    marked = pc.if_else(some, pc.binary_join_element_wise(MARK + SPACE, pc.replace_substring(pc.replace_substring(texts, SPACE, " "), " ", MARK + SPACE), ""), "")
    marked = pc.replace_substring(marked, "\n", f"{MARK}\n{MARK}")
    for run, joined in ((f"{SPACE}{MARK}{SPACE}", SPACE * 2), (f"\n{MARK}{MARK}\n", "\n\n")):
        while pc.any(pc.match_substring(marked, run)).as_py():
            marked = pc.replace_substring(marked, run, joined)
    lists = pc.split_pattern(marked, MARK)
    words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    real = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[ends]


def lattice(words: DataFrame, pieces: PieceTable) -> DataFrame:
    """(id, edge, word) of each distinct word of `words`: its edges together, told apart by id.

    An edge of two characters or more from place a to b is the number rank * 4096 + a * 64 + b. A row without an edge
    names the word. The rows of a word are sorted where the word already is, by a number, so edges are never shuffled.
    """
    n = F.char_length("word")
    named = words.select(F.monotonically_increasing_id().alias("id"), "word")
    starts = named.select("id", "word", F.posexplode(F.sequence(F.lit(-1), n - 2)).alias("k", "a"))
    ends = starts.select("id", "word", "a", F.explode(F.when(F.col("a") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("a") + 2, F.least(n, F.col("a") + pieces.longest)))).alias("b"))
    wide = pieces.frame(words.sparkSession).where(F.char_length("piece") > 1)
    ends = ends.withColumn("piece", F.when(F.col("a") >= 0, F.substring("word", F.col("a") + 1, F.col("b") - F.col("a"))))
    found = ends.join(F.broadcast(wide), "piece", "left").where(F.col("rank").isNotNull() | (F.col("a") < 0))
    edge = F.col("rank").cast("long") * 4096 + F.col("a") * 64 + F.col("b")
    return found.select("id", edge.alias("edge"), F.when(F.col("a") < 0, F.col("word")).alias("word")).sortWithinPartitions("id")


def folded_paths(n: np.ndarray, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the path of each word, which edges lie on it), of words of `n` characters with `edges`, sorted by `at`, the word's place, and rank.

    A path is a number with a bit for each place where an edge of it ends. Step by step the first edge in rank order
    that begins and ends at such places, with exactly one of them inside, takes that one out, in all words at once.
    """
    one = np.uint64(1)
    bit = lambda place: one << place.astype(np.uint64)
    begin, end = (edges >> 6) & 63, edges & 63
    ends, inside = bit(begin) | bit(end), bit(end) - bit(begin + 1)
    path, live = bit(n + 1) - one, np.arange(len(edges))
    while len(live):
        words, own = at[live], path[at[live]]
        within = own & inside[live]
        open_ = ((own & ends[live]) == ends[live]) & (within != 0)  # places only go, so others never fit again
        fits = np.flatnonzero(open_ & ((within & (within - one)) == 0))
        first = fits[np.diff(words[fits], prepend=-1) != 0]
        path[words[first]] &= ~inside[live[first]]
        moved = np.zeros(len(n), bool)
        moved[words[first]] = True
        live = live[open_ & moved[words]]
    return path, (path[at] & (ends | inside)) == ends


def _ids_of_paths(table: PieceTable, words: pa.Array, path: np.ndarray, at: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """The ids along the paths: of the edges (word's place, edge) on them, and of characters that stand alone or of their bytes."""
    raw = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each character's bytes
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(points)) - first[owner]
    held = lambda k: ((path[owner] >> (place + k).astype(np.uint64)) & np.uint64(1)).astype(bool)
    starts = held(0)  # the characters at which an edge of the path begins
    ids, count = np.full(len(points), -1, np.int64), np.zeros(len(points), np.int64)
    single = np.array(sorted((ord(p), table.ids[r]) for p, r in table.rank.items() if len(p) == 1), np.int64).reshape(-1, 2)
    alone = np.flatnonzero(starts & held(1))
    if len(single):
        found = np.minimum(np.searchsorted(single[:, 0], points[alone]), len(single) - 1)
        ids[alone] = np.where(single[found, 0] == points[alone], single[found, 1], -1)
    ids[first[at] + ((edges >> 6) & 63)] = np.array(table.ids, np.int64)[edges >> 12]
    count[starts] = np.where(ids[starts] >= 0, 1, np.diff(begins)[starts])
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.repeat(ids, count)
    missing = np.flatnonzero(out < 0)
    char = np.repeat(np.arange(len(points)), count)[missing]
    out[missing] = np.array(table.byte_ids or [0], np.int64)[raw[begins[char] + missing - ends[char]]] if len(missing) else 0
    return pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(out.astype(np.int32)))


def merge_fold(lattices: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, ids) of (id, edge, word), sorted by id, for byte-pair models; some EDGES_HELD edges are folded at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = PieceTable(shared.value), []

        def fold(rows: pa.Table) -> pa.RecordBatch:
            named = rows.filter(pc.is_valid(rows.column("word")))
            words = pa.concat_arrays(named.column("word").chunks)
            edged = rows.filter(pc.is_valid(rows.column("edge")))
            edges = edged.column("edge").to_numpy()
            at = np.searchsorted(named.column("id").to_numpy(), edged.column("id").to_numpy())
            order = np.lexsort((edges, at))
            at, edges = at[order], edges[order]
            path, on = folded_paths(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), at, edges)
            return pa.RecordBatch.from_arrays([words, _ids_of_paths(table, words, path, at[on], edges[on])], ["word", "ids"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > EDGES_HELD:
                rows = pa.Table.from_batches(held)
                # The last word may go on in the next batch.
                whole = int(np.searchsorted(rows.column("id").to_numpy(), rows.column("id")[-1].as_py()))
                held = rows.slice(whole).to_batches()
                if whole:
                    yield fold(rows.slice(0, whole))
        if sum(b.num_rows for b in held):
            yield fold(pa.Table.from_batches(held))

    return lattices.mapInArrow(run, "word string, ids array<int>")


def merge_one(table: PieceTable, word: str) -> list[str]:
    """The same merges on one word of any length, with a heap of candidate pairs."""
    parts, nexts, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        j = nexts[i]
        if j < len(parts) and len(parts[i]) + len(parts[j]) <= table.longest:
            rank = table.rank.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = nexts[i]
        if parts[i] != left or j >= len(parts) or parts[j] != right:
            continue
        parts[i], parts[j], nexts[i] = left + right, "", nexts[j]
        if nexts[j] < len(parts):
            before[nexts[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p]


def _ids_of(table: PieceTable, parts: list[str]) -> list[int]:
    out = []
    for part in parts:
        rank = table.rank.get(part)
        out += [table.ids[rank]] if rank is not None else [table.byte_ids[b] for b in part.encode()]
    return out


def long_word_ids(words: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, ids) of words longer than FOLDED, by the same merges with a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(shared.value)
        for batch in batches:
            lists = [_ids_of(table, merge_one(table, w)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(lists, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def word_ids(words: DataFrame, pieces: list[tuple[int, str, float, bool]]) -> DataFrame:
    """(word, ids) of the distinct words of `words`, which are partitioned by word already."""
    table, shared = PieceTable(pieces), words.sparkSession.sparkContext.broadcast(pieces)
    distinct, is_long = words.select("word").distinct(), F.char_length("word") > FOLDED
    both = merge_fold(lattice(distinct.where(~is_long), table), shared).unionByName(long_word_ids(distinct.where(is_long), shared))
    return both.withColumn("ids", F.col("ids").cast("array<smallint>" if max((r[0] for r in pieces), default=0) < 2**15 else "array<int>"))


def with_ids(words: DataFrame, ids: DataFrame) -> DataFrame:
    """`words` with the ids of (word, ids), by a table of the ids in each task, so that neither side is sorted."""
    return words.join(ids.hint("shuffle_hash"), "word")


def encode(docs: DataFrame, pieces: list[tuple[int, str, float, bool]]) -> DataFrame:
    """`docs` with ids array<int>, the model's encoding of `text`; a null or empty text has none.

    Texts stay where they are. A block is an input partition: its distinct words go out, each distinct word of all
    blocks is encoded once by the lattice, and its ids come back to the blocks: the most frequent words by a
    broadcast of bounded size, the rest as a small table per block that its task reads. So `docs` must deal its rows
    alike each time, as table scans and materialised tables do; a task that misses a word fails. A source that holds
    a third of all rows is no different from others. A column of `docs` named ids is replaced, others stay; repeated
    rows come out alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark, 4 << 20)
    docs = docs.drop("ids")
    kept, block = docs.columns, unused("block", docs.columns)
    dealt = docs.withColumn(block, F.spark_partition_id())
    top, n_words = frequent_words(dealt, "text")
    tasks = lambda n: 1 + n // WORDS_PER_TASK
    common = spark.createDataFrame([(w,) for w in top], "word string").repartition(8 * tasks(len(top)), "word")
    common = word_ids(common, pieces).toArrow().cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
    shared = spark.sparkContext.broadcast([pa.concat_arrays([*c.chunks]) if c.num_chunks else pa.array([], c.type) for c in common.columns])
    # Bucketed by word: edges are sorted where their word is, and only the ids of distinct words move, into the same buckets.
    rare = bucketed(block_words(dealt, "text", block, shared), tasks(n_words), "word", "rare-words")
    found = bucketed(word_ids(rare, pieces), tasks(n_words), "word", "rare-ids")
    # In rounds, so that only a part of what goes back to the blocks is in shuffle files at a time.
    parts = [materialize(with_ids(rare.where(F.pmod("block", F.lit(ROUNDS)) == k), found).repartition("block"), "block-words", by="block") for k in range(ROUNDS)]
    discard(rare, found)
    folders = [folder_of(p) for p in parts]

    def own_words(at: int) -> list[pa.Array]:
        filesystem, base = fs.FileSystem.from_uri(folders[at % ROUNDS])
        path = f"{base}/block={at}"
        if filesystem.get_file_info(path).type == fs.FileType.NotFound:
            return shared.value
        own = ds.dataset(path, filesystem=filesystem, format="parquet", partitioning=None).to_table(columns=["word", "ids"])
        own = own.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
        return [pa.concat_arrays([a, *c.chunks]) for a, c in zip(shared.value, own.columns, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = None, None
        for batch in batches:
            if batch.num_rows and words is None:
                words, ids = own_words(batch.column(block)[0].as_py())
            flat, starts = split_words(batch.column("text"))
            lists = ids.take(pc.index_in(flat, value_set=words)) if len(flat) else pa.array([], pa.list_(pa.int32()))
            if lists.null_count:
                raise ValueError("the input has dealt its rows in another way: materialize it before")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            out = pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), lists.flatten())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [out], [*kept, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>"
    return dealt.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: list[tuple[int, str, float, bool]]) -> DataFrame:
    """`encoded` with decoded, the text of `ids`: pieces joined, bytes put together, the leading space taken off.

    Null or no ids give an empty text, ids outside the table nothing, and bytes that are no UTF-8 U+FFFD. A column of
    `encoded` named decoded is replaced; repeated rows come out alike; an empty table gives no rows.
    """
    digits = [""] * (1 + max((r[0] for r in pieces), default=0))
    for i, piece, _, is_byte in pieces:
        digits[i] = piece[3:5] if is_byte else piece.replace(SPACE, " ").encode().hex()
    table = F.split(F.lit(",".join(digits)), ",")
    joined = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(table, i)), "")
    text = F.make_valid_utf8(F.unhex(joined).cast("string"))
    return encoded.withColumn("decoded", F.when(F.startswith(text, F.lit(" ")), F.substring(text, F.lit(2), F.char_length(text))).otherwise(text))


def viterbi_words(spark: SparkSession, words: DataFrame, pieces: DataFrame, longest: int = 16) -> DataFrame:
    """(word, path) by the relational lattice: the pieces of the path with the best summed score, for unigram models.

    `words` has word, `pieces` (piece, score). Substrings of at most `longest` characters are joined with the
    piece table, edges are grouped by word, and a higher-order fold over them in order of their ends keeps the best
    path to each place. A word without a path has a null one, as has a null word; repeated words give one row.
    """
    distinct = words.select("word").distinct()
    n = F.char_length("word")
    starts = distinct.where(n > 0).select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    ends = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(n, F.col("a") + longest))).alias("b"))
    table = pieces.groupBy("piece").agg(F.max("score").cast("double").alias("score"))
    edges = ends.withColumn("piece", F.expr("substring(word, a + 1, b - a)")).join(F.broadcast(table), "piece")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("b", "a", "piece", "score"))).alias("edges"))
    state = "array<struct<score:double,path:array<string>>>"
    none = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("path"))
    # best[p] is the best path to place p; an edge (a, b) offers best[a] and itself to place b.
    first = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("path"))), F.transform(F.sequence(F.lit(1), n), lambda _: none)).cast(state)

    def step(best, e):
        offer = F.get(best, e["a"])["score"] + e["score"]
        better = offer.isNotNull() & (F.get(best, e["b"])["score"].isNull() | (offer > F.get(best, e["b"])["score"]))
        new = F.struct(offer.alias("score"), F.array_append(F.get(best, e["a"])["path"], e["piece"]).alias("path"))
        return F.when(better, F.transform(best, lambda x, p: F.when(p == e["b"], new).otherwise(x))).otherwise(best)

    folded = grouped.withColumn("best", F.aggregate("edges", first, step)).withColumn("end", F.get("best", n))
    paths = folded.select(F.col("word").alias("w"), F.when(F.col("end.score").isNotNull(), F.col("end.path")).alias("path"))
    return distinct.join(paths, F.col("word") == F.col("w"), "left").select("word", F.when(n == 0, F.array().cast("array<string>")).otherwise(F.col("path")).alias("path"))
