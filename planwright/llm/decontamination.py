"""Benchmark decontamination as a prefix-filtered set join of shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.llm.text import ALNUM_WORD, fingerprint, lower_ascii, words
from planwright.session import materialize

#: Upper bound of the rows of a benchmark side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win): every `window` consecutive words; an item with fewer words, but not none, is one window."""
    split = items.select("item_id", words(lower_ascii(F.col("text")), ALNUM_WORD).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()


def _places(docs: DataFrame, length: int) -> DataFrame:
    """A row per word: the hash of the shingle of `length` words that begins there."""
    hashes = F.transform("w", lambda _, i: F.xxhash64(F.lit(length), *[F.get("w", i + j) for j in range(length)]))
    return docs.select("*", F.posexplode(hashes).alias("pos", "h"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """Occurrences of item windows in documents.

    A window occurs only where all its shingles do, so it is enough to look for one of them: the windows'
    shingles are ordered by rarity in the whole corpus and the necessary prefix (for containment, the rarest
    one) is joined with the documents' shingles. Its place in the window gives the one place where the window
    can begin; places that begin before the text or end after it fall to the positional and length bounds,
    and the rest are compared word by word. All of it happens on the scan side of a broadcast join while the
    windows number no more than BROADCAST_ROWS; with more, the same join shuffles by shingle.

    Returns (hits: doc_id, fp, win_id, start, stop) and (windows: win_id, item_id).
    """
    pairs = materialize(item_windows(items, window).withColumn("win_id", F.sha2(F.array_join("win", " "), 256)), "windows")
    lengths = [r.k for r in pairs.select(F.least(F.size("win"), F.lit(shingle)).alias("k")).distinct().collect()]
    distinct = pairs.select("win_id", "win", F.least(F.size("win"), F.lit(shingle)).alias("k")).dropDuplicates(["win_id"])
    grams = None
    for k in lengths:
        some = _places(distinct.where(F.col("k") == k).withColumnRenamed("win", "w"), k)
        some = some.where(F.col("pos") <= F.size("w") - k).withColumnRenamed("w", "win")
        grams = some if grams is None else grams.unionByName(some)
    if grams is None:
        hits = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.lit("").alias("win_id"), F.lit(0).alias("start"), F.lit(0).alias("stop")).where(F.lit(False))
        return hits, pairs.select("win_id", "item_id")
    grams = materialize(grams, "grams")
    small = grams.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    split = docs.select("doc_id", "text", words(lower_ascii(F.col("text")), ALNUM_WORD).alias("w"))

    tokens = grams.select("k", "h").distinct()
    counted = None
    for k in lengths:
        some = _places(split.select("w"), k).select("h").join(side(tokens.where(F.col("k") == k).select("h")), "h").groupBy("h").count()
        some = some.withColumn("k", F.lit(k))
        counted = some if counted is None else counted.unionByName(some)
    counted = materialize(counted, "rarity")

    # The rarest shingle of each window; one that no document holds rules its window out.
    order = F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("h"), F.col("pos"))
    prefix = (
        grams.join(counted, ["k", "h"], "left")
        .groupBy("win_id", "k")
        .agg(F.min(order).alias("r"), F.first("win").alias("win"))
        .where(F.col("r.n") > 0)
        .select("win_id", "k", "win", F.col("r.h").alias("h"), F.col("r.pos").alias("off"))
    )
    prefix = materialize(prefix, "prefix")
    hits = None
    keyed = split.select("doc_id", fingerprint(F.col("text")).alias("fp"), "w")
    for k in lengths:
        found = _places(keyed, k).join(side(prefix.where(F.col("k") == k).drop("k")), "h")
        start, length = F.col("pos") - F.col("off"), F.size("win")
        found = found.where((start >= 0) & (start + length <= F.size("w")))
        found = found.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("win"))
        found = found.select("doc_id", "fp", "win_id", start.alias("start"), (start + length).alias("stop"))
        hits = found if hits is None else hits.unionByName(found)
    return hits, pairs.select("win_id", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """A row per row of `docs`: which of its words lie in occurrences of item windows.

    Columns: doc_id, n_words, n_hit (words inside any occurrence), items (sorted item ids as strings),
    contaminated. Other columns of `docs` and `items` are not read. Defined results: a null or wordless text
    has 0 words and no hits; items without words have no windows; a null item_id appears as the string
    "null"; repeated document rows each get the result of their text; empty tables give no rows or no hits.
    """
    docs, items = docs.select("doc_id", "text"), items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    hits, owners = find_hits(docs, items, window, shingle)
    hits = materialize(hits, "hits")
    # Words covered by the spans of one document, merged from left to right.
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["stop"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    words_hit = hits.groupBy("doc_id", "fp").agg(spans.alias("spans")).select("doc_id", "fp", covered.alias("n_hit"))
    found = (
        hits.select("doc_id", "fp", "win_id").distinct().join(owners, "win_id")
        .groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    found = words_hit.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.fp") == F.col("b.fp")))
    found = found.select(F.col("a.doc_id").alias("hit_id"), F.col("a.fp").alias("hit_fp"), "n_hit", "items")
    any_case = ALNUM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # counts alike without lower-casing
    base = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.size(words(F.col("text"), any_case)).cast("long").alias("n_words"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("fp") == F.col("hit_fp")), "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
