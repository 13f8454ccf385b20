"""Known phrases in running words: the longest one at each place, from left to right without overlaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of the longest phrase looked for.
MOST_WORDS = 4


def windows(texts: DataFrame, keys: list[str], most: int = MOST_WORDS) -> DataFrame:
    """(keys, start, n, phrase): all runs of 1 to `most` of the words of each row's array `words`; start counts from 0."""
    # Plain explode() would have its input filtered first, with all that the arrays are made from worked out once more for it.
    runs = F.transform("words", lambda _, i: F.slice("words", i + 1, most))
    placed = texts.select(*keys, F.posexplode_outer(runs).alias("start", "run")).where(F.col("start").isNotNull())
    phrase = lambda n: F.when(F.size("run") >= n, F.array_join(F.slice("run", 1, n), " "))
    each = placed.select(*keys, "start", F.posexplode_outer(F.array(*[phrase(n) for n in range(1, most + 1)])).alias("n", "phrase")).where(F.col("phrase").isNotNull())
    return each.select(*keys, "start", (F.col("n") + 1).alias("n"), "phrase")


def longest(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each place the longest run found."""
    rest = [c for c in found.columns if c not in (*keys, "start")]
    top = found.groupBy(*keys, "start").agg(F.max(F.struct("n", *[c for c in rest if c != "n"])).alias("m"))
    return top.select(*keys, "start", *[F.col(f"m.{c}").alias(c) for c in rest])


def without_overlaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Runs taken from the left, each beginning behind the one taken before; one run a place.

    Runs that hang together through overlaps are found by a running maximum of their ends, and only such a chain is
    gone through in order; chains are short, however long the text.
    """
    # The furthest end before each run; where it does not reach the run, a new chain begins.
    order = Window.partitionBy(*keys).orderBy("start")
    marked = found.withColumn("_reach", F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    chains = marked.withColumn("_chain", F.sum(F.when(F.col("_reach") > F.col("start"), 0).otherwise(1)).over(order))
    rest = [c for c in found.columns if c not in keys]
    listed = chains.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in rest if c != "start"]))).alias("runs"))
    empty = F.struct(F.lit(0).alias("end"), F.slice("runs", 1, 0).alias("kept"))
    take = lambda a, r: F.when(r["start"] >= a["end"], F.struct((r["start"] + r["n"]).alias("end"), F.concat(a["kept"], F.array(r)).alias("kept"))).otherwise(a)
    kept = listed.select(*keys, F.explode(F.aggregate("runs", empty, take, lambda a: a["kept"])).alias("r"))
    return kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def find_phrases(texts: DataFrame, keys: list[str], targets: DataFrame, key_of: Callable[[Column], Column], most: int = MOST_WORDS) -> DataFrame:
    """(keys, start, n, name): where `targets` (name) stand in the word arrays of `texts`.

    Phrases and names are compared by `key_of`; of names with one key the smallest counts. Runs whose key is null or
    empty match nothing; a row without words has no phrases; repeated rows of `texts` must differ in `keys`.
    """
    named = targets.select("name", key_of(F.col("name")).alias("_key")).where(F.col("_key") != "").groupBy("_key").agg(F.min("name").alias("name"))
    found = windows(texts, keys, most).withColumn("_key", key_of(F.col("phrase"))).where(F.col("_key") != "").join(named, "_key").select(*keys, "start", "n", "name")
    # Dealt once, by row: the longest of a place and the chains of a row are found where its runs lie.
    return without_overlaps(longest(found.repartition(*keys), keys), keys)


def first_sheets(words: DataFrame, targets: DataFrame, key_of: Callable[[Column], Column]) -> DataFrame:
    """(name, sheet_id, word_no): the first sheet, by sheet_id, with a name of `targets` (name, key) as one or two words, and its first place there.

    `words` has sheet_id, word_no and text. At a place one word goes before two.
    """
    after = F.lead("text").over(Window.partitionBy("sheet_id").orderBy("word_no"))
    runs = F.array(F.struct(F.lit(1).alias("n"), F.col("text").alias("phrase")), F.struct(F.lit(2).alias("n"), F.concat_ws(" ", F.col("text"), F.col("_next")).alias("phrase")))
    placed = words.withColumn("_next", after).select("sheet_id", "word_no", "_next", F.explode(runs).alias("r")).where((F.col("r.n") == 1) | F.col("_next").isNotNull())
    keyed = placed.select("sheet_id", "word_no", F.col("r.n").alias("n"), key_of(F.col("r.phrase")).alias("key")).where(F.col("key") != "")
    best = keyed.groupBy("key").agg(F.min(F.struct("sheet_id", "word_no", "n")).alias("at"))  # before the join: names may be many, keys of sheets are few
    return targets.select("name", "key").join(best, "key").select("name", "at.sheet_id", "at.word_no", "at.n")
