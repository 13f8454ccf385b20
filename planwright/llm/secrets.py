"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of the rules below; a blob is scanned again when it changes.
RULE_VERSION = "1"

#: (kind, pattern, group that counts, least code points of that group), in listed order.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1),
    ("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{1,64}@", 0, 1),
]
SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"
#: Matches of one text that are placed together.
PLACED = 256


def _spans(text: Column, rank: int) -> Column:
    """Spans of one rule, in code points: gaps between matches and the matches themselves add up to the places.

    Matches are placed PLACED at a time, as an array that grows one by one is copied at each step.
    """
    kind, pattern, group, least = RULES[rank]
    gaps, found, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Lengths alone go into the fold, and as the variable of a lambda they are worked out once.
    lengths = lambda texts: F.transform(texts, F.char_length)
    matches = F.arrays_zip(lengths(found).alias("m"), lengths(value).alias("v"), F.slice(lengths(gaps), 1, F.size(found)).alias("g"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["m"]).alias("stop"))
        return F.struct((start + x["m"]).alias("at"), F.when(x["v"] >= least, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    def part(matches: Column, a: Column, k: Column) -> Column:
        first = F.struct(a["at"].alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.slice(matches, k * PLACED + 1, F.lit(PLACED)), first, step, lambda r: F.struct(r["at"].alias("at"), F.array_append(a["parts"], r["spans"]).alias("parts")))

    def place(matches: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
        parts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PLACED).cast("int"))
        return F.aggregate(parts, none, lambda a, k: part(matches, a, k), lambda a: F.flatten(a["parts"]))

    placed = F.get(F.transform(F.array(matches), place), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(F.array().cast(SPAN))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, spans) of (blob, text); spans by start, then kind as listed."""
    text = F.coalesce("text", F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(text, k) for k in range(len(RULES))]))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("spans"))


def unseen(versions: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """(blob, text): one row for each blob of `versions` that the ledger has not under this rule version.

    Which row stands for a blob is settled on hashes and ids alone, so a text with very many copies costs one
    small row per task. Texts then move once, dealt by row and not by blob; repeated rows meet in the same place.
    """
    keyed = versions.select(F.struct("path", "version").alias("at"), blob_id(F.col("text")).alias("blob"), "text")
    chosen = keyed.groupBy("blob").agg(F.min("at").alias("first"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        chosen = chosen.join(known, "blob", "left_anti")
    chosen = chosen.select(F.col("blob").alias("b"), "first")
    same = (F.col("at") == F.col("first")) & (F.col("blob") == F.col("b"))
    return keyed.join(chosen.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["at", "blob"]).select("blob", "text")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger rows to append for (path, version, text): blobs not seen yet under RULE_VERSION.

    Defined results: a null text is the empty blob; repeated rows and copies are scanned once; other columns
    are not read; empty tables add nothing.
    """
    return scan(unseen(versions, ledger))


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, version, blob, spans): what the ledger has, joined back to every path and historical version."""
    keyed = versions.select("path", "version", blob_id(F.col("text")).alias("blob"))
    known = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    return keyed.join(known, "blob", "left").select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
