"""Quality rules: per-text rules, then cross-document line frequency per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.llm.text import ASCII_SPACE, SPACED_WORD, fingerprint, joined_runs, kept_runs, lower_ascii, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line goes if more documents of its host than this hold it ...
LINE_DOCS = 20
#: ... and more than this share of the host's documents.
LINE_SHARE = 0.001
#: A document is depleted if fewer words are left, or a smaller share of its words.
LEFT_WORDS = 10
LEFT_SHARE = 0.2


def with_repeat_words(docs: DataFrame, w: str, name: str, size: int = 5) -> DataFrame:
    """Adds `name`: the words inside windows of `size` words that occur twice or more in the array column `w`.

    Equal hashes are neighbours once sorted with their places; the places of those are then merged in order.
    Each step is a column of its own, as an expression inside a lambda is computed anew for every element.
    """
    n, none = F.size(w), F.array().cast("array<long>")
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    out = docs.withColumn("_h", F.when(n >= size, hashes).otherwise(none))
    unique = F.size(F.array_distinct("_h")) == F.size("_h")
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_o", F.when(unique, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs))
    same = lambda k, other: F.get("_o", k)["h"] == F.get("_o", other)["h"]
    twice = F.filter(
        F.transform("_o", lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])),
        lambda i: i.isNotNull(),
    )
    merged = F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + size - F.greatest(i, a["end"])).alias("n"), (i + size).alias("end")),
        lambda a: a["n"],
    )
    return out.withColumn(name, merged.cast("long")).drop("_h", "_o")


def text_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, ASCII_SPACE, "")) > 0)
    out = docs.withColumn("_w", words(F.col("text"), SPACED_WORD)).withColumn("_lines", worded)
    out = with_repeat_words(out, "_w", "n_repeat_words").withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_w", "_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_key(line: Column) -> Column:
    """Normalised line: no white space at the ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def frequent_lines(docs: DataFrame, host: str = "source", count_copies: bool = False) -> DataFrame:
    """(host, h1, h2): lines that too many documents of a host hold.

    Documents with the same lines in the same order count once, as holders of a line and among the host's documents
    alike: copies of one text are no sign of boilerplate, and what to do with them is for deduplication to say. With
    count_copies each doc_id counts. All others count, whatever lines they share. Each document sends each of its lines
    once, as two 64-bit hashes, and a mark that stands for itself; both aggregations combine on the map side, so a line
    that a third of the documents hold moves as one row per task and counted document.
    """
    keys = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key), lambda x: x != "")
    hashed = F.transform("keys", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    doc = F.xxhash64("doc_id", "keys") if count_copies else F.xxhash64("keys")
    mark = F.array(F.struct(F.lit(None).cast("bigint").alias("h1"), F.lit(None).cast("bigint").alias("h2")))
    # All of a document's own is made before its lines are explode()d, as what stands beside explode() is made for each line;
    # the outer form, as the plain one would have the lines made once more for a filter. The mark makes it the same.
    held = docs.select(F.col(host).alias("host"), *(["doc_id"] if count_copies else []), keys.alias("keys"))
    held = held.select("host", doc.alias("doc"), F.concat(mark, F.array_distinct(hashed)).alias("ls"))
    each = held.select("host", "doc", F.explode_outer("ls").alias("l"))
    lines = each.select("host", "doc", "l.h1", "l.h2").distinct()
    # The mark is told by an aggregate, so that both uses of these counts read one shuffle.
    counts = lines.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("h1").isNull()).alias("is_mark"))
    sizes = counts.where("is_mark").select(F.col("host").alias("size_host"), F.col("n").alias("n_docs"))
    often = counts.where(~F.col("is_mark") & (F.col("n") > LINE_DOCS))
    over = often.join(sizes, F.col("host").eqNullSafe(F.col("size_host"))).where(F.col("n") > LINE_SHARE * F.col("n_docs"))
    return over.select("host", "h1", "h2")


def line_removals(docs: DataFrame, host: str = "source", count_copies: bool = False) -> DataFrame:
    """(doc_id, fp, removed): the 0-based numbers of lines above the limits, for documents that have any."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    # Made before the lines are explode()d, and in the outer form: see frequent_lines(). A text has a line at least.
    held = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.col(host).alias("host"), keys.alias("keys"))
    lines = held.select("doc_id", "fp", "host", F.posexplode_outer("keys").alias("pos", "key"))
    lines = lines.where(F.col("key") != "").select("doc_id", "fp", "host", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    over = frequent_lines(docs, host, count_copies).select(F.col("host").alias("over_host"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    bad = lines.join(over, F.col("host").eqNullSafe(F.col("over_host")) & (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left_semi")
    return bad.groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("removed"))


def quality_rules(docs: DataFrame, host: str = "source", keep_text: bool = False, count_copies: bool = False) -> DataFrame:
    """A row per row of `docs`: figures of its text and whether it is kept.

    Columns: those of `docs` if keep_text (`text` then lacks the removed lines and n_chars follows), else
    doc_id; and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
    n_left_words, kept. Columns of `docs` named like one of these are replaced. Defined results: a null text
    has no words and fails; a null host is a host of its own; repeated rows each get the result of their text
    (removals are those of the hosts of all rows with that id and text); an empty table gives no rows. count_copies
    says whether copies of one text in a host count as often as they occur, or once: see frequent_lines().
    """
    extra = ["lang", "source", "n_chars"]
    names = docs.columns if keep_text else list(dict.fromkeys(["doc_id", "text"] + [c for c in docs.columns if c in extra or c == host]))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "kept"]
    docs = docs.select(*[c for c in names if c not in new])
    gone = line_removals(docs, host, count_copies).select(F.col("doc_id").alias("_gone_id"), F.col("fp").alias("_gone_fp"), "removed")
    body = docs if keep_text else docs.select("doc_id", "text")
    rules = text_rules(body).withColumn("_fp", fingerprint(F.col("text")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # Words of each line travel instead of the text where the text is not asked for.
    # With a row number in it, a condition on `kept` stays above these columns and is not worked out from the text again.
    rules = rules.withColumn("_row", F.monotonically_increasing_id()).withColumn("_per_line", F.transform(lines, lambda x: F.size(words(x, SPACED_WORD))))
    rules = rules if keep_text else rules.drop("text")
    joined = rules.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp")), "left")
    lost = F.aggregate(F.coalesce("removed", F.array().cast("array<int>")), F.lit(0), lambda a, i: a + F.get("_per_line", i))
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    joined = joined.withColumns({"n_removed_lines": n_removed.cast("long"), "n_left_words": F.col("n_words") - lost})
    depleted = (F.col("n_removed_lines") > 0) & ((F.col("n_left_words") < LEFT_WORDS) | (F.col("n_left_words") < LEFT_SHARE * F.col("n_words")))
    joined = joined.withColumn("kept", (F.col("_row") >= 0) & ~F.col("base_failed") & ~depleted)
    if keep_text:
        joined = joined.withColumn("_l", F.when(F.col("removed").isNotNull(), lines))
        rest = joined_runs("_l", kept_runs(F.array_sort("removed"), F.size("_l")))
        joined = joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest))
        if "n_chars" in joined.columns:
            joined = joined.withColumn("n_chars", F.char_length("text").cast("long"))
    keep = docs.columns if keep_text else ["doc_id"]
    return joined.select(*keep, *new)
