"""Queries of the text operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import chat, decontamination, html_text, jaccard, line_dedup, pii, prefix_trie, quality, secrets, sentencepiece_lattice, token_counts, vector_codes, warc
from planwright.session import materialize, work_dir
from planwright.sources.tables import table

#: A key for the driver's synthetic tables; real ones come from the caller's key store.
PII_KEY = "synthetic-tables"
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabulary splits text before merging.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", F.aggregate("pii", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_found"), "pii", "text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, taken in by two rounds: the second one scans only blobs that the ledger of the first has not."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    early = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    known = materialize(secrets.update_ledger(versions.where(early)), "secret-ledger")
    new = materialize(secrets.update_ledger(versions.where(~early), known), "secret-ledger")
    ledger = known.unionByName(new)
    found = secrets.findings(versions, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    """Counts before and after an edit in the middle of each text: five characters make way for ` [edited]`."""
    vocabulary = f"{tokenizers or TOKENIZERS}/byte_bpe_50k.tiktoken"
    docs = table(spark, sf_dir, "documents")
    trees = token_counts.with_trees(docs, vocabulary, BYTE_BPE_PATTERN)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edit = F.struct(F.lit(0).alias("seq"), half.alias("start"), (half + 5).alias("stop"), F.lit(" [edited]").alias("new"))
    before = trees.withColumn("edits", F.array(edit)).withColumn("doc_id", F.struct("doc_id", "n_tokens"))
    after = token_counts.recount(before, None, vocabulary, BYTE_BPE_PATTERN)
    return after.select("doc_id.doc_id", "doc_id.n_tokens", F.col("n_tokens").alias("n_tokens_after"), F.size("leaf_tokens").cast("long").alias("n_leaves"), "n_encoded")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = materialize(warc.write_shards(table(spark, sf_dir, "pages"), folder), "warc-manifest")
    return warc.read_shards(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizers)


def encoded(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes (characters' bytes without a piece), ids and whether they decode to the text."""
    pieces = sentencepiece_lattice.piece_rows(f"{tokenizers or TOKENIZERS}/piece_bpe_32k.model")
    byte_ids = [r[0] for r in pieces if r[3]]
    out = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs.select("doc_id", "text"), pieces), pieces)
    n_bytes = F.size(F.filter("ids", lambda i: i.between(min(byte_ids), max(byte_ids)))).cast("long")
    back = F.translate(F.coalesce("text", F.lit("")), sentencepiece_lattice.SPACE, " ") == F.col("decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), n_bytes.alias("n_bytes"), "ids", back.alias("round_trip"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The conversation added to those of the table: it says the template's own marks.
MARKS_SAID = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(MARKS_SAID, rows.schema))
    return chat.read_back(chat.format_conversations(rows))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_errors(materialize(codes, "vector-errors"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_html_text": op10_html_text,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}
