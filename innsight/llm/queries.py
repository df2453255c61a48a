"""The registered queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import alignment, bpe, chat, gam, license_scan, merkle, minhash, order_minhash, packing, quality, secret_scan, token_count, warc
from innsight.llm.common import table, work_path


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, "text", ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back, in the global order of their capture histories."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.captures(pages, work_path(spark, "warc"))
    return index.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        "record_type", "refers_to", "url_key", "capture_order")


ADDED_CHAT = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its formatted text parses to."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(ADDED_CHAT))
    chats = chat.format_chats(rows).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "similarity")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how alike it is to its edited text's and to the next document's."""
    return order_minhash.edited_by_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of unigram tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


# Target shares of the tokens of a window; the other sources share the rest as they come.
MIXTURE = {"src0": 0.15, "src1": 0.10, "src2": 0.05, "src3": 0.02}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by deficit round-robin over their sources to the target mixture; one row per piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window")


def _span_list(kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans (of these kinds), comma-joined."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(_span_list(base), 256).alias("base_sha256"),
                        _span_list().alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is, and those that its lines name."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, the base rules' verdict and the label model's of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, _model = quality.score(docs, keep_text=False)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "quality")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels of the rows that are not held out."""
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether the possibly tampered document still proves the root."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups under two tokenizers, and what the corpus's link counts say about it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                           keep_groups=False)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_chat_format": op2_chat_format,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_order_minhash": op4_order_minhash,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE: dict[str, str] = {
    "op2_chat_format": chat.duckdb_sql(
        "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' "
        "FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)"),
    "op9_license_scan": license_scan.duckdb_sql(),
    "op12_merkle_manifest": merkle.duckdb_sql(),
}
