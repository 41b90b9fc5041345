"""One thin query for each operator: it reads the given tables and returns the operator's rows as its contract asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import audit, bpe, chat, chunks, decontaminate, langid, lines, pieces, prefixes, quality, simhash, topk, wavelet
from concord.llm.common import table

__all__ = [
    "op1_language_id",
    "op2_benchmark_decontamination",
    "op3_chat_formatting",
    "op4_substring_dedup",
    "op5_exact_top_k",
    "op6_line_dedup",
    "op7_token_shards",
    "op8_sentencepiece",
    "op9_simhash_near_dedup",
    "op10_quality_classifier",
    "op11_filter_audit",
    "op12_bpe",
    "op13_conversation_trie",
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Rows with a null doc_id are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    learned = langid.train(docs.select("doc_id", "text", "lang").filter(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = decontaminate.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the examples.
    formatted_chars counts all examples of a conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, text)
    return chat.read_back(chat.expand(rows.unionByName(extra)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id of every passage of over 50 words that documents share."""
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of all other rows for each row whose vec_id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and the digest and length of what stays, of every document."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.length("text").cast("long").alias("kept_chars"),
    )


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files."""
    folder = wavelet.new_folder(spark)
    shards = wavelet.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return wavelet.read(shards, folder)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, lossless of every document. The model file ranks its pieces and has
    no probabilities; a piece of rank r weighs 1 / (r + pieces.RANK_SHIFT)."""
    return pieces.round_trip(table(spark, sf_dir, "documents")).drop("ids")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (of bad) and rejected of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, scorer).select("doc_id", F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and what each step of each order of the five filters keeps, removes and costs."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    found = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the
    rebuilt conversations' prefix trie."""
    return prefixes.rebuilt_trie(table(spark, sf_dir, "conversations"))
