"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.conversation_repair import damaged, repair_conversations
from trackloom.llm.embedding_links import link_vectors
from trackloom.llm.language import held_out, identify_language
from trackloom.llm.minhash_join import near_duplicates
from trackloom.llm.oracles import QUALITY_SQL, REPAIR_SQL, VARIANT_SQL
from trackloom.llm.order_minhash import edited_fingerprints, fingerprint, likeness
from trackloom.llm.packing import pack_documents
from trackloom.llm.page_text import extract_pages
from trackloom.llm.pareto import PARETO_SQL, pareto_mix
from trackloom.llm.phrases import remove_repeats
from trackloom.llm.pii import find_personal_data
from trackloom.llm.quality_ratio import filter_quality
from trackloom.llm.secret_scan import count_kind, find_secrets, joined
from trackloom.llm.spelling import spelling_variants
from trackloom.session import configure


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_tag_path_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(_table(spark, folder, "pages"))


def op2_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(_table(spark, folder, "embeddings"))


def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint("signature").alias("fingerprint"), fingerprint("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"))


def op4_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_with_checks(pack_documents(_table(spark, folder, "documents")))


def pieces_with_checks(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op5_repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    stripped = remove_repeats(_table(spark, folder, "documents"))
    return stripped.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85)


def op7_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = pareto_mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_pii_skip_chain(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    learn = docs.filter("doc_id IS NOT NULL").filter(~held_out("doc_id"))
    found = identify_language(docs, learn)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_secret_markov(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_lightest_repair(spark: SparkSession, folder: str) -> DataFrame:
    repaired = repair_conversations(damaged(_table(spark, folder, "conversations")))
    return repaired.withColumnRenamed("conv", "conv_id").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    judged = filter_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op13_bit_sliced_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(_table(spark, folder, "documents"))


QUERIES = {
    "op1_tag_path_text": op1_tag_path_text,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_order_minhash": op3_order_minhash,
    "op4_cost_packing": op4_cost_packing,
    "op5_repeated_phrases": op5_repeated_phrases,
    "op6_minhash_join": op6_minhash_join,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_pii_skip_chain": op8_pii_skip_chain,
    "op9_language_codes": op9_language_codes,
    "op10_secret_markov": op10_secret_markov,
    "op11_lightest_repair": op11_lightest_repair,
    "op12_ngram_ratio": op12_ngram_ratio,
    "op13_bit_sliced_variants": op13_bit_sliced_variants,
}

SQL: dict[str, str] = {
    "op7_pareto_mix": PARETO_SQL,
    "op11_lightest_repair": REPAIR_SQL,
    "op12_ngram_ratio": QUALITY_SQL,
    "op13_bit_sliced_variants": VARIANT_SQL,
}
