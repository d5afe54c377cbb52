"""A corpus from raw documents: language, near copies, secrets, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of ``documents``; ``run`` writes each result as
Parquet in the shared checkpoint folder and reads it again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.language import UNDETERMINED, identify_language
from trackloom.llm.minhash_join import near_duplicates
from trackloom.llm.packing import pack_documents
from trackloom.llm.pareto import pareto_mix
from trackloom.llm.secret_scan import find_secrets, redacted
from trackloom.session import checkpoint_folder, configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document goes if no language is found or the decoding cannot tell two apart.
AMBIGUOUS = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; what has no letter or an ambiguous codeword goes.

    The language found replaces a missing ``lang``. Rows without an id are kept as well.
    """
    configure(spark)
    found = identify_language(docs, ambiguous=AMBIGUOUS, keep=COLUMNS)
    found = found.filter(~F.col("ambiguous") & (F.col("lang_pred") != UNDETERMINED))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id.

    Of rows that share an id one stays as well. Rows without an id or a word all stay.
    """
    configure(spark)
    groups = near_duplicates(docs, shingle=5, percent=80)
    kept = groups.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(*COLUMNS)
    # Rows with one id: the first by content. They are combined before they are shuffled,
    # and the shuffle serves the join with the ids that stay.
    named = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    named = named.join(kept, "doc_id", "left_semi").select("doc_id", "row.*")
    return named.unionByName(rows.filter("doc_id IS NULL")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced and n_chars follows the new text."""
    configure(spark)
    found = find_secrets(docs, keep=COLUMNS)
    text = redacted(F.col("text"), F.col("spans"))
    changed = F.size("spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(
        F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it, so rows go, stay or are repeated."""
    configure(spark)
    mixed = pareto_mix(docs).filter("copies > 0")
    times = F.sequence(F.lit(1), F.col("copies"))
    return mixed.withColumn("copy", F.explode(times)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; see trackloom.llm.packing."""
    configure(spark)
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", keep_known_language),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

# Language models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
