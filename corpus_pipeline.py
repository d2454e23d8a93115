"""A training corpus from raw documents: quality, near copies, personal data, mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of the documents.  ``run`` writes every stage's rows
and reads them again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.bpe import bpe_encode
from trialsift.llm.common import quoted, table
from trialsift.llm.minhash import keep_one
from trialsift.llm.mixing import mix
from trialsift.llm.pii import find_pii, fit_detector, redact
from trialsift.llm.quality import reject_outliers
from trialsift.llm.tokenizer_files import WORD_BPE
from trialsift.session import scratch_path, ship_self


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    ship_self(spark)
    judged = reject_outliers(docs)
    return judged.where("kept").select(*[quoted(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_self(spark)
    return keep_one(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    ship_self(spark)
    clean = redact(find_pii(docs, fit_detector(docs)))
    # The number of characters follows the text where the documents have it.
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[quoted(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_self(spark)
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with digests of ids and decoded text."""
    ship_self(spark)
    coded = bpe_encode(docs, WORD_BPE())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; digests of the result, one row per document."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Robust estimates, sketches and boosted trees have no form in SQL; tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
