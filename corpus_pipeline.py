"""From raw documents to token ids: five stages, each one operator of ``packlens.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

SQL can't express a trained classifier, SimHash groups or BPE, so ``ORACLE_SQL``
is None; tests/llm checks the stages against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.bpe import bpe_tokens, default_vocabulary
from packlens.llm.common import materialize, read_table
from packlens.llm.mixing import apply_mix
from packlens.llm.quality import judge
from packlens.llm.simhash import drop_near_duplicates
from packlens.llm.substrings import dedup_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    used = ["doc_id", "text", "source", "lang"]
    others = F.struct(F.lit(0).alias("_packlens_none"), *[c for c in docs.columns if c not in used])  # out of the way of the classifier's own columns
    judged = judge(docs.select(*used, others.alias("_packlens_others")), read_table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.where("_keep").select(*[F.col(c) if c in used else F.col(f"_packlens_others.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out; ``n_chars`` follows the text."""
    cut = dedup_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return apply_mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return bpe_tokens(docs, default_vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
