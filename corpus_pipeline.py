"""Documents to token ids: language, near duplicates, personal data, mixture, byte-level BPE.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows that its predecessor kept. All but the last return
the columns of ``documents``; ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import bpe, languages, mixing, near_duplicates, pii
from fluxloom.llm.common import bounded_batches, single_threaded, table
from fluxloom.session import settle, settle_alone, ship_package

# SQL has neither random vectors, alignments, random fields nor byte pair merges.
ORACLE_SQL = None


def _prepare(spark: SparkSession) -> None:
    single_threaded()
    bounded_batches(spark)
    ship_package(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages that the labelled rows teach. Texts without a letter go, and those that are less like their
    language than texts of their length are."""
    _prepare(spark)
    return languages.known(docs, languages.learn(docs)).filter("known").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of every class of near duplicates."""
    _prepare(spark)
    return near_duplicates.representatives(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every span of personal data replaced by its kind."""
    _prepare(spark)
    found = pii.detect(docs)
    columns = [F.col("redacted").alias(c) if c == "text" else
               F.length("redacted").cast(found.schema["row"].dataType["n_chars"].dataType).alias(c) if c == "n_chars" else
               F.col(f"row.{c}") for c in docs.columns]
    return found.select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them, shard by shard in shuffled order."""
    _prepare(spark)
    return mixing.mix(docs).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ids, and the text that the ids decode to."""
    _prepare(spark)
    vocab = bpe.public_vocabulary()
    # Written between, so that a task feeds one Python worker and not two at once, which would then stay with the executor.
    found = bpe.decode(settle(bpe.encode(docs, vocab), "ids"), vocab)
    return found.select("row.*", F.decode("bytes", "UTF-8").alias("text"), "ids",
                        F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("language identification", known_language),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("mixture", mixed),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def after(stages: list) -> DataFrame:
        """What the last of the stages returns. A written stage leaves nothing behind that only it has read."""
        *earlier, (_, stage) = stages
        docs = settle_alone(spark, lambda: after(earlier), "stage") if earlier else table(spark, sf_dir, "documents")
        return stage(spark, docs, sf_dir)

    return after(STAGES)
