"""Training-data pipeline over ``documents``: quality, near copies, test items, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstream.llm import decontamination, mixing, ngram_join, quality, sharding
from lexstream.llm.common import Scratch, fresh, table

#: Weights of the domains good, low and toxic in the mix.
MIX = (0.99, 0.0, 0.01)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half; the classifier learns from the labels of two thirds of the ids.

    Null and empty texts are judged as texts without words, equal texts alike; no rows give no rows.
    """
    network = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.accepted(docs, network)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 on five-word shingles.

    Null, empty and blank texts are like nothing and stay; of equal rows one stays; no rows give no rows.
    """
    return ngram_join.without_near_copies(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that match ten words of a test item go, and so do documents hit in more than one word of a hundred.

    ``n_chars`` follows the text where spans went.  Null and empty texts are not hit; no rows give no rows.
    """
    columns, before = docs.columns, fresh(docs, "before")
    cut = decontamination.decontaminated(docs.withColumn(before, F.length("text")), table(spark, sf_dir, "benchmark"), max_coverage=0.01)
    gone = F.coalesce(F.col(before) - F.length("text"), F.lit(0))
    chars = F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", chars).select(*columns)


def mixed_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate tells, so that domain tokens meet the target weights.

    Texts of low quality went in the first stage, so the mix asks for good and toxic ones only.  Null and empty texts
    follow the rate of the prior, equal rows their common rate; no rows give no rows.
    """
    membership, steps, _, _ = mixing.fitted(docs, table(spark, sf_dir, "labels"), MIX)
    return mixing.mixed(docs, membership, steps)


def shuffled_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents with their shard and their slot in it; null ids and texts have a place as well."""
    return sharding.two_pass_shards(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", no_test_items),
    ("target_weight_mixing", mixed_domains),
    ("sharding", shuffled_shards),
]

#: A trained classifier and a seeded shuffle have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read by the next."""
    steps = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, steps.put(stage(spark, docs, sf_dir))
        steps.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
