"""Training-corpus pipeline: quality rules, near-duplicates, decontamination,
secrets, tokens.

Every stage reads its predecessor's Parquet, under the shared checkpoint folder,
so a lost executor repeats tasks of one stage only. All stages but the last keep
the columns of ``documents``; rows are judged each, also those that share an id
or have none (which the near-duplicate stage keeps), and ``n_chars`` stays what
the source stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontaminate, near_dup, quality, secrets
from cairn.llm.common import release, scratch_scope, scratch_table
from cairn.llm.queries import vocabulary
from cairn.plans.views import table

# A text goes if more than this share of its words stands in test items.
MAX_COVERAGE = 0.5
# Texts are near-duplicates from this similarity of their five-word sets on (percent).
MIN_SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.filtered(docs, threshold=MIN_SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=MAX_COVERAGE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digest of every text that is left."""
    return bpe.round_trip_digest(docs, vocabulary(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's scratch tables go when its rows are
    written, its input when its successor's rows are."""
    docs = table(spark, sf_dir, "documents")
    *first, (last, tail) = STAGES
    with scratch_scope():
        for name, stage in first:
            before = docs
            with scratch_scope():
                docs = scratch_table(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
            release(before)
        return scratch_table(tail(spark, docs, sf_dir), last, keep=True)


# SQL cannot express byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {}
