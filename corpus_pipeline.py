"""A training-data pipeline over ``documents`` built from the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common, decontaminate, mixing, simhash, tokenpack, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier scores at 0.5 or more."""
    return toxicity.accept(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id.

    Rows that share a doc_id are of one group only if their texts are near
    copies; of equal rows one stays. Rows with a null doc_id belong to no group
    and all stay."""
    named = docs.where("doc_id is not null")
    kept_id, kept_hash, row = common.unused("id", "hash", "row")
    kept = simhash.representatives(named).select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    whole = named.join(kept, (F.col("doc_id") == F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_hash)))
    columns = common.quoted(docs.columns)
    unordered = [c for c, (_, kind) in zip(columns, docs.dtypes) if "map<" in kind or "variant" in kind]
    if unordered:  # such columns are ordered by their JSON
        order = F.struct(*[F.to_json(F.struct(c)) if c in unordered else F.col(c) for c in columns])
        least = F.min_by(F.struct(*columns), order)
    else:
        least = F.min(F.struct(*columns))
    first = whole.groupBy(kept_id, kept_hash).agg(least.alias(row)).select(f"{row}.*")
    return first.union(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix of sources takes it."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its documents: doc_id, start, n_tokens, ids_crc32."""
    path = common.scratch_path(spark, "pipeline-tokens")
    tokenpack.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenpack.summary(spark, path)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_packing", packed),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each over all that the one before kept."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = common.scratch_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
