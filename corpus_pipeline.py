"""From raw documents to token shards: five stages, each written as Parquet
and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import decontam, mixing, neardedup, quality, queries, tokens
from shelfsight.llm.common import written
from shelfsight.plans.execution import ensure_checkpoint_dir


# The number of a row in the written input of a stage: rows are judged one by
# one, whatever their doc_ids.
ROW = "no"


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, ROW): the rows of ``docs`` as one column, whatever theirs are
    called, and their numbers; written, so that every reader sees the same."""
    return written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                               F.monotonically_increasing_id().alias(ROW)))


def _rows(numbered: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` again."""
    return numbered.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every rule. A row is judged by its own text."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: that with the smallest doc_id (a
    NULL one last), and of its repeats the first. Rows are grouped by their
    texts alone; a text without words is in a group with its id's like rows
    only, and by itself without an id."""
    rows = _numbered(docs)
    judged = neardedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "row.text"))
    group = judged.select(F.col("doc_id").alias(ROW), (F.col("n_shingles") > 0).alias("words"), "component_id")
    ids = rows.select(ROW, F.col("row.doc_id").alias("id"))
    group = group.join(ids, ROW).select(
        ROW, "id", "words", F.when(F.col("words") | F.col("id").isNull(), F.col("component_id")).otherwise(F.col("id")).alias("group"),
        (~F.col("words") & F.col("id").isNull()).alias("alone"))
    first = group.groupBy("group", "words", "alone").agg(
        F.min(F.struct(F.col("id").isNull(), "id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return _rows(rows.join(first, ROW, "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark, each judged by its
    own text."""
    rows = _numbered(docs)
    judged = decontam.find_contamination(rows.select(F.col(ROW).alias("doc_id"), "row.text"),
                                         queries.table(spark, sf_dir, "benchmark"))
    return _rows(rows.join(judged.where("contaminated").select(F.col("doc_id").alias(ROW)), ROW, "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, shared over domains, languages and sources."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", "text", "lang", "source")
    picked = mixing.mix(queries.with_domain(whole), queries.MIX_LEVELS, queries.MIX_WEIGHTS, F.expr("total div 2"),
                        queries.MIX_SEED)
    return picked.select(*(F.col(f"row.`{c}`").alias(c) for c in names))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards and returns their records."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-shards/{uuid.uuid4().hex}"
    tokens.write_shards(docs, path)
    return tokens.read_shards(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token shards", token_shards),
]

# The tokenizer of the last stage has no SQL form; tests compare the stages
# with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
