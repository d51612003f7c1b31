"""Registered queries of the text operators over the generated tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import (chat, decontam, html, licenses, mixing, neardedup, periodic, quality, repair, secrets, substring,
                            tokens, toxicity)
from shelfsight.plans.execution import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark, sf_dir):
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    out = quality.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op5_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    count = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *count, F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


def op6_substrings(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


# A conversation that says control strings in every turn.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], talks.schema)
    return chat.read_back(chat.format_chats(talks.union(probe)))


def op8_html_text(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_token_shards(spark, sf_dir):
    """Writes the shards into the shared folder and reads them back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-shards/{uuid.uuid4().hex}"
    tokens.write_shards(table(spark, sf_dir, "documents"), path)
    return tokens.read_shards(spark, path).drop("ids")


# Mixing of the generated documents. The domain of a source is derived from
# its number; weights are shares of the budget among siblings, unnamed ones
# have weight 1.
MIX_LEVELS = ["domain", "lang", "source"]
DOMAINS = ("web", "books", "code", "talk")
MIX_WEIGHTS = [{"web": 4, "books": 3, "code": 2, "talk": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {"src0": 2}]
MIX_SEED, MIX_EPOCHS = 7, 2


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS int)")
    at = F.pmod(number, F.lit(len(DOMAINS)))
    return docs.withColumn("domain", F.element_at(F.array(*map(F.lit, DOMAINS)), at + 1))


def op10_mix(spark, sf_dir):
    """Half of all tokens, up to two epochs a source."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    out = mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, F.expr("total div 2"), MIX_SEED, MIX_EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", "mix_epoch",
                      mixing.n_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(periodic.plant(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_conversation_repair(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return repair.repaired(talks, repair.damage(talks))


def op13_toxicity(spark, sf_dir):
    """A fifth of the ids is held out of the fit; rows without an id are too."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_decontaminate, op3_licenses, op4_quality, op5_secrets,
                            op6_substrings, op7_chat_format, op8_html_text, op9_token_shards, op10_mix, op11_periodic_runs,
                            op12_conversation_repair, op13_toxicity)}
