"""Named queries over training examples: encoding, the mask's proofs, and the trainer's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encoding as N
from tessera.plans import views
from tessera.plans.catalogue import _steps, query
from tessera.plans.catalogue import tiers as tier_rows
from tessera.plans.views import table
from tessera.session import shared_folder
from tessera.sources import tensors

MAX_LEN = 3072


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def history(spark, d):
    """Episodes as conversations: the question, then each recorded turn and what the environment answered, with their tier."""
    start = views.tasks(spark, d).select(F.col("ep").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("Question: "), "task_id").alias("text"))
    steps = _steps(spark, d).join(views.turns(spark, d), ["ep", "t"])
    said = steps.select(F.col("ep").alias("conv_id"), (2 * F.col("t") - 1).alias("turn"), F.lit("assistant").alias("role"), "text")
    unread = F.when(F.col("parse_ok"), F.col("obs")).otherwise(F.concat(F.lit(N.REJECTED), F.lit(" unknown or unparsed action.")))
    seen = steps.filter("name is null or name <> 'answer'").select(F.col("ep").alias("conv_id"), (2 * F.col("t")).alias("turn"), F.lit("user").alias("role"), unread.alias("text"))
    tier = tier_rows(spark, d).select(F.col("ep").alias("conv_id"), "tier")
    turns = start.unionByName(said.withColumn("turn", F.col("turn").cast("long"))).unionByName(seen.withColumn("turn", F.col("turn").cast("long")))
    return turns.join(tier, "conv_id").withColumn("skip_final", F.col("tier") == "B")


def _digest(rows):
    crc = lambda c: F.crc32(F.array_join(c, ",").cast("binary")).alias(f"{c}_crc32")
    return rows.select("conv_id", "outcome", "n_tokens", "n_graded", "n_spans", "n_mismatched", "n_rejected", F.array_join("findings", ",").alias("findings"), crc("input_ids"), crc("labels"))


@query()
def sft_encode(spark, d):
    return _digest(N.encode(table(spark, d, "conversations"), vocabulary(), MAX_LEN))


@query()
def sft_encode_episodes(spark, d):
    return _digest(N.encode(history(spark, d), vocabulary(), MAX_LEN))


@query()
def sft_outcomes(spark, d):
    """Of tier A and B episodes, as a training set is built: how many are kept, and their shape."""
    return N.outcomes(N.encode(history(spark, d).filter("tier in ('A', 'B')"), vocabulary(), MAX_LEN))


def _written(spark, d):
    examples = N.encode(table(spark, d, "conversations"), vocabulary(), MAX_LEN).filter(F.col("outcome") == N.ENCODED)
    config = {"tokenizer": "byte_bpe_50k.json", "max_len": MAX_LEN, "end_of_turn_graded": True}
    return tensors.write_examples(examples.select("conv_id", "input_ids", "labels", "n_spans", "n_rejected"), shared_folder(spark, "examples"), config)


@query()
def sft_tensor_rows(spark, d):
    return tensors.batch_digests(_written(spark, d)).drop("file")


@query()
def sft_padding(spark, d):
    return tensors.padding(_written(spark, d))
