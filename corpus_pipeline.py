"""From documents to token files: toxicity, near-duplicates, benchmark leaks, source mixture, packed ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run writes every stage's rows
and reads them back for the next. All but the last return the columns of documents; more columns pass through,
whatever their names. Null and empty texts, very long texts, ties, repeated rows and empty tables
are handled as each stage says; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, token_files, toxicity
from tessera.llm.common import OWN, documents, keep, table


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns that are named like operators' own set aside, and what gives docs' columns back."""
    names = {c: f"aside{i}_{c}" for i, c in enumerate(docs.columns) if c.startswith(OWN)}
    return docs.withColumnsRenamed(names), lambda out: out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, by a model fitted on docs' labelled rows.

    Null and empty texts are scored as texts without words, long ones whole; rows of equal text go or stay together.
    Without usable labels nothing goes.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    aside, back = _aside(docs)
    return back(toxicity.score(aside, model).filter(F.col(f"{OWN}score") < 0.5))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one of the least id, by a hash where that id has several rows.

    Texts without words are no duplicates of each other; rows without id all stay.
    """
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Null and empty texts overlap none; an empty benchmark removes nothing."""
    aside, back = _aside(docs)
    return back(decontaminate.find_leaks(aside, table(spark, sf_dir, "benchmark")).filter(F.size(f"{OWN}items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; the one at a source's cut keeps its first words.

    Documents without words go, as a mix of words takes none of them. Reruns agree.
    """
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and a digest of each document read back from them; repeated rows are rows here too."""
    import public_tokenizers

    return token_files.token_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixture", mix_sources),
    ("token_files", write_token_files),
]
#: Trees, signatures and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
