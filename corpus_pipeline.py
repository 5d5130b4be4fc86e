"""A corpus pipeline of five of the operators: from raw documents to training tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's input. ``run`` does so in the shared folder and
deletes each table once the next is there.

Defined results: rows with null or empty text fail the base rules and go with
the first stage; a null id, language or source is a value of its own; of
repeated rows, which are copies of each other, line_dedup takes the lines from
none (they count as one document) and near_dedup keeps one; ties go to the
smaller id; texts of any length are read whole; further columns are carried
along up to the last stage, whatever their names, but for ``copy`` (ValueError,
see mixing); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweir.llm import line_dedup, mixing, near_dedup, quality, sentencepiece_codec
from tallyweir.llm._common import Scratch, read_table, stage
from tallyweir.llm.queries import piece_model

#: Percent of their lines that near copies of a whole document share.
COPIES = 70


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution test reject go."""
    return quality.keep_good(docs)


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines the first stays; documents that no longer pass the base rules without the others go.

    Near copies of a whole document keep the lines that it keeps, so that the
    next stage finds both.
    """
    return line_dedup.keep_first_lines(docs, copies=COPIES, still=quality.passes_base)


def near_dup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity 0.8."""
    return near_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources move towards equal shares by Poisson replication; rows come out shuffled."""
    return mixing.replicate(docs).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with digests of ids, decoded text and spans."""
    return sentencepiece_codec.token_digests(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", fuzzy_line_dedup),
    ("near_dedup", near_dup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot train references, merge ranks or decode. The pipeline's rows are not compared with plain Python: its test
#: looks at the columns, at whether each stage keeps rows and at the last stage's count.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, function in STAGES[:-1]:
            before, docs = docs, scratch.stage(function(spark, docs, sf_dir), name)
            scratch.drop(before)
        name, function = STAGES[-1]
        return stage(function(spark, docs, sf_dir), f"pipeline-{name}")
