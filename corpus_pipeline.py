"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``. Clean documents are kept: only texts
without any letter, boilerplate lines, all but one of each group of near copies, and documents that
hold a benchmark passage go.

Each stage judges rows, not ids: null and repeated ids, null languages and sources are kept as they are,
and rows that repeat are judged alike, except that near_dedup keeps one of them. Null, empty and
letterless texts go in language_id; a text that line_dedup leaves empty stays, and near_dedup takes all
such texts as one group. Ties go to the row of least id. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import bpe, decontam, langid, line_dedup, simhash
from loomstone.llm.common import load, materialize, remainder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: those without a letter, also where no language could be learned."""
    texts = langid.fit(docs.filter(remainder("doc_id", 4) != 2)) or {"unlabelled": " "}
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = langid.predict(docs.withColumn("__text", F.col("text")), texts, text_col="__text", keep=others)  # the text itself is kept as well
    return found.filter(F.col("lang_pred") != langid.NO_LANGUAGE).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the boilerplate lines of each source; ``n_chars`` follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the decoded bytes."""
    out = bpe.round_trip(docs, keep=("lang", "source", "n_chars"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL can express neither the automata nor the hashes of the stages.
ORACLE_SQL = None
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
