"""Corpus cleaning: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``; the last returns the
packed pieces.  Decisions:

1. language identification: rows without an accepted language go (declared language and source are evidence);
2. line dedup: repeated runs of lines and repeated one-line texts go; a row that loses its last word goes too;
3. Jaccard join (five-word shingles, 0.8): one row of each component stays;
4. benchmark decontamination: rows with a hit go;
5. best-fit packing into sequences of 2048 tokens.

Null texts pass stages 1 to 4 unless no language is accepted for them, and are packed as empty documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import import_path, keep, read_table
from plumbline.llm.decontamination import contamination
from plumbline.llm.jaccard_join import one_per_component
from plumbline.llm.language import identify
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.packing import packed_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import_path(spark)
    return identify(docs, declared=F.col("lang"), host=F.col("source")).where("accepted").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import_path(spark)
    found = dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.where(F.coalesce(~emptied, F.lit(True))).select(
        *[(F.when(F.col("n_removed_lines") > 0, new[x]).otherwise(F.col("row")[x]) if x in new else F.col("row")[x])
          .alias(x) for x in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import_path(spark)
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(docs, read_table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import_path(spark)
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_identification", language_identification),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Chunk boundaries, language models and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per packed piece."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
