"""A training-data pipeline: language identification, line dedup, near
duplicates, benchmark decontamination and packing, each stage on all that its
predecessor kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and
gives a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last give the columns of `docs`.

Defined results, in every stage: null texts are empty ones; repeated rows are
rows of their own; columns beyond doc_id and text are carried, whatever their
names; empty tables give no rows.  Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, rows_of, table, written
from codeaudit.llm.decontaminate import decontaminate
from codeaudit.llm.jaccard import jaccard_components
from codeaudit.llm.language import fit, keep_known
from codeaudit.llm.lines import dedup_lines
from codeaudit.llm.packing import encode, pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null, empty, digits alone) go; those of several
    languages stay.  Ties between languages decide nothing here."""
    return keep_known(docs, fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; documents of which nothing
    stays go with them.  Of equal windows the first by doc_id stays, null ids
    come last; null and empty texts have no windows and stay."""
    made = "line_dedup"
    while made in docs.columns:
        made += "_"
    d = dedup_lines(docs, out=made)
    d = d.filter((F.col(f"{made}.n_removed") == 0) | F.col("text").rlike("\\S")).drop(made)
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else d


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, 0.8 or
    more) stays, that of the smallest doc_id, of equal ids one; texts without
    words are like no other."""
    rows = rows_of(docs)
    found = jaccard_components(rows.select(ROW, "d.doc_id", "d.text"), shingle=5, percent=80, row=ROW)
    return rows.join(found.filter(F.col(ROW) == F.col("component_row")).select(ROW), ROW, "left_semi").select("d.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of
    a shorter one, go."""
    rows = rows_of(docs)
    found = decontaminate(rows.select(ROW, "d.doc_id", "d.text"), table(spark, sf_dir, "benchmark"), row=ROW)
    return rows.join(found.filter("n_hit > 0").select(ROW), ROW, "left_anti").select("d.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token ids with their sequence and place."""
    return pack(docs, encode)


STAGES = [("language", language), ("lines", lines), ("near", near), ("clean", clean), ("packed", packed)]

#: Learned labels, graph components and a search have no SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
