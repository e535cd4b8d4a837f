"""Cleans and packs a corpus: toxic documents, repeated lines and near copies go, the rest is packed.

`STAGES` lists (name, function). Each function takes the session, the documents that the stage before it kept and the
folder of the tables, and returns what it keeps; `run` writes every result to the shared folder and
reads it again, so a lost executor repeats one stage at most. All stages but the last return the columns of documents.

Edge cases: a null text counts as empty in every stage, a null id is kept as it is, repeated rows are judged alike (of
rows with one text one stays, with or without an id), and an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayslice.llm import lines, near, packing, toxicity
from dayslice.llm.common import table
from dayslice.llm.queries import tokenizer_path
from dayslice.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep_text=True)
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share; n_chars follows the text."""
    rest = lines.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which none has a Jaccard similarity of five-word shingles of 0.8 or more to another that stays.

    In the order of ids a document goes if it is that similar to one that stays, so a chain of similar documents loses every second one and not
    all but its first. Pairs come from the search of SimHash fingerprints and every similarity is computed on the whole sets of shingles; see `near`.
    At a similarity of 0.8 two fingerprints differ in 10 bits on average, more than SimHash can search, so an exact join finds the pairs that it misses.

    Rows without an id come last in the order. Of rows with one set of shingles one stays, also where ids repeat or are null.
    """
    kept = near.keep(docs).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_kept"))
    marked = docs.withColumn("_mark", near.mark_of())
    single = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_kept")), "left_semi")
    one = Window.partitionBy("doc_id", "_mark").orderBy(F.xxhash64(*docs.columns))
    return single.withColumn("_place", F.row_number().over(one)).where("_place = 1").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash", drop_near_copies),
    ("best_fit", pack),
]
#: A classifier learned on the way cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
