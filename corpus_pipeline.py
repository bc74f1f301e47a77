"""The corpus pipeline: from ``documents`` to packed windows, a stage at a time.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's documents. Counted as part of sparkloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, lines, mixing, packing, simhash, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this folder's labels, doesn't reject.

    Null and empty texts stay; equal texts and repeated rows fare alike; texts are read whole; other columns pass through.
    An empty table, or too few labels, rejects nothing (with a warning).
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of lines that stand earlier in the corpus; documents of which nothing is left go.

    Near-duplicates count as versions of one document: cut to what the first of them lacks, the others would be fragments
    that resemble nothing, and the next stage couldn't find them. So a passage that first stands in one of them stays in
    all, and that stage removes them whole.

    Null and empty texts, and null ids, stay; repeated rows fare alike; texts are read whole; the order of ids, then text,
    then place settles which of equals is first; other columns pass through; an empty table gives an empty one.
    """
    return lines.drop_repeats(docs, same=simhash.groups(docs).withColumnRenamed("keeper", "grp"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Null ids and texts without a word (null, empty) stay; all rows of one id fare alike; texts are read whole; other
    columns pass through; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights of the root of their tokens, as many documents as that allows without repeats.

    A null source is a source, a null id hashes as ''; rows of one id fare alike; a document without tokens (null, empty)
    weighs nothing; texts are counted whole; other columns pass through; an empty table gives an empty one.
    """
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows that hold the sources in the proportions that mixing left.

    A null source is a queue, a null id a document; documents without tokens (null, empty) give no piece, repeated rows
    theirs each, long texts several; ties of the hash go by id, then length; an empty table gives no rows.
    """
    return packing.pack(docs, packing.WINDOW_TOKENS)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", repeated_lines_out),
    ("near_dedup", near_duplicates_out),
    ("mixing", mixed),
    ("packing", packed),
]

#: zstandard's lengths and SimHash can't be had in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
