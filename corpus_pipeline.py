"""The corpus pipeline: language ID, near-duplicate removal, removal of repeated passages, secret masking, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import stored, table
from quarrykit.llm.jaccard_join import one_of_each
from quarrykit.llm.language_id import fit, recognised
from quarrykit.llm.packing import pack_documents
from quarrykit.llm.secret_scan import mask_secrets
from quarrykit.llm.suffix_dedup import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that labelled documents teach. Null and empty texts, texts without a letter and those without
    an n-gram of such a language go, and so do longer ones of which it has too few. All rows of a text share its
    fate, whatever their ids; with no label to learn from, or an empty table, nothing is left. Columns that are named
    as the operator's own stay as they are."""
    return recognised(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8. Repeated rows
    count as copies; null ids come after all others, and one row of a group of them stays as well; rows without
    words all stay; texts of any length are taken whole."""
    return one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of more than 50 words (or 400 bytes) that occur elsewhere too out of the texts, all of their places. Null texts and
    all rows stay, with null or repeated ids as well; a text that is repeated as a whole becomes empty."""
    return without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; null texts, ids and other columns stay as they are."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences; each row's, with its id, null or repeated. A null text is
    empty and gives the end id alone; an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the filters' hashes, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
