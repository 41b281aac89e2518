"""A corpus from documents: language, near copies, secrets, source weights, packing.

Every stage reads what the one before it kept, as a Parquet table in the shared folder.

What holds for all stages: rows with null text, id, lang or source, empty and very long texts, rows that are equal in every column,
and columns whose names a stage uses inside go through; an empty table comes out empty. All but the last return the columns
that they got, in their order. What a null or a tie means is said at each stage.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attest.llm import langid, mixing, neardup, packing, secret_scan
from attest.llm._shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    A null text, one without letters and one whose best language is unlikely go. Rows with a null lang teach nothing but
    are judged like others; equally likely languages are one answer, so a tie rejects nobody. Equal rows are judged alike. If no row
    has a lang, no language is known and all go.
    """
    return langid.known(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id, null ids last.

    A null text is a class of its own and stays; so does each row of them. Of rows that are equal in id and text one
    stays, any of them. Ties between texts of equal id go to the lesser hash of the text.
    """
    return neardup.kept(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; examples that many owners copy stay.

    A null text stays null, a null source is an owner of its own; equal rows are masked alike, and none is dropped.
    """
    return secret_scan.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight wants it, up to twice.

    A null source is a source, the last in order; a null or empty text has size 0. Documents of a source without words
    have no copies. Ties of rank go by doc_id, then size; rows of equal id, source and size are taken or left together.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, no two of a source or of equal texts in one.

    A null or empty text is a piece of size 0; a text larger than a bin gives several. A null source conflicts with
    nothing. Equal rows are packed each; ties go by doc_id, then by cluster.
    """
    return packing.pack_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near", near),
    ("secrets", secrets),
    ("mix", mix),
    ("pack", pack),
]

#: Language scores and minhash have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
