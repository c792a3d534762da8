"""From raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import table, written
from recollect.llm.jaccard_join import one_of_each
from recollect.llm.language import confident
from recollect.llm.packing import pack
from recollect.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or near chance go.

    A null or empty text goes. Rows stand alone, repeated ones too; all columns stay as they are, whatever
    they are called. An empty table gives no rows.
    """
    return confident(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: the least doc_id's.

    A null doc_id comes first. A text without words stays; of rows of one doc_id and one text one stays. All
    columns stay as they are, whatever they are called. An empty table gives no rows.
    """
    return one_of_each(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that aren't widely copied examples replaced, and n_chars to match.

    Null and empty texts, and texts without secrets, stay as they are; so do repeated rows and all other
    columns. An empty table gives no rows. A null source is no owner.
    """
    return redact(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    A null or empty text is its end id alone. Repeated rows are documents of their own. An empty table gives
    no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", packing),
]
#: SQL can express none of the first, the second and the last stage; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
