"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomset.llm import language_id
from fathomset.llm.bagminhash import one_of_each
from fathomset.llm.common import fresh, quoted, remainder_is
from fathomset.llm.packing import pack_documents
from fathomset.llm.surrogates import with_surrogates
from fathomset.llm.winnowing import with_contamination
from fathomset.session import settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is found and likelier than all others together; null and letterless texts go."""
    model = language_id.fit(docs.where(~remainder_is(F.col("doc_id"), 4, 2)))
    mark = fresh(docs, "language")
    return language_id.with_language(docs, model, out=mark).where(language_id.accepted(quoted(mark))).drop(mark)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    mark = fresh(docs, "contamination")
    found = with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=mark)
    return found.where(quoted(mark)["n_hit"] == 0).drop(mark)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; all documents stay, and ``n_chars`` follows the text."""
    done = with_surrogates(docs, count=None)
    return done.select(*[F.length("text").cast(k).alias(c) if c == "n_chars" else quoted(c) for c, k in done.dtypes])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark_passages),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: Piece probabilities, Poisson processes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
