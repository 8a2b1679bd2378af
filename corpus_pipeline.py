"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before left, and all but the last
return documents with the columns they came with. ``run`` writes each stage's
result to the cluster's shared folder and reads it again. Training order goes
from the mix to the sequences as the order of the rows in the files between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, pii, quality
from tessera.llm.common import cut, read, shared_folder, with_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the fitted cutoffs reject.

    Null, empty and very short texts go; long ones are judged whole; repeated
    rows are judged alike, so none of a tie is preferred; a null id or stratum
    is no reason to go; other columns stay as they are; no documents or no
    labels leave none, or the base rules alone.
    """
    with_package(spark)
    cutoffs = quality.fit(cut(quality.measure(docs)), read(spark, sf_dir, "labels"))
    return quality.keep(docs, cutoffs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by five-word shingles.

    Rows are told apart by id and text: of rows under one id, or under none,
    only those that are like another go. Texts without words are like no other;
    of rows equal in id and text one stays; other columns stay as they are;
    no documents give none.
    """
    with_package(spark)
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and secrets replaced by their kinds.

    Null and empty texts stay as they are, long ones are searched whole, equal
    texts become equal ones, a null id is nothing special, other columns stay
    as they are, and no documents give none.
    """
    with_package(spark)
    return pii.redact(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the sources' weights take, written in training order; the last copy of a source may be cut.

    Null and empty texts are never taken; a null source is a source of its own;
    rows repeated are documents of their own; ties in position go by id; other
    columns stay as they are; no documents give none.
    """
    with_package(spark)
    return mixing.in_training_order(docs, mixing.curriculum(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, which are numbered in the order in which the documents were written.

    Null and empty texts are one token, long ones several pieces; rows repeated
    are documents of their own; other columns are not read; documents that are
    read from no files have no order; no documents give no pieces.
    """
    with_package(spark)
    return packing.packed(docs, order=written(docs))


def written(docs: DataFrame) -> Column | None:
    """Each row's place in the files that docs is read from, in the order of their numbers; None if there are no files."""
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["row_index"])
    except AnalysisException:
        return None
    number = [F.coalesce(F.regexp_extract(file["file_name"], p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)\.")]
    return (number[0] * F.lit(1 << 10) + number[1]) * F.lit(1 << 36) + file["row_index"]


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Fitted thresholds, the semi-Markov field and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
